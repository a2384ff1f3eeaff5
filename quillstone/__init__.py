"""quillstone: box-level grounding data, reward analytics and corpus preparation on Spark."""
