"""quillstone.operators."""
