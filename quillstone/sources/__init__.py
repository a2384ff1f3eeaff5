"""quillstone.sources."""
