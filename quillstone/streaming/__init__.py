"""quillstone.streaming."""
