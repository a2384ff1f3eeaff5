"""quillstone.functions."""
