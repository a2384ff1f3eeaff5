"""quillstone.plans."""
