"""Part of newsloom; see the module docstrings."""
