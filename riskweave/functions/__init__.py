"""Column functions: text, paths, versions, URLs."""
