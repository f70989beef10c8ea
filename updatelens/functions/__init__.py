"""Column functions: text, links, times, digests and small value tables."""
