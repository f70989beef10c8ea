"""Compositions of operators: raw feeds to items, items to scored updates, updates to a brief."""
