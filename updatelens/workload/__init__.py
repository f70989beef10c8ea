"""The registered queries: test tables seen as model tables, one query per operator, and their SQL."""
