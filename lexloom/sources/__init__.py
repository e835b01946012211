"""lexloom sources."""
