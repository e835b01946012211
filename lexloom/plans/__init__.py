"""lexloom plans."""
