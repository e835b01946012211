"""lexloom functions."""
