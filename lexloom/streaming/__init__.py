"""lexloom streaming."""
