"""Output formats of the graph."""
