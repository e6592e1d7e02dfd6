"""Python sources to graph tables."""
