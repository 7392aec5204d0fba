"""Column-to-Column building blocks, shared by batch and streaming."""
