"""Reading raw documents and writing tables."""
