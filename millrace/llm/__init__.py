"""Training-data operators: ten large-scale steps from raw documents to token files."""
