"""streaming of recfeat."""
