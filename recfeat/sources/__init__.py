"""sources of recfeat."""
