"""operators of recfeat."""
