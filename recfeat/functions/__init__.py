"""functions of recfeat."""
