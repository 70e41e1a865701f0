"""DataFrame -> DataFrame operators of the corpus index."""
