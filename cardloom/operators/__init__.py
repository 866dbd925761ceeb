"""DataFrame operators: grading, collections, search, similarity, catalogs, pixels."""
