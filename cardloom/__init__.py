"""Spark jobs over card-grading data: catalogs, identification, grading, collections."""
