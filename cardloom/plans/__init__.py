"""Registered queries with their SQL, and the input adapters that both share."""

from . import catalog, centering, collection, grading, pixels, similarity, sources, streaming  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
