"""Queries over the driver's tables, each with its SQL twin."""

from . import annotation, composites, files, intervals, metagene, motifs, numeric, records, streams, tracks
from .views import QUERIES, SQL, oracle

MODULES = (annotation, composites, files, intervals, metagene, motifs, numeric, records, streams, tracks)

__all__ = ["QUERIES", "SQL", "oracle"]
