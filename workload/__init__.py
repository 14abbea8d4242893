"""Queries over the test tables, each with the SQL that must give the same rows."""

from workload import curation, files, joining, scoring, texts
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "curation", "files", "joining", "scoring", "texts"]
