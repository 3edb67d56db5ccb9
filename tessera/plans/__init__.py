"""Queries over the driver's tables, one or more for each operator."""

from tessera.plans import changes, elements, fields, listings, posts, records, relations, standing, states, texts, verdicts, vocabularies  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
