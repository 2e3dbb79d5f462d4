"""Queries over the driver's tables, one or more per operator."""

from . import analytics, evidence, ingest, quotes, reports, scalars, tenders, validation  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
