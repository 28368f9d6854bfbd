"""Queries over the driver's tables. Importing the package fills the register."""

from tidemark.plans import feature_queries, ingest_queries, relational_queries, report_queries  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES  # noqa: F401
