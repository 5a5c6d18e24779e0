"""Registered queries with their SQL counterparts."""

from docweave.queries import dialogue, endtoend, events, ingestion, retrieval  # noqa: F401
from docweave.queries.common import ORACLES, QUERIES  # noqa: F401
