"""Registered queries: one Spark callable each, and its SQL where SQL can say it."""

from . import analyze, enrich, ingest, jobs, match, model, stream, trends  # noqa: F401
from .jobs import CASES
