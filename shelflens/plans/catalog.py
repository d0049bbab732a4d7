"""Imports every query module so that all of them are registered."""

from shelflens.plans import price_queries  # noqa: F401
from shelflens.plans import match_queries  # noqa: F401
from shelflens.plans import report_queries  # noqa: F401
from shelflens.plans import ingest_queries  # noqa: F401
from shelflens.plans import stream_queries  # noqa: F401
