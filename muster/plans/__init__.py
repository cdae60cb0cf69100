"""Registered queries. Importing this package registers all of them."""

from muster.plans import q_archive, q_pages, q_quality, q_search, q_sources, q_text, q_timetable  # noqa: F401
from muster.registry import REGISTRY

__all__ = ["REGISTRY"]
