"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from foliant.plans import form_queries, image_queries, layout_queries, object_queries, page_queries, review_queries, status_queries, text_queries  # noqa: F401
from foliant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
