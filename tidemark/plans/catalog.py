"""All queries of the core."""

from __future__ import annotations

from tidemark.plans import analysis, extras, inventory, point_in_time, problems, questions, relational, text_calendar
from tidemark.plans.registry import Query

MODULES = (problems, relational, point_in_time, text_calendar, analysis, questions, extras, inventory)


def all_queries() -> dict[str, Query]:
    """Queries by name, from all modules of plans."""
    found: dict[str, Query] = {}
    for module in MODULES:
        found |= module.REGISTRY.items
    return found
