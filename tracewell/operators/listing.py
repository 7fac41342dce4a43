"""The session list: sorted, filtered and paged by closed sets of keys."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import clipped
from tracewell.plans.manifest import ask

#: The columns that a list may be sorted by.
SORTS = "started_at title project_dir turns api_calls tool_calls compactions tool_errors cost_usd wall_ms agent_runs".split()


def _day(value) -> str:
    return str(datetime.date.fromisoformat(str(value)))


FILTERS = {
    "project": lambda v: (F.col("project_dir") == v) | F.col("project_dir").startswith(f"{v}/"),
    "since": lambda v: F.col("started_at") >= F.to_date(F.lit(_day(v))),
    "until": lambda v: F.col("started_at") < F.date_add(F.to_date(F.lit(_day(v))), 1),
    "skill": lambda v: F.array_contains("skills", str(v)),
    "errors": lambda v: F.col("tool_errors") >= int(v),
}


def parse_filters(given: dict[str, str | None]) -> dict[str, str]:
    """Filters that are set; an unknown one raises, a blank one is none."""
    if unknown := sorted(set(given) - set(FILTERS)):
        raise ValueError(f"no filter is called {', '.join(unknown)}")
    return {k: v for k, v in given.items() if v is not None and str(v).strip()}


def list_sessions(store, sort: str = "started_at", descending: bool = True, page: int = 0, size: int = 50, head_chars: int = 100, head_items: int = 3, **filters) -> DataFrame:
    """One page of sessions and one row beyond it, which tells that there is more.

    Nulls come last in both directions; ties go by session in the same direction.
    Lists are cut to ``head_items`` with the number that was cut.
    """
    if sort not in SORTS:
        raise ValueError(f"no sort key is called {sort}")
    rows = ask(store, "view_sessions")
    for name, value in parse_filters(filters).items():
        rows = rows.where(FILTERS[name](value))
    order = F.desc_nulls_last if descending else F.asc_nulls_last
    rows = rows.orderBy(order(sort), order("session_id")).offset(page * size).limit(size + 1)
    cut = {c: clipped(c, head_chars) for c in ("title", "project_dir")}
    for c in ("skills", "agent_types", "pr_urls"):
        cut[f"{c}_cut"] = F.greatest(F.coalesce(F.size(c), F.lit(0)) - head_items, F.lit(0)).cast("long")
        cut[c] = F.slice(c, 1, head_items)
    return rows.withColumns(cut)
