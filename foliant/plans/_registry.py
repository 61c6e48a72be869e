"""Where the plan modules put their queries and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans.views_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind the views it names, each after those it stands on."""
    needed: list[str] = []

    def add(name: str) -> None:
        on, _ = VIEWS[name]
        for other in on:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    ctes = [f"{n} as ({VIEWS[n][1]})" for n in needed]
    body = body.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join([*ctes, body[5:]])
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body


def query(name: str, views: tuple[str, ...] | str = (), sql: str | None = None):
    """Register a query; without ``sql`` the driver checks its rows only."""
    views = (views,) if isinstance(views, str) else views

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql)
        return f

    return register
