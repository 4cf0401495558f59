"""Registry of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]

RUNNERS: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a runner; `uses` names the shared CTEs its SQL reads."""

    def wrap(fn: Runner) -> Runner:
        if name in RUNNERS:
            raise ValueError(f"query {name} registered twice")
        RUNNERS[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(uses, sql)
        return fn

    return wrap


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    CTES[name] = (uses, sql)


def with_ctes(names: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        uses, _ = CTES[name]
        for other in uses:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    parts = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    keyword = "WITH"
    text = body.lstrip()
    if text[:14].upper() == "WITH RECURSIVE":
        keyword, text = "WITH RECURSIVE", text[14:]
        return f"{keyword} {parts}, {text}"
    if text[:5].upper() == "WITH ":
        return f"{keyword} {parts}, {text[5:]}"
    return f"{keyword} {parts} {text}"
