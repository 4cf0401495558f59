"""Consistency checks of statements as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return F.format_number(x, 0)


def _tenth(x: Column) -> Column:
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def _result(passed: Column, warnings: Column, pct: Column) -> Column:
    return F.struct(
        passed.alias("passed"),
        F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"),
        pct.cast("double").alias("discrepancy_pct"),
    )


# The warning texts below.
def balance_check(assets: Column, liabilities: Column, equity: Column, tolerance_pct: float = 5.0) -> Column:
    """struct(passed, warnings, discrepancy_pct): assets against liabilities + equity."""
    a, l, e = (c.cast("double") for c in (assets, liabilities, equity))
    total = l + e
    pct = F.try_divide(F.abs(a - total), F.abs(a)) * 100
    none = F.lit(None)
    say = lambda text: F.array(F.lit(text))
    violated = F.array(
        F.concat(
            F.lit("Balance equation violated: assets="), _whole(a),
            F.lit(", liabilities+equity="), _whole(total),
            F.lit(", discrepancy="), _tenth(pct), F.lit("%"),
        )
    )
    no = F.lit(False)
    return (
        F.when(a.isNull(), _result(no, say("total_assets is missing"), none))
        .when(
            l.isNull() & e.isNull(),
            _result(no, say("both total_liabilities and equity are missing"), none),
        )
        .when(
            e.isNull(),
            _result(no, say("equity missing — balance equation cannot be fully verified"), none),
        )
        .when(
            l.isNull(),
            _result(no, say("total_liabilities missing — balance equation cannot be fully verified"), none),
        )
        .when(a == 0, _result(no, say("total_assets = 0 — suspicious"), none))
        .when(pct > tolerance_pct, _result(no, violated, pct))
        .otherwise(_result(F.lit(True), none.cast("array<string>"), pct))
    )


def revenue_or_banking(revenue: Column, banking: Column) -> Column:
    """Revenue, or net banking income where revenue is null or zero."""
    return F.coalesce(F.when(revenue != 0, revenue), banking)


def income_check(revenue: Column, net_income: Column, gross_profit: Column) -> Column:
    """struct(passed, warnings): net income against revenue, gross margin range."""
    r, n, g = (c.cast("double") for c in (revenue, net_income, gross_profit))
    margin = F.when(r != 0, F.try_divide(g, r))
    percent = F.concat(F.lit("gross_margin="), _tenth(margin * 100))
    warnings = F.array_compact(
        F.array(
            F.when(
                F.abs(n) > F.abs(r) * 2,
                F.concat(
                    F.lit("net_income ("), _whole(n), F.lit(") is unusually large vs revenue ("),
                    _whole(r), F.lit(")"),
                ),
            ),
            F.when(margin > 1.05, F.concat(percent, F.lit("% > 100% — check unit consistency"))),
            F.when(margin < -0.5, F.concat(percent, F.lit("% very negative — check sign"))),
        )
    )
    return F.struct((F.size(warnings) == 0).alias("passed"), warnings.alias("warnings"))
