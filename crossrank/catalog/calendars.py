"""Calendar queries."""

from __future__ import annotations

from crossrank.catalog import query
from crossrank.catalog.fragments import with_parts
from crossrank.operators import calendar as cal
from crossrank.sources.star_schema import GRID_ORIGIN, panels


@query(
    with_parts(
        "grid",
        "SELECT k, label, phase, base, start, \"end\", "
        "CAST(start - 1 AS TIMESTAMP) + INTERVAL 18 HOUR AS deadline FROM grid "
        "WHERE \"end\" <= (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem)",
    )
)
def calendar_grid(spark, folder):
    p = panels(spark, folder)
    return cal.period_grid(spark, GRID_ORIGIN, p.last_day)


@query(
    with_parts(
        "cal",
        "SELECT k, label, base, base_date, end_date, CAST((SELECT COUNT(*) FROM days "
        "WHERE day > base_date AND day <= end_date) AS INTEGER) AS n_days FROM cal",
    )
)
def calendar_resolved(spark, folder):
    return panels(spark, folder).calendar.select(
        "k", "label", "base", "base_date", "end_date", "n_days"
    )


@query(
    with_parts(
        "dayk",
        "SELECT k, date FROM dayk",
    )
)
def period_days(spark, folder):
    p = panels(spark, folder)
    return cal.period_days(p.calendar, p.days).select("k", "date")


@query(with_parts("days", "SELECT day, idx FROM days"))
def trading_days(spark, folder):
    return panels(spark, folder).days.select("day", "idx")
