"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.evaluation import rounded
from crossrank.catalog.fragments import targets_sql, with_parts
from crossrank.operators import calendar as cal
from crossrank.operators import quality as ql
from crossrank.plans.quality_report import quality_kpis
from crossrank.sources.star_schema import panels

START, MIN_SHARE = "1995-01-04", 0.2


def _calendars(p):
    return cal.reference_calendars(p.ohlcv, MIN_SHARE)


@query(with_parts("syms", "SELECT symbol, CASE WHEN symbol LIKE '%.L' THEN 'LSE' ELSE 'US' END AS exchange FROM syms"))
def symbol_exchange(spark, folder):
    p = panels(spark, folder)
    return p.symbols.select("symbol", cal.exchange(F.col("symbol")).alias("exchange"))


@query(with_parts("exdays", "SELECT exchange, day FROM exdays"))
def reference_calendars(spark, folder):
    return _calendars(panels(spark, folder))


@query(
    with_parts(
        "raw syms delist",
        f"""SELECT e.symbol, s.first, s.last, COALESCE(s.rows, 0) AS rows,
        CASE WHEN s.rows IS NULL THEN 'missing' ELSE concat_ws(';',
        CASE WHEN s.first > DATE '{START}' + 7 THEN 'starts_late' END,
        CASE WHEN d.delisted IS NOT NULL AND ABS(s.last - d.delisted) > 7 THEN 'last_date_differs_from_delisting'
             WHEN d.delisted IS NULL AND s.last < DATE '2001-11-10' - 7 THEN 'ends_before_cutoff' END) END AS flag
        FROM (SELECT symbol FROM syms UNION ALL SELECT 'ABSENT') e
        LEFT JOIN (SELECT symbol, MIN(date) AS first, MAX(date) AS last, COUNT(*) AS rows FROM raw GROUP BY 1) s USING (symbol)
        LEFT JOIN delist d USING (symbol)""",
    )
)
def coverage(spark, folder):
    p = panels(spark, folder)
    expected = p.symbols.union(spark.createDataFrame([("ABSENT",)], "symbol string"))
    return ql.coverage(p.ohlcv, expected, START, "2001-11-10", p.delistings)


@query(
    with_parts(
        "raw exdays",
        """SELECT symbol, MIN(day) AS "from", MAX(day) AS "to", COUNT(*) AS days FROM (
        SELECT symbol, day, pos - row_number() OVER (PARTITION BY symbol ORDER BY pos) AS island FROM (
          SELECT s.symbol, c.day, c.pos FROM (SELECT symbol, MIN(date) AS a, MAX(date) AS b,
            CASE WHEN symbol LIKE '%.L' THEN 'LSE' ELSE 'US' END AS exchange FROM raw GROUP BY 1) s
          JOIN (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY day) AS pos FROM exdays) c
            ON c.exchange = s.exchange AND c.day BETWEEN s.a AND s.b
          WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.symbol = s.symbol AND r.date = c.day)))
        GROUP BY symbol, island""",
    )
)
def gaps(spark, folder):
    p = panels(spark, folder)
    return ql.gaps(p.ohlcv, _calendars(p))


@query(
    with_parts(
        "raw",
        """SELECT symbol, date, 'high_below_low' AS problem FROM raw WHERE high < low - 1e-9 UNION ALL
        SELECT symbol, date, 'close_outside_range' FROM raw WHERE close > high + 1e-9 OR close < low - 1e-9 UNION ALL
        SELECT symbol, date, 'nonpositive_price' FROM raw WHERE LEAST(open, high, low, close, adjusted_close) <= 0 UNION ALL
        SELECT symbol, date, 'negative_volume' FROM raw WHERE volume < 0""",
    )
)
def ohlc_problems(spark, folder):
    return ql.ohlc_problems(panels(spark, folder).ohlcv)


@query(with_parts("ratios", "SELECT symbol, date, ROUND(close_ratio, 9) AS close_ratio, ROUND(adjusted_ratio, 9) AS adjusted_ratio FROM ratios"))
def daily_ratios(spark, folder):
    return rounded(ql.daily_ratios(panels(spark, folder).ohlcv), close_ratio=9, adjusted_ratio=9)


_FACTORS = "[2, 3, 4, 5, 8, 10, 20, 1/2, 1/3, 1/4, 1/5, 1/8, 1/10, 1/20]"
_NEAR = f"list_min(list_transform({_FACTORS}, lambda f: ABS({{0}} / f - 1)))"


@query(
    with_parts(
        "ratios",
        f"""SELECT symbol, date, ROUND(close_ratio, 9) AS close_ratio, ROUND(adjusted_ratio, 9) AS adjusted_ratio,
        ROUND(list_min(list_transform({_FACTORS}, lambda f: {{'d': ABS(close_ratio / f - 1), 'f': CAST(f AS DOUBLE)}})).f, 9) AS factor,
        {_NEAR.format('adjusted_ratio')} >= 0.03 AS adjusted FROM ratios WHERE {_NEAR.format('close_ratio')} < 0.03""",
    )
)
def splits(spark, folder):
    out = ql.splits(panels(spark, folder).ohlcv)
    return rounded(out, close_ratio=9, adjusted_ratio=9, factor=9)


@query(
    with_parts(
        "ratios",
        "SELECT symbol, date, ROUND(adjusted_ratio, 9) AS adjusted_ratio, ROUND(close_ratio, 9) AS close_ratio, "
        "ROUND(LN(adjusted_ratio), 9) AS log_return FROM ratios WHERE ABS(LN(adjusted_ratio)) > 0.25",
    )
)
def jumps(spark, folder):
    out = ql.jumps(panels(spark, folder).ohlcv)
    return rounded(out, adjusted_ratio=9, close_ratio=9, log_return=9)


@query(
    with_parts(
        "raw",
        """SELECT symbol, MIN(date) AS "from", MAX(date) AS "to", COUNT(*) AS rows, MIN(adjusted_close) AS price FROM (
        SELECT *, SUM(change) OVER (PARTITION BY symbol ORDER BY date) AS run FROM (
          SELECT symbol, date, adjusted_close,
          CASE WHEN adjusted_close = lag(adjusted_close) OVER (PARTITION BY symbol ORDER BY date) THEN 0 ELSE 1 END AS change FROM raw))
        GROUP BY symbol, run HAVING COUNT(*) >= 5""",
    )
)
def stale_runs(spark, folder):
    return ql.stale_runs(panels(spark, folder).ohlcv)


_DAILY = """SELECT symbol, COUNT(d) AS days, MEDIAN(d) AS med, MAX(d) AS mx, AVG(CASE WHEN d > 10 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) AS share
FROM (SELECT symbol, CASE WHEN lag(idx) OVER w = idx - 1 THEN ABS((pa / lag(pa) OVER w - 1) - (pb / lag(pb) OVER w - 1)) * 10000 END AS d
  FROM (SELECT a.symbol, c.idx, a.price AS pa, b.price AS pb FROM prices a JOIN second b USING (symbol, date) JOIN (
    SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT date FROM prices INTERSECT SELECT date FROM second)) c USING (date))
  WINDOW w AS (PARTITION BY symbol ORDER BY idx)) GROUP BY 1"""


@query(
    with_parts(
        "prices second",
        "SELECT symbol, days, ROUND(med, 6) AS median_abs_diff_bp, ROUND(mx, 6) AS max_abs_diff_bp, "
        f"ROUND(share, 9) AS share_days_over_bp FROM ({_DAILY})",
    )
)
def compare_sources_daily(spark, folder):
    p = panels(spark, folder)
    out = ql.compare_daily(p.prices, p.second_source)
    return rounded(out, median_abs_diff_bp=6, max_abs_diff_bp=6, share_days_over_bp=9)


def _side(name: str, source: str) -> str:
    return f"""{name}spell AS MATERIALIZED (SELECT symbol, date, price, lead(date, 1, DATE '2999-01-01') OVER (PARTITION BY symbol ORDER BY date) AS nd
    FROM {source} WHERE date IN (SELECT date FROM prices INTERSECT SELECT date FROM second)),
    {name}lvl AS MATERIALIZED (SELECT d.date, s.symbol, s.price FROM (SELECT base_date AS date FROM kept UNION SELECT end_date FROM kept) d
      JOIN {name}spell s ON s.date <= d.date AND s.nd > d.date),
    {name}ret AS MATERIALIZED (SELECT k.k, e.symbol, (e.price - b.price) / b.price AS ret FROM kept k JOIN {name}lvl e ON e.date = k.end_date
      JOIN {name}lvl b ON b.date = k.base_date AND b.symbol = e.symbol)"""


_HARD = "list_position([Target1, Target2, Target3, Target4, Target5], GREATEST(Target1, Target2, Target3, Target4, Target5))"


def _periods() -> str:
    body = with_parts("cal prices second", "")
    return (
        f"""{body.rstrip()}, kept AS MATERIALIZED (SELECT * FROM cal WHERE base_date IN (SELECT date FROM second) AND end_date IN (SELECT date FROM second)),
        {_side('a', 'prices')}, {_side('b', 'second')},
        qa AS MATERIALIZED (SELECT k, symbol, {_HARD} AS q FROM ({targets_sql('aret', 'k')})),
        qb AS MATERIALIZED (SELECT k, symbol, {_HARD} AS q FROM ({targets_sql('bret', 'k')})),
        perdiff AS MATERIALIZED (SELECT k, label, COUNT(*) AS assets, ROUND(MAX(ABS(a.ret - b.ret)), 9) AS max_abs_return_diff,
        ROUND(AVG(CAST(qa.q != qb.q AS INT)), 9) AS share_different_quintile
        FROM aret a JOIN bret b USING (k, symbol) JOIN qa USING (k, symbol) JOIN qb USING (k, symbol) JOIN kept USING (k) GROUP BY 1, 2)
        """
    )


@query(_periods() + "SELECT * FROM perdiff")
def compare_sources_periods(spark, folder):
    p = panels(spark, folder)
    out = ql.compare_periods(p.prices, p.second_source, p.calendar)
    return rounded(out, max_abs_return_diff=9, share_different_quintile=9)


@query(
    _periods()
    + f"""SELECT (SELECT MEDIAN(med) FROM ({_DAILY})) AS median_of_medians_bp,
    MAX(share_different_quintile) AS worst_quintile_share, ROUND(AVG(share_different_quintile), 9) AS mean_quintile_share,
    COUNT(*) AS periods FROM perdiff"""
)
def source_kpis(spark, folder):
    from crossrank.plans.quality_report import source_kpis as build

    p = panels(spark, folder)
    daily = ql.compare_daily(p.prices, p.second_source)
    periods = ql.compare_periods(p.prices, p.second_source, p.calendar)
    return rounded(
        build(daily, periods), worst_quintile_share=9, mean_quintile_share=9
    ).selectExpr("round(median_of_medians_bp, 9) AS median_of_medians_bp", "worst_quintile_share",
                 "mean_quintile_share", "periods")


@query(
    with_parts(
        "raw exdays ratios syms",
        f"""SELECT (SELECT COUNT(*) FROM syms) AS symbols,
        (SELECT COUNT(*) FROM ratios WHERE {_NEAR.format('close_ratio')} < 0.03) AS splits,
        (SELECT COUNT(*) FROM ratios WHERE {_NEAR.format('close_ratio')} < 0.03 AND {_NEAR.format('adjusted_ratio')} < 0.03) AS unadjusted_splits,
        (SELECT COUNT(*) FROM ratios WHERE ABS(LN(adjusted_ratio)) > 0.25) AS jumps,
        (SELECT COUNT(*) FROM raw WHERE high < low - 1e-9) + (SELECT COUNT(*) FROM raw WHERE close > high + 1e-9) AS ohlc""",
    )
)
def quality_kpis_raw(spark, folder):
    p = panels(spark, folder)
    return quality_kpis(p.ohlcv)
