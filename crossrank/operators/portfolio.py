"""Portfolio returns, information ratio, turnover and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.scores import TARGETS, rps_expr
from crossrank.operators.calendar import period_days
from crossrank.operators.panel import daily_returns
from crossrank.schema import RANKS


def missing_weights(weights: DataFrame, returns: DataFrame, ids: list[str]) -> DataFrame:
    """Priced symbols of a period without a weight, per portfolio (empty = complete).

    ``returns`` has one row per (k, symbol) priced by the end of the period.
    """
    held = returns.select("k", "symbol").join(weights.select("k", "symbol", *ids), ["k", "symbol"], "left")
    sizes = returns.groupBy("k").agg(F.count(F.lit(1)).alias("priced"))
    return (
        held.groupBy("k", *ids)
        .agg(F.count(F.lit(1)).alias("held"))
        .join(F.broadcast(sizes), "k")  # one row per period
        .where(" OR ".join(["held < priced", *[f"{c} IS NULL" for c in ids]]))
    )


def daily_log_returns(
    weights: DataFrame, prices: DataFrame, periods: DataFrame, days: DataFrame, ids: list[str]
) -> DataFrame:
    """(ids, k, date, is_first, ret): log1p of the weighted return on every day of each period.

    Only observed price changes are joined: a carried price moves nothing, so its day adds
    zero.  While a held symbol has no base price yet (first priced inside the period), the
    whole day is NULL, as a missing return is not skipped.
    """
    inside = period_days(periods, days)
    held = weights.select(*ids, "k", "symbol", "weight")
    moved = _moved(prices, inside).join(held, ["k", "symbol"])
    part = moved.groupBy(*ids, "k", "date").agg(
        F.expr("sum(weight * ret) AS _sum"), F.max(F.col("ret").isNull()).alias("_starts")
    )
    return log_of_sums(part, held.select(*ids, "k").distinct(), inside, ids)


def _moved(prices: DataFrame, inside: DataFrame) -> DataFrame:
    """Observed price changes on the days of the periods; NULL for the first price of a symbol."""
    return daily_returns(prices).select("symbol", "date", "ret").join(F.broadcast(inside.select("k", "date")), "date")


def log_of_sums(part: DataFrame, held: DataFrame, inside: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, k, date, is_first, ret) from the sums ``_sum`` of weighted returns on days with a price
    change; ``held`` are the portfolios (ids, k), and all three are calendar-sized per portfolio."""
    every = (
        held.join(F.broadcast(inside.select("k", "date")), "k")
        .join(part, [*ids, "k", "date"], "left")
        .selectExpr(*ids, "k", "date", "coalesce(_sum, 0D) AS _sum", "coalesce(_starts, false) AS _starts")
    )
    keys = ", ".join([*ids, "k"])
    return every.selectExpr(
        *ids,
        "k",
        "date",
        f"row_number() OVER (PARTITION BY {keys} ORDER BY date) = 1 AS is_first",
        f"CASE WHEN NOT coalesce(bool_or(_starts) OVER (PARTITION BY {keys} ORDER BY date DESC), false)"
        " THEN log1p(_sum) END AS ret",
    )


def period_totals(
    rows: DataFrame, targets: DataFrame, prices: DataFrame, inside: DataFrame, ids: list[str], sums: dict[str, str]
) -> DataFrame:
    """What scores and returns of portfolios need, from one pass over their rows.

    ``rows`` holds (ids, k, symbol, Rank1..5, weight), ``targets`` (k, symbol, Target1..5) of the
    members, NULL for a member without return.  Everything known of an asset in a period, its
    targets and its price changes, meets the rows in one join.  Returns per (ids, k) a row per day
    with a price change (``_sum``, ``_starts``) and one without ``date``: ``_sum`` of the RPS,
    ``_scored`` and ``_held`` rows with targets and of members, and ``sums``, SQL aggregates over
    the rows (``_member`` and ``_real`` say whether a row is of a member and has targets).
    """
    moves = _moved(prices, inside).groupBy("k", "symbol").agg(F.expr("collect_list(struct(date, ret)) AS _moves"))
    known = targets.withColumn("_member", F.lit(True)).join(moves, ["k", "symbol"], "full_outer")
    # The side with a row per asset and period is hashed, so the many rows of the portfolios need no order.
    both = rows.join(known.hint("shuffle_hash"), ["k", "symbol"], "left")
    kept = [c for c in rows.columns if c not in (*RANKS, "symbol")]
    unfolded = both.selectExpr(
        *kept,
        "_member IS NOT NULL AS _member",
        f"{TARGETS[0]} IS NOT NULL AS _real",
        f"explode(concat(array(struct(CAST(NULL AS DATE) AS date, {rps_expr()} AS ret)), coalesce(_moves, array()))) AS _m",
    ).select("*", F.col("_m.date").alias("date"), F.col("_m.ret").alias("_ret")).drop("_m")
    return unfolded.groupBy(*ids, "k", "date").agg(
        F.expr("sum(CASE WHEN date IS NULL THEN _ret ELSE weight * _ret END) AS _sum"),
        F.expr("bool_or(date IS NOT NULL AND _ret IS NULL) AS _starts"),
        F.expr("count_if(date IS NULL AND _real) AS _scored"),
        F.expr("count_if(date IS NULL AND _member) AS _held"),
        *[F.expr(f"{sql} AS {name}") for name, sql in sums.items()],
    )


def information_ratio(
    daily: DataFrame, by: list[str], value: str = "ret", zero_variance: float | None = None,
    out: str = "ir",
) -> DataFrame:
    """Pooled sum / sample deviation; ``returns`` and ``risk`` are the two parts."""
    return daily.groupBy(*by).agg(
        F.sum(value).alias("returns"),
        F.stddev_samp(value).alias("risk"),
        F.expr(ratio_sql(value, zero_variance)).alias(out),
    )


def ratio_sql(value: str, zero_variance: float | None = None) -> str:
    zero = "NULL" if zero_variance is None else f"{zero_variance}D"
    return (
        f"CASE WHEN stddev_samp({value}) = 0 THEN {zero} ELSE sum({value}) / stddev_samp({value}) END"
    )


def sharpe_sql(value: str, days: int = 252) -> str:
    return (
        f"CASE WHEN stddev_samp({value}) > 0 THEN avg({value}) / stddev_samp({value}) * sqrt({days}) END"
    )


def turnover(weights: DataFrame, periods: DataFrame, ids: list[str]) -> DataFrame:
    """Sum of absolute weight changes per period; the first one starts from cash.

    Every weight enters its own period and, negated, the next one, so the change over the
    union of both symbol sets is one aggregation.  The rows are placed before they are doubled.
    ``repeated`` is the number of symbols with more than one row.
    """
    order = periods.selectExpr("k", "lead(k) OVER (ORDER BY base_date, k) AS next_k")
    change = (
        weights.select(*ids, "k", "symbol", "weight")
        .repartition(*ids, "symbol")
        .join(F.broadcast(order), "k")
        .selectExpr(
            *ids, "symbol",
            "explode(array(struct(k, weight, 1 AS own), struct(next_k AS k, -weight AS weight, 0 AS own))) AS m",
        )
        .where("m.k IS NOT NULL")
        .selectExpr(*ids, "symbol", "m.k AS k", "m.weight AS weight", "m.own AS own")
        .groupBy(*ids, "symbol", "k")
        .agg(F.sum("weight").alias("change"), F.sum("own").alias("own"))
    )
    return change.groupBy(*ids, "k").agg(
        F.sum(F.abs("change")).alias("turnover"), F.count_if(F.col("own") > 1).alias("repeated")
    )


def net_returns(daily: DataFrame, turned: DataFrame, ids: list[str], cost_bps: float) -> DataFrame:
    """Add ``ret_net``: the cost of the turnover is paid on the first day of the period."""
    return daily.join(turned, [*ids, "k"], "left").selectExpr(
        *daily.columns,
        f"CASE WHEN is_first THEN log1p(expm1(ret) - {cost_bps / 1e4!r}D * turnover) ELSE ret END"
        " AS ret_net",
    )
