"""Realised quintile shares and the ranked probability score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossrank.functions.draws import hash_order
from crossrank.functions.scores import TARGETS, rps_expr, threshold, tie_share
from crossrank.operators.ordering import Place, order_statistics, with_rank
from crossrank.schema import RANKS

OFFICIAL_SIZE = 100


def thresholds_rule(n: Column) -> Column:
    return F.when(n == OFFICIAL_SIZE, F.lit("official")).otherwise(F.lit("proportional"))


def quintile_cuts(df: DataFrame, by: list[str], value: str, bounded: bool = False) -> DataFrame:
    """Per group, the values at the four quintile limits with the ranks of their tie groups.

    A limit at position 0 (fewer than five assets) is left NULL: every value lies above it.
    """
    places = [Place(q / 5, threshold("n", q)) for q in range(1, 5)]
    limits = order_statistics(df, by, value, places, bounded)
    picks = [
        f"max(CASE WHEN slot = {q} AND {threshold('n', q + 1)} > 0"
        f" THEN struct(value AS v, less, ties) END) AS _cut{q}"
        for q in range(4)
    ]
    return limits.groupBy(*by).agg(F.max("n").alias("n"), *map(F.expr, picks))


def quintile_targets(
    df: DataFrame,
    by: list[str],
    value: str = "ret",
    rule: str = "proportional",
    bounded: bool = False,
) -> DataFrame:
    """Add Target1..Target5 and ``n``: the quintile shares of each row inside its group.

    Ranks ascend; a tie group shares the average of the quintiles its positions span.  Only
    the tie groups at the four limits can straddle two quintiles, so four order statistics
    per group decide every row and no group is ever sorted as a whole.  ``official`` fails
    unless a group has exactly 100 assets.  A NULL value fails, as an asset without return.
    """
    if rule not in ("official", "proportional"):
        raise ValueError(f"unknown thresholds rule {rule!r}")
    cuts = quintile_cuts(df, by, value, bounded)
    joined = df.join(F.broadcast(cuts) if bounded else cuts, by, "left")
    level = " + ".join(f"int(_cut{q} IS NULL OR _cut{q}.v < {value})" for q in range(4))
    tie = ", ".join(f"CASE WHEN _cut{q}.v = {value} THEN _cut{q} END" for q in range(4))
    placed = joined.selectExpr(
        *df.columns, "n", f"1 + {level} AS _level", f"coalesce({tie}) AS _tie"
    )
    guard = f"WHEN {value} IS NULL THEN double(raise_error('missing period return'))"
    if rule == "official":
        guard += (
            f" WHEN n != {OFFICIAL_SIZE} THEN double(raise_error("
            f"concat('official limits need {OFFICIAL_SIZE} assets, got ', n)))"
        )
    shares = [
        f"CASE {guard} WHEN _tie IS NULL THEN double(_level = {q})"
        f" ELSE {tie_share('_tie.less', '_tie.ties', 'n', q)} END AS {t}"
        for q, t in enumerate(TARGETS, 1)
    ]
    return placed.selectExpr(*df.columns, "n", *shares)


def missing_forecasts(targets: DataFrame, forecasts: DataFrame, on: list[str]) -> DataFrame:
    """Target assets without a forecast (empty = complete)."""
    return targets.select(*on).join(forecasts.select(*on), on, "left_anti")


def rps_per_asset(forecasts: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """RPS of every forecast row that has a target; both sides are joined on ``on``."""
    realised = targets.select(*on, *TARGETS)
    return forecasts.join(realised, on).withColumn("rps", F.expr(rps_expr()))


def mean_rps(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.avg("rps").alias("rps"), F.count(F.lit(1)).alias("n_assets")
    )


def window_mean_rps(scored: DataFrame, window: list[str], by: list[str]) -> DataFrame:
    """Mean over windows of each window's mean RPS, so windows weigh the same."""
    per_window = scored.groupBy(*by, *window).agg(F.avg("rps").alias("_rps"))
    return per_window.groupBy(*by).agg(
        F.avg("_rps").alias("rps"), F.count(F.lit(1)).alias("n_windows")
    )


def label_rps(rows: DataFrame, by: list[str], label: str = "label", weight: str = "weight") -> DataFrame:
    """Weighted mean RPS of one-hot labels (0..4) against Rank1..Rank5."""
    hot = rows.selectExpr(
        *by,
        *RANKS,
        f"{weight} AS _w",
        *[f"double({label} = {q}) AS {t}" for q, t in enumerate(TARGETS)],
    )
    return hot.groupBy(*by).agg(
        F.expr(f"sum(_w * {rps_expr()}) / sum(_w) AS rps"), F.sum("_w").alias("weight")
    )


def strict_quintile(
    df: DataFrame, by: list[str], value: str, tie_key: str, bounded: bool = False
) -> DataFrame:
    """Add ``quintile`` 1..5 by unique position: ties are ordered by a hash of ``tie_key``.

    For simulated scenarios, where each row takes exactly one position.
    """
    cuts = quintile_cuts(df, by, value, bounded)
    joined = df.join(F.broadcast(cuts) if bounded else cuts, by)
    level = " + ".join(f"int(_cut{q} IS NULL OR _cut{q}.v < {value})" for q in range(4))
    tie = ", ".join(f"CASE WHEN _cut{q}.v = {value} THEN _cut{q} END" for q in range(4))
    rows = joined.selectExpr(
        *df.columns, "n", f"1 + {level} AS _level", f"coalesce({tie}) AS _tie"
    )
    plain = rows.where("_tie IS NULL OR _tie.ties = 1").selectExpr(
        *df.columns, "n", "_level AS quintile"
    )
    # Only a tie group across a limit needs an order of its own.
    tied = rows.where("_tie.ties > 1").withColumn("_hash", F.expr(hash_order(tie_key)))
    group = [*by, value]
    step = " + ".join(f"int(_tie.less + _place > {threshold('n', q)})" for q in range(1, 5))
    broken = with_rank(tied, group, "_hash", low="_place").selectExpr(
        *df.columns, "n", f"1 + {step} AS quintile"
    )
    return plain.unionByName(broken)


def quintile_frequencies(
    scenarios: DataFrame, scenario: str = "scenario", value: str = "ret", bounded: bool = False
) -> DataFrame:
    """Rank1..Rank5 per symbol: share of scenarios in which it lands in each quintile."""
    placed = strict_quintile(scenarios, [scenario], value, "symbol", bounded)
    return placed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_scenarios"),
        *[F.expr(f"avg(double(quintile = {q})) AS {c}") for q, c in enumerate(RANKS, 1)],
    )
