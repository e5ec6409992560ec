"""Point-in-time universes and portfolio weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.scores import expected_rank_score
from crossrank.operators.panel import history_at
from crossrank.schema import RANKS
from crossrank.staging import stage

POLICIES = ("official", "d2")
WEIGHTINGS = ("equal", "expected_rank")

# Exit dates of delisted assets and what replaced them.
DELISTINGS = {"DRE": "2022-11-28", "WRK": "2024-07-05", "AVB": "2026-08-17"}
SUCCESSORS = {"DRE": "PLD", "WRK": None, "AVB": "VMRK"}


def delisting_table(spark, dates: dict[str, str] = DELISTINGS) -> DataFrame:
    return spark.createDataFrame(list(dates.items()), "symbol string, delisted string").select(
        "symbol", F.to_date("delisted").alias("delisted")
    )


def successor_table(spark, pairs: dict[str, str | None] = SUCCESSORS) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "symbol string, successor string")


def universe(
    prices: DataFrame,
    origins: DataFrame,
    days: DataFrame,
    policy: str = "official",
    assets: DataFrame | None = None,
    delistings: DataFrame | None = None,
) -> DataFrame:
    """(k, symbol) eligible at each origin: priced on or before it and in ``assets``.

    ``d2`` also leaves out symbols delisted on or before the origin.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown universe policy {policy!r}")
    if assets is not None:
        prices = prices.join(assets.select("symbol"), "symbol", "left_semi")
    dated = origins.select("k", F.col("origin").alias("date"))
    known = history_at(prices, dated, days).select("symbol", "date")
    members = known.join(F.broadcast(dated), "date")
    if policy == "d2":
        gone = delistings.select("symbol", "delisted")
        members = members.join(gone, "symbol", "left").where(
            "delisted IS NULL OR delisted > date"
        )
    return members.select("k", "symbol")


def survivors_universe(assets: DataFrame, successors: DataFrame) -> DataFrame:
    """Each delisted asset swapped for its successor, or dropped when it has none."""
    marked = assets.join(successors.withColumn("_gone", F.lit(True)), "symbol", "left")
    return (
        marked.where("_gone IS NULL OR successor IS NOT NULL")
        .selectExpr("coalesce(successor, symbol) AS symbol")
        .distinct()
    )


def asset_class(symbols: DataFrame, classes: DataFrame, default: str = "stock") -> DataFrame:
    return symbols.join(classes.select("symbol", "class"), "symbol", "left").withColumn(
        "class", F.coalesce("class", F.lit(default))
    )


def equal_weights(members: DataFrame, by: list[str]) -> DataFrame:
    """Add ``weight`` = 1 / members of the group."""
    sizes = stage(members.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    return members.join(sizes, by).selectExpr(*members.columns, "1D / _n AS weight")


def expected_rank_weights(forecasts: DataFrame, by: list[str], gross: float = 1.0) -> DataFrame:
    """Weights proportional to the expected quintile minus 3; equal when all are 3."""
    kept = [c for c in forecasts.columns if c != "weight"]
    scored = forecasts.selectExpr(*kept, f"{expected_rank_score()} AS _score")
    totals = stage(
        scored.groupBy(*by).agg(
            F.sum(F.abs("_score")).alias("_total"), F.count(F.lit(1)).alias("_n")
        ),
        "totals",
    )
    return scored.join(totals, by).selectExpr(
        *kept, f"CASE WHEN _total = 0 THEN {gross}D / _n ELSE {gross}D * _score / _total END AS weight"
    )


def with_weights(
    forecasts: DataFrame, by: list[str], weighting: str, gross: float = 1.0
) -> DataFrame:
    """Recompute the weights of stored probabilities; the forecasts are not refitted."""
    if weighting == "equal":
        return equal_weights(forecasts.drop("weight"), by)
    if weighting == "expected_rank":
        return expected_rank_weights(forecasts, by, gross)
    raise ValueError(f"unknown weighting {weighting!r}")


def uniform_forecast(members: DataFrame, model: str = "uniform") -> DataFrame:
    """Probability 0.2 everywhere and equal weights, for every member of every period."""
    probs = members.select(
        F.lit(model).alias("model"), "k", "symbol", *[F.lit(0.2).alias(c) for c in RANKS]
    )
    return equal_weights(probs, ["model", "k"])
