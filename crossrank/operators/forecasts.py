"""Forecast validation, the historical-frequency baseline and external forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.operators.calendar import past_windows
from crossrank.operators.panel import period_returns
from crossrank.operators.targets import quintile_targets
from crossrank.operators.universe import equal_weights
from crossrank.functions.scores import TARGETS
from crossrank.schema import RANKS
from crossrank.staging import stage

MIN_GROSS, MAX_GROSS = 0.25, 1.0
ROUNDING = 1e-3


def row_problems(tol: float = 1e-6) -> dict[str, str]:
    """The rules a row of a forecast can break by itself, as SQL conditions."""
    total = " + ".join(RANKS)
    return {
        "not_finite": " OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('inf')" for c in RANKS),
        "negative_probability": " OR ".join(f"{c} < -{tol}D" for c in RANKS),
        "sum_not_one": f"abs({total} - 1) > {tol}D",
        "weight_not_finite": "weight IS NULL OR isnan(weight) OR abs(weight) = double('inf')",
    }


def forecast_violations(
    forecasts: DataFrame, members: DataFrame, tol: float = 1e-6, ids: tuple[str, ...] = ("model",)
) -> DataFrame:
    """(ids, k, problem, rows) for every rule a forecast breaks; empty = valid."""
    keys = [*ids, "k"]
    problems = row_problems(tol)
    marked = forecasts.selectExpr(
        *keys, "symbol", "weight", *[f"coalesce({sql}, false) AS {name}" for name, sql in problems.items()]
    )
    # One join says which rows are of members; a symbol counts once however often it is given.
    per_symbol = (
        marked.join(members.select("k", "symbol", F.lit(True).alias("_member")), ["k", "symbol"], "left")
        .groupBy(*keys, "symbol")
        .agg(
            F.max("_member").alias("_member"), F.count(F.lit(1)).alias("_rows"), F.sum(F.abs("weight")).alias("_gross"),
            *[F.count_if(name).alias(name) for name in problems],
        )
    )
    sizes = members.select("k", "symbol").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("_wanted"))
    table = (
        per_symbol.groupBy(*keys)
        .agg(
            F.count("_member").alias("_held"), F.expr("coalesce(sum(CASE WHEN _member IS NULL THEN _rows END), 0L) AS unknown_symbol"),
            F.sum("_gross").alias("_gross"), *[F.sum(name).alias(name) for name in problems],
        )
        .join(F.broadcast(sizes), "k", "left")  # one row per period
        .selectExpr(
            "*",
            "coalesce(_wanted, 0L) - _held AS missing_symbol",
            f"bigint(NOT coalesce({gross_within(tol)}, true)) AS gross_exposure",
        )
    )
    names = ["missing_symbol", "unknown_symbol", *problems, "gross_exposure"]
    cells = ", ".join(f"'{name}', {name}" for name in names)
    return table.selectExpr(*keys, f"stack({len(names)}, {cells}) AS (problem, rows)").where("rows > 0")


def gross_within(tol: float = 1e-6) -> str:
    return f"_gross BETWEEN {MIN_GROSS - tol}D AND {MAX_GROSS + tol}D"


def historical_frequency(
    prices: DataFrame,
    origins: DataFrame,
    members: DataFrame,
    days: DataFrame,
    delistings: DataFrame | None = None,
    lookback: int | None = None,
    alpha: float = 1.0,
    model: str = "historical_frequency",
) -> DataFrame:
    """Smoothed frequency of each quintile in the past four-week windows of each origin.

    Windows shared by several origins are ranked once.  The windows of an origin are a run
    of one 28-day chain (its dates modulo 28), so its counts are the difference of two
    running sums per symbol instead of a join of every window with every origin.  With
    ``delistings`` the symbols already gone at an origin are left out of its past rankings;
    origins between two delisting dates share the same rankings.
    """
    marked = origins.select("k", "origin")
    if delistings is None:
        versions = marked.withColumn("version", F.lit("0001-01-01").cast("date"))
    else:
        # One row per (origin, delisting date before it): both sides are calendar-sized.
        dates = delistings.select("delisted").distinct()
        versions = (
            marked.join(F.broadcast(dates), F.col("delisted") <= F.col("origin"), "left")
            .groupBy("k", "origin")
            .agg(F.coalesce(F.max("delisted"), F.lit("0001-01-01").cast("date")).alias("version"))
        )
    windows = stage(past_windows(versions, days, lookback), "windows")
    chain = F.pmod(F.unix_date("origin"), F.lit(28))
    end_nominal = F.unix_date("origin") - F.col("j") * 28
    placed = windows.select(
        "k", "version", "j", "base_date", "end_date",
        chain.alias("chain"), F.floor(end_nominal / F.lit(28.0)).cast("int").alias("step"),
    )
    spans = placed.select("version", "chain", "step", "base_date", "end_date").distinct()
    key = ["version", "chain", "step"]
    moved = period_returns(prices, spans, days, key).where("ret IS NOT NULL")
    if delistings is not None:
        moved = moved.join(delistings.select("symbol", "delisted"), "symbol", "left").where(
            "delisted IS NULL OR delisted > version"
        )
    ranked = quintile_targets(stage(moved.select(*key, "symbol", "ret"), "window_returns"), key, bounded=True)
    so_far = "OVER (PARTITION BY version, chain, symbol ORDER BY step)"
    nxt = "lead(step) OVER (PARTITION BY version, chain, symbol ORDER BY step)"
    running = ranked.where("n >= 5").selectExpr(
        *key, "symbol", *[f"sum({t}) {so_far} AS {t}" for t in TARGETS], f"{nxt} AS _next"
    )
    # Per origin: the running sum at its last window minus the one before its first.
    edges = placed.groupBy("k", "version", "chain").agg(
        F.max("step").alias("_last"), (F.min("step") - 1).alias("_before")
    )
    at = F.broadcast(
        edges.selectExpr("k", "version", "chain", "_last AS at", "1 AS sign").unionByName(
            edges.selectExpr("k", "version", "chain", "_before AS at", "-1 AS sign")
        )
    )
    # Each running sum is in force until the symbol's next ranked window.
    last = F.broadcast(edges.groupBy("version", "chain").agg(F.max("_last").alias("_stop")))
    in_force = running.join(last, ["version", "chain"]).selectExpr(
        "version", "chain", "symbol", *TARGETS,
        "explode(sequence(step, coalesce(_next - 1, _stop))) AS at",
    )
    signed = (
        in_force.join(at, ["version", "chain", "at"])
        .groupBy("k", "symbol")
        .agg(*[F.sum(F.col(t) * F.col("sign")).alias(t) for t in TARGETS])
    )
    total = " + ".join(f"coalesce({t}, 0D) + {alpha}D" for t in TARGETS)
    probs = members.join(signed.hint("merge"), ["k", "symbol"], "left").selectExpr(  # a row per asset and origin
        f"'{model}' AS model",
        "k",
        "symbol",
        *[
            f"CASE WHEN {total} > 0 THEN (coalesce({t}, 0D) + {alpha}D) / ({total}) ELSE 0.2D END AS {c}"
            for t, c in zip(TARGETS, RANKS)
        ],
    )
    return equal_weights(probs, ["model", "k"])


def external_forecast(
    landed: DataFrame, members: DataFrame, model: str, decisions: bool = False
) -> DataFrame:
    """Forecast files (k, ID, Rank1..5[, Decision]) of an outside method as a forecast table.

    A member without a row or a sum off by more than the rounding tolerance fails; smaller
    residues are renormalised, and a gross exposure just above 1 is scaled back.
    """
    cols = [*RANKS, *(["Decision"] if decisions else [])]
    given = landed.select("k", F.col("ID").alias("symbol"), *cols, F.lit(True).alias("_given"))
    both = members.select("k", "symbol").join(given, ["k", "symbol"], "left")
    total = f"({' + '.join(RANKS)})"
    guard = (
        f"WHEN _given IS NULL THEN double(raise_error(concat('{model} has no forecast for ', symbol)))"
        f" WHEN abs({total} - 1) > {ROUNDING}D OR {total} IS NULL THEN"
        f" double(raise_error(concat('{model} probabilities do not sum to 1: ', symbol)))"
    )
    extra = ["Decision"] if decisions else []
    probs = both.selectExpr(
        f"'{model}' AS model",
        "k",
        "symbol",
        *[f"CASE {guard} ELSE {c} / {total} END AS {c}" for c in RANKS],
        *extra,
    )
    if not decisions:
        return equal_weights(probs, ["model", "k"])
    gross = stage(probs.groupBy("model", "k").agg(F.sum(F.abs("Decision")).alias("_g")), "gross")
    return probs.join(gross, ["model", "k"]).selectExpr(
        "model", "k", "symbol", *RANKS,
        f"CASE WHEN _g > 1 AND _g <= {1 + ROUNDING}D THEN Decision / _g ELSE Decision END AS weight",
    )
