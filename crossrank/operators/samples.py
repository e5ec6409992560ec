"""Training samples: windows with features at their base and quintile targets to their end.

Windows are shared by many origins; each is computed once and origins refer to it through
the (calendar-sized) window list.  Functions named leaky or unpurged reproduce biased
procedures on purpose and are kept apart from the clean ones.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.functions.scores import TARGETS
from crossrank.operators.calendar import forward_end
from crossrank.operators.panel import period_returns
from crossrank.operators.targets import quintile_targets
from crossrank.staging import stage

MIN_ASSETS = 5

# The default hyper-parameter grid and boosting rounds.
DEFAULT_GRID = {"num_leaves": [7, 31], "min_data_in_leaf": [100, 500]}
ROUNDS = (50, 100, 200)


def window_samples(
    prices: DataFrame, windows: DataFrame, features: DataFrame, days: DataFrame
) -> DataFrame:
    """(base_date, end_date, symbol, features, targets) of the distinct windows given.

    Windows with fewer than five assets are dropped.
    """
    return with_features(window_targets(prices, windows, days), features)


def window_targets(prices: DataFrame, windows: DataFrame, days: DataFrame, buckets: int | None = None) -> DataFrame:
    """(base_date, end_date, symbol, targets) of the distinct windows with at least five assets.

    With ``buckets``, in which ``prices`` are placed by symbol, the rows stay so placed.
    """
    key = ["base_date", "end_date"]
    spans = windows.select(*key).distinct()
    named = spans.selectExpr(
        "base_date AS base", "end_date AS `end`", "base_date", "end_date"
    )
    moved = period_returns(prices, named, days, ["base", "end"]).where("ret IS NOT NULL")
    moved = moved.selectExpr("base AS base_date", "`end` AS end_date", "symbol", "ret")
    moved = stage(moved, "moves") if buckets is None else stage(moved, "moves", "symbol", buckets, placed=True)
    labelled = quintile_targets(moved, key, bounded=True).where(F.col("n") >= MIN_ASSETS)
    return labelled.select(*key, "symbol", *TARGETS)


def with_features(labelled: DataFrame, features: DataFrame) -> DataFrame:
    """Labelled windows with the features (symbol, date, ...) at their base."""
    at_base = features.withColumnRenamed("date", "base_date")
    return labelled.join(at_base, ["base_date", "symbol"], "left").select(
        "base_date", "end_date", "symbol", *_named(features), *TARGETS
    )


def _named(features: DataFrame) -> list[str]:
    """The features themselves, or what stands for them (bins)."""
    return [c for c in features.columns if c not in ("symbol", "date")]


def training_windows(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples of the past windows of each origin (purged: every window ends by the origin)."""
    uses = windows.select("k", "origin", "base_date", "end_date")
    return samples.join(F.broadcast(uses), ["base_date", "end_date"])


def split_windows(windows: DataFrame, n_val: int, embargo: int) -> DataFrame:
    """Add ``part``: the last ``n_val`` windows validate, ``embargo`` before them are dropped."""
    return windows.selectExpr(
        "*", "row_number() OVER (PARTITION BY k ORDER BY base_date DESC) AS _back"
    ).selectExpr(
        *windows.columns,
        f"CASE WHEN _back <= {n_val} THEN 'val' WHEN _back <= {n_val + embargo} THEN 'gap'"
        " ELSE 'train' END AS part",
    )


def expand_targets(samples: DataFrame) -> DataFrame:
    """One row per positive share: ``label`` 0..4 and its ``weight``."""
    cells = ", ".join(f"{q}, {t}" for q, t in enumerate(TARGETS))
    kept = [c for c in samples.columns if c not in TARGETS]
    return samples.selectExpr(*kept, f"stack(5, {cells}) AS (label, weight)").where("weight > 0")


def weekly_bases(days: DataFrame, origins: DataFrame, step: int = 5) -> DataFrame:
    """Every ``step``-th trading day and the origins, with their forward label end."""
    bases = (
        days.where(f"idx % {step} = 0")
        .selectExpr("day AS base_date")
        .union(origins.selectExpr("origin AS base_date"))
        .distinct()
    )
    return forward_end(bases, days).where("end_date IS NOT NULL")


def unpurged_past(samples: DataFrame, origins: DataFrame) -> DataFrame:
    """Leaky: samples whose base is before the origin although their label may end after it."""
    marks = F.broadcast(origins.select("k", "origin"))
    bases = samples.select("base_date").distinct()
    uses = bases.join(marks, F.col("base_date") < F.col("origin"))  # both calendar-sized
    return samples.join(F.broadcast(uses), "base_date")


def origin_rows(features: DataFrame, origins: DataFrame, members: DataFrame) -> DataFrame:
    """Feature rows to predict: every member at its origin."""
    at = F.broadcast(origins.selectExpr("k", "origin AS date"))
    rows = features.join(at, "date").select("k", "symbol", *_named(features))
    return members.select("k", "symbol").join(rows.hint("merge"), ["k", "symbol"], "left")  # a row per asset and origin


def fold_of(k: int, seed: int, *keys: str) -> str:
    """SQL: fold 0..k-1 from the row's own key, the same on every run and cluster."""
    text = ", '|', ".join(f"string({c})" for c in keys)
    return f"int(conv(substring(md5(concat({text}, '|{seed}')), 1, 8), 16, 10) % {k})"


def shuffled_folds(samples: DataFrame, k: int = 5, seed: int = 2026) -> DataFrame:
    """Leaky: rows of the whole sample spread over folds regardless of time."""
    return samples.withColumn("fold", F.expr(fold_of(k, seed, "symbol", "base_date")))


def grid_configs(grid: dict[str, list] | None = None) -> list[dict]:
    grid = grid or DEFAULT_GRID
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]


def grid_table(spark: SparkSession, grid: dict[str, list] | None = None, rounds=ROUNDS) -> DataFrame:
    """(config, parameters..., rounds): the grid crossed with the boosting rounds."""
    configs = grid_configs(grid)
    names = sorted(configs[0])
    rows = [(i, *[c[n] for n in names], r) for i, c in enumerate(configs) for r in rounds]
    return spark.createDataFrame(rows, ["config", *names, "rounds"]).selectExpr(
        "int(config) AS config", *names, "int(rounds) AS rounds"
    )


def select_candidates(scores: DataFrame, by: list[str], candidate: str, order: str | None = None) -> DataFrame:
    """Mean score per candidate with ``chosen`` on the lowest; the first by ``order`` on ties.

    ``scores`` has one ``score`` per (by, candidate, window).
    """
    order = order or candidate
    mean = scores.groupBy(*by, candidate, *([order] if order != candidate else [])).agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_windows")
    )
    best = mean.groupBy(*by).agg(
        F.min_by(candidate, F.struct("mean_score", order)).alias("_best")
    )
    return mean.join(best, by).selectExpr(
        *by, candidate, "mean_score", "n_windows", f"{candidate} = _best AS chosen"
    )
