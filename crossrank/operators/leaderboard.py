"""Team scores, leaderboards at three levels and comparisons with a benchmark team."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.operators import portfolio as pf
from crossrank.operators import targets as tg
from crossrank.operators.calendar import COMPETITION_PERIODS, period_days
from crossrank.operators.ordering import with_rank
from crossrank.operators.panel import require_empty
from crossrank.schema import RANKS
from crossrank.staging import stage

RANK_COLUMNS = ["rps_rank", "ir_rank", "overall_rank", "position"]
LEVELS = ("month", "quarter", "global")


@dataclass(frozen=True)
class Scores:
    table: DataFrame  # team, k, rps, fresh
    daily: DataFrame  # team, k, date, ret


def score_submissions(
    submissions: DataFrame, prices: DataFrame, periods: DataFrame, days: DataFrame,
    returns: DataFrame, validate: bool = True,
) -> Scores:
    """RPS, daily log returns and freshness of every active team and period.

    ``submissions`` carries the period number ``k`` of its Evaluation.  A team that lacks a
    priced symbol of a period it is scored in fails the job.
    """
    active = submissions.where("IsActive = 1").join(F.broadcast(periods.select("k")), "k", "left_semi")
    rows = active.selectExpr(
        "Team AS team", "k", "Symbol AS symbol", *RANKS, "Decision AS weight",
        "Submission = Evaluation AS fresh",
    )
    priced = returns.join(F.broadcast(periods.select("k")), "k", "left_semi")
    targets = tg.quintile_targets(priced.select("k", "symbol", "ret"), ["k"], bounded=True).drop("ret", "n")
    inside = period_days(periods, days)
    sums = {"fresh": "bool_and(CASE WHEN date IS NULL AND _real THEN fresh END)"}
    totals = stage(pf.period_totals(rows, targets, prices, inside, ["team"], sums), "team_totals")
    heads, moved = totals.where("date IS NULL"), totals.where("date IS NOT NULL")
    if validate:
        sizes = priced.groupBy("k").agg(F.count(F.lit(1)).alias("_priced"))
        short = sizes.join(heads.select("k", "_held"), "k", "left").where("_held IS NULL OR _held < _priced")
        if short.limit(1).count():
            require_empty(pf.missing_weights(rows, priced, ["team"]), "submissions lack priced symbols")
    table = heads.where("_scored > 0").selectExpr("team", "k", "_sum / _scored AS rps", "fresh")
    daily = pf.log_of_sums(moved, heads.select("team", "k"), inside, ["team"])
    return Scores(stage(table, "scores"), stage(daily.drop("is_first"), "team_daily"))


def memberships(spark, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(level, period, k, first_k, size): which evaluations each table entry pools."""
    spans = {"month": 1, "quarter": 3, "global": COMPETITION_PERIODS}
    rows = [
        (level, (k - 1) // spans[level] + 1, k, (k - 1) // spans[level] * spans[level] + 1, spans[level])
        for level in levels
        for k in range(1, COMPETITION_PERIODS + 1)
    ]
    return spark.createDataFrame(rows, "level string, period int, k int, first_k int, size int")


def summarize(
    scores: Scores, groups: DataFrame, zero_variance: float | None = None
) -> DataFrame:
    """Mean RPS and pooled IR, returns and risk of the teams scored in the first evaluation.

    A team that then misses a later evaluation fails the job.
    """
    key = ["level", "period", "team"]
    small = F.broadcast(groups)  # 36 fixed rows
    totals = (
        scores.table.join(small, "k")
        .groupBy(*key)
        .agg(
            F.avg("rps").alias("rps"),
            F.count(F.lit(1)).alias("_n"),
            F.max("size").alias("_size"),
            F.max(F.col("k") == F.col("first_k")).alias("_first"),
        )
        .where("_first")
        .selectExpr(
            *key,
            "CASE WHEN _n < _size THEN double(raise_error(concat('evaluations missing for team ', team)))"
            " ELSE rps END AS rps",
        )
    )
    pooled = pf.information_ratio(scores.daily.join(small, "k"), key, "ret", zero_variance)
    return totals.join(pooled, key).select(*key, "rps", "ir", "returns", "risk")


def rank(table: DataFrame, by: list[str]) -> DataFrame:
    """Average-tie ranks of RPS (6 decimals) and IR, their mean, and the shared position."""
    rounded = table.selectExpr(*table.columns, "bround(rps, 6) AS _rps", "-ir AS _ir")
    ranked = with_rank(rounded, by, "_rps", average="rps_rank")
    ranked = with_rank(ranked, by, "_ir", average="ir_rank")
    overall = stage(
        ranked.withColumn("overall_rank", F.expr("(rps_rank + ir_rank) / 2D")).drop("_rps", "_ir"),
        "overall",
    )
    return with_rank(overall, by, "overall_rank", low="position")


def leaderboard(scores: Scores, levels: tuple[str, ...] = LEVELS, zero_variance: float | None = 1.0,
                ranked: bool = True) -> DataFrame:
    """Leaderboard rows of the wanted levels, keyed by (level, period, team)."""
    for level in levels:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
    table = summarize(scores, memberships(scores.table.sparkSession, levels), zero_variance)
    if not ranked:
        return table
    return rank(stage(table, "summaries"), ["level", "period"])


def benchmark_table(scores: Scores, benchmark: str, compare_to: str = "global") -> DataFrame:
    """Per period and overall: shares of teams better than the benchmark, and the moments.

    ``global`` compares every period with the benchmark's overall values and counts a missing
    IR as better; ``period`` compares with the same period and leaves missing IRs out.
    """
    if compare_to not in ("global", "period"):
        raise ValueError(f"unknown reference {compare_to!r}")
    spark = scores.table.sparkSession
    table = stage(
        summarize(scores, memberships(spark, ("month", "global"))), "benchmark_rows"
    )
    overall = table.where("level = 'global'")
    mine = table.where(F.col("team") == benchmark)
    own = mine.select(
        "level", "period",
        *[F.col(c).alias(f"bench_{c}") for c in ("returns", "risk", "ir")],
    )
    ref_rows = mine.where("level = 'global'") if compare_to == "global" else mine
    ref = ref_rows.select(
        *(["level", "period"] if compare_to == "period" else [F.lit(1).alias("_one")]),
        *[F.col(c).alias(f"_{c}") for c in ("returns", "risk", "ir")],
    )
    bench_ir = mine.where("level = 'global'").select(F.lit(1).alias("_one"), F.col("ir").alias("_bench"))
    eligible = (
        overall.withColumn("_one", F.lit(1))
        .join(F.broadcast(bench_ir), "_one")  # the benchmark's single row
        .where("ir IS NULL OR _bench IS NULL OR abs(ir - _bench) > 1e-12D")
        .select("team")
    )
    rows = table.join(eligible, "team", "left_semi").withColumn("_one", F.lit(1))
    rows = rows.join(F.broadcast(ref), ["_one"] if compare_to == "global" else ["level", "period"])
    better_ir = (
        "avg(double(coalesce(ir > _ir, true)))"
        if compare_to == "global"
        else "avg(CASE WHEN ir IS NOT NULL THEN double(ir > _ir) END)"
    )
    stats = rows.groupBy("level", "period").agg(
        F.count(F.lit(1)).alias("n_teams"),
        F.expr("100D * avg(double(returns > _returns)) AS better_returns_pct"),
        F.expr("100D * avg(double(risk < _risk)) AS better_risk_pct"),
        F.expr(f"100D * {better_ir} AS better_ir_pct"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("returns", "risk", "ir")],
        *[F.stddev_samp(c).alias(f"sd_{c}") for c in ("returns", "risk", "ir")],
    )
    return stats.join(F.broadcast(own), ["level", "period"])  # 13 fixed rows


def beat_benchmark(table: DataFrame, benchmark: str) -> DataFrame:
    """How many teams of the global table beat RPS 0.16, the benchmark's IR, and both."""
    glob = table.where("level = 'global'")
    ref = glob.where(F.col("team") == benchmark).select("level", F.col("ir").alias("_ir"))
    flags = glob.join(F.broadcast(ref), "level").selectExpr(
        "bround(rps, 6) < 0.16D AS by_rps", "coalesce(ir > _ir, false) AS by_ir"
    )
    return flags.agg(
        F.count(F.lit(1)).alias("teams"),
        F.count_if("by_rps").alias("better_rps"),
        F.count_if("by_ir").alias("better_ir"),
        F.count_if(F.col("by_rps") & F.col("by_ir")).alias("both"),
    )


def compare_official(reproduced: DataFrame, code_rule: DataFrame, official: DataFrame) -> DataFrame:
    """Reproduced against official rows, full outer, with the IR under the published code."""
    key = ["level", "period", "team"]
    mine = reproduced.join(code_rule.select(*key, F.col("ir").alias("ir_code")), key)
    theirs = official.select(
        *key, *[F.col(c).alias(f"{c}_official") for c in ("rps", "ir", *RANK_COLUMNS)]
    )
    return mine.join(theirs, key, "full_outer")


def comparison_checks(compared: DataFrame) -> DataFrame:
    """Rows, rows missing on either side, largest differences and rank mismatches per level."""
    mismatches = [
        F.expr(f"count_if(coalesce({c} != {c}_official, true)) AS mismatches_{c}")
        for c in RANK_COLUMNS
    ]
    return compared.groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("rps").isNull()).alias("missing_in_reproduction"),
        F.count_if(F.col("rps_official").isNull()).alias("missing_in_official"),
        F.expr("max(abs(rps - rps_official)) AS max_abs_diff_rps"),
        F.expr("max(abs(ir - ir_official)) AS max_abs_diff_ir"),
        *mismatches,
    )


def compare_published(
    mine: DataFrame, published: DataFrame, key: list[str], decimals: dict[str, int]
) -> DataFrame:
    """Largest absolute difference per group of decimals, after rounding the computed side."""
    def melted(df: DataFrame, name: str) -> DataFrame:
        cells = ", ".join(f"'{c}', double({c})" for c in decimals)
        return df.selectExpr(*key, f"stack({len(decimals)}, {cells}) AS (cell, {name})")

    digits = mine.sparkSession.createDataFrame(list(decimals.items()), "cell string, decimals int")
    rounded = " ".join(f"WHEN {d} THEN bround(mine, {d})" for d in sorted(set(decimals.values())))
    return (
        melted(mine, "mine")
        .join(melted(published, "published"), [*key, "cell"])
        .join(F.broadcast(digits), "cell")  # one row per compared column
        .groupBy("decimals")
        .agg(
            F.expr(f"max(abs(CASE decimals {rounded} END - published)) AS max_abs_diff"),
            F.count(F.lit(1)).alias("cells"),
        )
    )
