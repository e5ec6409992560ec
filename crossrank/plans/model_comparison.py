"""Model comparison: families of tests, correlations and the headline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.operators import association as asc
from crossrank.operators import portfolio as pf
from crossrank.operators import significance as sg
from crossrank.operators.universe import with_weights
from crossrank.staging import stage


def compare(
    periods: DataFrame, after: str, blocks: dict[str, int], benchmark: str = "uniform",
    n_boot: int = 10_000, seed: int = 2026, alpha: float = 0.05,
) -> dict[str, DataFrame]:
    """Differentials, tests per family, their summary and the persistence table."""
    diffs = sg.loss_differentials(periods, benchmark)
    tested = stage(
        sg.families(diffs.where(F.col("model") != benchmark), after, blocks), "families"
    )
    tests = stage(sg.family_tests(tested, block="block", n_boot=n_boot, seed=seed), "tests")
    return {
        "periods_all": diffs,
        "significance": tests,
        "summary": sg.family_summary(tests, alpha),
        "persistence": sg.persistence(tests, alpha),
    }


def correlations_by_level(
    pairs: DataFrame, n_boot: int = 10_000, n_perm: int = 10_000, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """Spearman per (level, period), with Holm inside the family of monthly tests."""
    table = stage(
        asc.correlation(pairs, ["level", "period"], "spearman", n_boot, n_perm, level, seed),
        "correlations",
    )
    monthly = sg.adjust_pvalues(
        table.where("level = 'month'"), ["level"], "p_perm", holm="p_holm_monthly", bh=None
    ).select("level", "period", "p_holm_monthly")
    return table.join(monthly, ["level", "period"], "left")


def headline_table(tests: DataFrame, periods: DataFrame, benchmark: str = "uniform") -> DataFrame:
    """Per model: both periods and the late one, and the gain relative to the benchmark."""
    def of(family: str, tag: str, *columns: str) -> DataFrame:
        names = {"mean_rps_diff": f"rps_diff_{tag}", "p_holm": f"p_holm_{tag}",
                 "share_periods_better": f"share_better_{tag}"}
        return tests.where(F.col("family") == family).select(
            "model", *[F.col(c).alias(names[c]) for c in columns]
        )

    second = of("period2", "p2", "mean_rps_diff", "p_holm", "share_periods_better")
    base = periods.where((F.col("model") == benchmark) & (F.col("phase") == "period2")).agg(
        F.avg("rps").alias("_rps"), F.lit(1).alias("_one")
    )
    return (
        second.join(of("period1", "p1", "mean_rps_diff", "p_holm"), "model")
        .join(of("period2_late", "late", "mean_rps_diff", "p_holm"), "model")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(base), "_one")  # one row
        .withColumn("relative_gain_p2", F.expr("-rps_diff_p2 / _rps"))
        .drop("_one", "_rps")
    )


def team_headline(checks: DataFrame, summary: DataFrame) -> DataFrame:
    """Replication figures in one row: rank mismatches over all levels and the team family."""
    ranks = "mismatches_rps_rank + mismatches_ir_rank + mismatches_overall_rank"
    left = checks.agg(
        F.sum("rows").alias("rows"), F.expr(f"sum({ranks}) AS rank_mismatches"), F.lit(1).alias("_one")
    )
    return left.join(F.broadcast(summary.withColumn("_one", F.lit(1))), "_one").drop("_one")


def weighting_table(forecasts: DataFrame, prices: DataFrame, periods: DataFrame, days: DataFrame) -> DataFrame:
    """Per model and phase the pooled IR of its probabilities, weighted equally and by expected rank."""
    replayed = [
        with_weights(forecasts, ["model", "k"], w).withColumn("weighting", F.lit(w)) for w in ("equal", "expected_rank")
    ]
    table = stage(replayed[0].unionByName(replayed[1]), "weightings")
    daily = pf.daily_log_returns(table, prices, periods, days, ["model", "weighting"])
    phases = F.broadcast(periods.select("k", "phase"))  # one row per period
    ratio = {w: pf.ratio_sql(f"(CASE WHEN weighting = '{w}' THEN ret END)") for w in ("equal", "expected_rank")}
    return daily.join(phases, "k").groupBy("model", "phase").agg(*[F.expr(f"{sql} AS ir_{w}") for w, sql in ratio.items()])
