"""All data-quality findings of one snapshot and the figures quoted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.operators import quality as ql
from crossrank.operators.calendar import reference_calendars
from crossrank.operators.ordering import exact_quantiles


def findings(
    raw: DataFrame, expected: DataFrame, start: str, cutoff: str, delistings: DataFrame,
    min_share: float = 0.5, jump_threshold: float = 0.25, stale_min_run: int = 5,
) -> dict[str, DataFrame]:
    """One table per check; write them with ``sinks.tables.write_tables``."""
    return {
        "coverage": ql.coverage(raw, expected, start, cutoff, delistings),
        "gaps": ql.gaps(raw, reference_calendars(raw, min_share)),
        "ohlc": ql.ohlc_problems(raw),
        "splits": ql.splits(raw),
        "jumps": ql.jumps(raw, jump_threshold),
        "stale": ql.stale_runs(raw, stale_min_run),
    }


def quality_kpis(raw: DataFrame) -> DataFrame:
    """Counts of findings in one row, from one pass per check."""
    def counted(df: DataFrame, name: str, test: str = "true") -> DataFrame:
        return df.agg(F.expr(f"count_if({test})").alias("n")).select(F.lit(name).alias("kpi"), "n")

    found = ql.splits(raw)
    parts = [
        counted(raw.select("symbol").distinct(), "symbols"),
        counted(found, "splits"),
        counted(found, "unadjusted_splits", "NOT adjusted"),
        counted(ql.jumps(raw), "jumps"),
        counted(ql.ohlc_problems(raw), "ohlc"),
    ]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    names = ["symbols", "splits", "unadjusted_splits", "jumps", "ohlc"]
    return table.agg(*[F.expr(f"max(CASE WHEN kpi = '{n}' THEN n END) AS {n}") for n in names])


def source_kpis(daily: DataFrame, periods: DataFrame) -> DataFrame:
    """Median over symbols of the median difference; worst and mean quintile disagreement."""
    medians = daily.where("median_abs_diff_bp IS NOT NULL").withColumn("_one", F.lit(1))
    middle = exact_quantiles(medians, ["_one"], "median_abs_diff_bp", {"median_of_medians_bp": 0.5}, bounded=True)
    shares = periods.agg(
        F.max("share_different_quintile").alias("worst_quintile_share"),
        F.avg("share_different_quintile").alias("mean_quintile_share"),
        F.count(F.lit(1)).alias("periods"),
    ).withColumn("_one", F.lit(1))
    return middle.join(F.broadcast(shares), "_one").drop("_one")  # one row each
