"""Writes of results and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.operators.panel import dense_grid, require_empty
from crossrank.schema import RANKS


def run_id(day: str, commit: str, dirty: bool = False) -> str:
    return f"{day}_{commit[:7]}{'-dirty' if dirty else ''}"


def store_as_text(spark: SparkSession, csv: str, target: str) -> DataFrame:
    """CSV to zstd Parquet with every column as text, checked to hold the same rows."""
    source = spark.read.csv(csv, header=True, inferSchema=False)
    source.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    stored = spark.read.schema(source.schema).parquet(target)
    require_empty(source.exceptAll(stored), "rows lost in storage")
    require_empty(stored.exceptAll(source), "rows added in storage")
    return stored


def write_run(table: DataFrame, root: str, run: str, name: str) -> str:
    """A result table below its run; an existing run is never overwritten."""
    path = f"{root.rstrip('/')}/{run}/{name}"
    table.write.mode("errorifexists").parquet(path)
    return path


def write_forecasts(forecasts: DataFrame, periods: DataFrame, target: str) -> None:
    """symbol, Rank1..5, weight, label, partitioned by model and phase.

    The rebalance splits a model's phase over several tasks and files when it is large.
    """
    labels = F.broadcast(periods.select("k", "label", "phase"))  # one row per period
    (
        forecasts.join(labels, "k")
        .select("symbol", *RANKS, "weight", "label", "k", "model", "phase")
        .hint("rebalance", "model", "phase")
        .write.mode("errorifexists")
        .partitionBy("model", "phase")
        .parquet(target)
    )


def write_tables(tables: dict[str, DataFrame], target: str, form: str = "csv") -> None:
    """Small result tables as CSV (with header) or JSON lines, one folder each."""
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if form == "csv":
            writer.option("header", True).csv(f"{target}/{name}")
        elif form == "json":
            writer.json(f"{target}/{name}")
        else:
            raise ValueError(f"unknown form {form!r}")


def export_long(
    prices: DataFrame, members: DataFrame, days: DataFrame, substitutes: dict[str, str] | None = None,
    extra: list[str] | None = None, start: str | None = None,
) -> DataFrame:
    """(date, symbol, price) handed to an outside method: forward-filled from ``start``.

    ``substitutes`` replaces a column's series by another symbol's; a missing source fails.
    """
    substitutes, extra = substitutes or {}, extra or []
    spark = prices.sparkSession
    names = members.select("symbol").distinct()
    if extra:
        names = names.union(spark.createDataFrame([(s,) for s in extra], "symbol string")).distinct()
    # Each exported column and the series it shows.
    if substitutes:
        pairs = spark.createDataFrame(list(substitutes.items()), "symbol string, source string")
        known = prices.select(F.col("symbol").alias("source")).distinct()
        require_empty(pairs.join(known, "source", "left_anti"), "substitute series not in history")
        names = names.join(pairs, "symbol", "left")
    else:
        names = names.withColumn("source", F.lit(None).cast("string"))
    shown = names.selectExpr("symbol AS target", "coalesce(source, symbol) AS symbol")
    kept = prices.join(shown.select("symbol").distinct(), "symbol", "left_semi")
    if start:
        kept = kept.where(F.col("date") >= F.lit(start).cast("date"))
    filled = dense_grid(kept, days)
    return filled.join(shown, "symbol").selectExpr("date", "target AS symbol", "price")


def export_wide(long: DataFrame, symbols: list[str]) -> DataFrame:
    """One column per symbol of a known list, in sorted order."""
    return long.groupBy("date").pivot("symbol", sorted(symbols)).agg(F.first("price"))
