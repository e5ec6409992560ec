"""Stored results of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRTY = "-dirty"


def latest_runs(registry: DataFrame) -> DataFrame:
    """(experiment, run): the last run of each experiment that was not made from dirty code."""
    clean = registry.where(~F.col("run").endswith(DIRTY))
    return clean.groupBy("experiment").agg(F.max("run").alias("run"))


def harmonised(tables: list[DataFrame], phases: tuple[str, ...] = ("period1", "period2")) -> DataFrame:
    """Union of result tables; an ``evaluation`` column becomes ``phase``."""
    out = None
    for table in tables:
        if "evaluation" in table.columns:
            table = table.where(F.col("evaluation").isin(*phases)).withColumnRenamed(
                "evaluation", "phase"
            )
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out
