"""Typed loads of the official competition files, which store every column as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.schema import RANKS, all_strings, nan_to_null

# Ticker renamed after the template was published; names of the levels.
TEMPLATE_RENAMES = {"FB": "META"}
NBSP = "\u00a0"


def _text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(all_strings(columns)).parquet(path)


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    raw = _text(spark, path, ["symbol", "date", "price"])
    return nan_to_null(
        raw.selectExpr("symbol", "to_date(date, 'yyyy/MM/dd') AS date", "double(price) AS price")
    )


def load_submissions(spark: SparkSession, path: str) -> DataFrame:
    texts = ["Team", "Submission", "Evaluation", "Symbol"]
    numbers = ["Decision", *RANKS]
    hashes = ["RpsHashCode", "IrHashCode"]
    raw = _text(spark, path, [*texts, *numbers, "IsActive", *hashes])
    return nan_to_null(
        raw.selectExpr(
            *texts,
            *[f"double({c}) AS {c}" for c in numbers],
            "int(IsActive) AS IsActive",
            *[f"try_cast(nullif({c}, '') AS BIGINT) AS {c}" for c in hashes],
        )
    )


def load_template(spark: SparkSession, path: str) -> DataFrame:
    raw = _text(spark, path, ["ID", *RANKS, "Decision"])
    renamed = raw.replace(TEMPLATE_RENAMES, subset=["ID"])
    return nan_to_null(
        renamed.selectExpr("ID", *[f"double({c}) AS {c}" for c in [*RANKS, "Decision"]])
    )


def calendar_from_days(table: DataFrame) -> DataFrame:
    """Evaluation windows from (evaluation, day): the first day is the base."""
    return table.groupBy("evaluation").agg(
        F.min("day").alias("base_date"),
        F.max("day").alias("end_date"),
        (F.count("day") - 1).cast("int").alias("n_days"),
    )


def load_leaderboard(table: DataFrame, level: str) -> DataFrame:
    """Official leaderboard rows: id and name split, numbers typed, period per level.

    ``table`` has text columns ``team`` (id, no-break space, name), the scores, the ranks
    and, except for the overall table, ``period``.
    """
    period = {"month": "int(period)", "quarter": "int(period)", "global": "1"}
    if level not in period:
        raise ValueError(f"unknown level {level!r}")
    return table.where("team IS NOT NULL").selectExpr(
        f"'{level}' AS level",
        f"{period[level]} AS period",
        f"split(team, '{NBSP}', 2)[0] AS team",
        f"coalesce(try_element_at(split(team, '{NBSP}', 2), 2), '') AS team_name",
        *[f"double({c}) AS {c}" for c in ("rps", "ir", "rps_rank", "ir_rank", "overall_rank")],
        "bigint(position) AS position",
    )
