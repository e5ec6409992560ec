"""Official prices preceded by rescaled vendor history, and the price input of each phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splice(history: DataFrame, official: DataFrame) -> DataFrame:
    """Official prices from each symbol's first official date, earlier history rescaled.

    The factor is the official price on that date over the history's last price on or before
    it.  Symbols only in the history keep their prices, but from the first official date on
    only on official days; official symbols without an anchor keep only official rows.
    """
    first = official.groupBy("symbol").agg(
        F.min("date").alias("first"), F.min_by("price", "date").alias("_level")
    )
    # Calendar-sized: the official days.
    days = official.select("date").distinct().withColumn("_official", F.lit(True))
    start = official.agg(F.min("date").alias("_start"), F.lit(1).alias("_one"))
    marked = history.select("symbol", "date", "price").join(first, "symbol", "left")
    anchor = (
        marked.where("date <= first").groupBy("symbol").agg(F.max_by("price", "date").alias("_anchor"))
    )
    before = (
        marked.where("date < first")
        .join(anchor, "symbol")
        .selectExpr("symbol", "date", "price * (_level / _anchor) AS price")
    )
    extra = (
        marked.where("first IS NULL")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(start), "_one")  # one row
        .join(F.broadcast(days), "date", "left")
        .where("date < _start OR _official")
        .select("symbol", "date", "price")
    )
    return official.select("symbol", "date", "price").unionByName(before).unionByName(extra)


def phase_prices(history: DataFrame, official: DataFrame) -> DataFrame:
    """(phase, symbol, date, price): period 1 is the splice, period 2 the vendor history."""
    first = splice(history, official).withColumn("phase", F.lit("period1"))
    second = history.select("symbol", "date", "price").withColumn("phase", F.lit("period2"))
    return first.unionByName(second).select("phase", "symbol", "date", "price")
