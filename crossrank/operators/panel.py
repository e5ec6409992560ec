"""Price panel: long form, forward-filled by spells instead of a date x symbol matrix.

A symbol's rows are limited by the number of trading days once (symbol, date) is unique, so
windows partitioned by symbol are safe.  On a panel staged with buckets on ``symbol`` none of
them shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _by_date():
    return Window.partitionBy("symbol").orderBy("date")


def duplicate_keys(prices: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Keys that occur more than once (empty = valid panel)."""
    return (
        prices.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def require_empty(findings: DataFrame, message: str) -> None:
    """Raise ValueError when ``findings`` has a row; shows a few of them."""
    shown = findings.limit(5).collect()
    if shown:
        raise ValueError(f"{message}: {[row.asDict() for row in shown]}")


def spells(prices: DataFrame, days: DataFrame) -> DataFrame:
    """Each observed price with the trading-day range it is carried over.

    ``idx`` is the day of the observation, ``upto`` the last day before the next one (the
    last trading day of the panel for the final row).
    """
    where = days.select(F.col("day").alias("date"), "idx", "last_idx")
    order = Window.partitionBy("symbol").orderBy("idx")
    return prices.join(F.broadcast(where), "date").select(
        "symbol",
        "date",
        "price",
        "idx",
        F.coalesce(F.lead("idx").over(order) - 1, F.col("last_idx")).alias("upto"),
        F.min("idx").over(Window.partitionBy("symbol")).alias("first_idx"),
    )


def dense_grid(prices: DataFrame, days: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Every trading day from a symbol's first price on, forward-filled."""
    if symbols is not None:
        prices = prices.join(symbols.select("symbol"), "symbol", "left_semi")
    filled = spells(prices, days).select(
        "symbol", "price", F.explode(F.sequence("idx", "upto")).alias("idx")
    )
    return filled.join(
        F.broadcast(days.select("idx", F.col("day").alias("date"))), "idx"
    ).select("symbol", "date", "price", "idx")


def period_prices(prices: DataFrame, periods: DataFrame, days: DataFrame) -> DataFrame:
    """(k, symbol, date, price) on the days of each period, base day included.

    Forward-filled from the whole history.  A symbol first priced inside the period has no
    rows before that day.  Fails when a period edge is not a trading day.
    """
    inner = days.select(F.col("day"), F.col("idx"))
    edges = periods.select("k", "base_date", "end_date")
    for name in ("base", "end"):
        edges = edges.join(
            F.broadcast(
                inner.select(F.col("day").alias(f"{name}_date"), F.col("idx").alias(f"_{name}"))
            ),
            f"{name}_date",
            "left",
        )
    checked = edges.select(
        "k",
        F.when(
            F.col("_base").isNull() | F.col("_end").isNull(),
            F.raise_error(F.lit("period edges must be dates present in the price data")).cast("int"),
        )
        .otherwise(F.col("_base"))
        .alias("_base"),
        "_end",
    )
    members = checked.select("k", F.explode(F.sequence("_base", "_end")).alias("idx"))
    return (
        dense_grid(prices, days)
        .join(F.broadcast(members), "idx")
        .select("k", "symbol", "date", "price")
    )


def history_at(prices: DataFrame, dates: DataFrame, days: DataFrame) -> DataFrame:
    """What a history cut at each of ``dates`` shows of every symbol priced by then.

    Returns ``symbol``, ``date`` (the cut), ``price`` (as-of), ``last_date``, ``first_date``
    and ``n_rows``.  ``dates`` is a calendar-sized list.  Each price date falls in the slot of
    the first wanted date on or after it; the last price of a slot is an ordinary aggregate,
    and empty slots are filled from the previous one, so the history is read once for all
    cuts.
    """
    wanted = dates.select("date").distinct()
    marks = days.select(F.col("day").alias("date"), F.lit(0).alias("_is")).unionByName(
        wanted.select("date", F.lit(1).alias("_is"))
    )
    earlier = Window.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    placed = marks.select("date", "_is", F.unix_date("date").alias("_at")).select(
        "date",
        "_is",
        F.coalesce(F.sum("_is").over(earlier), F.lit(0)).cast("int").alias("slot"),
        F.sum("_is").over(Window.partitionBy()).cast("int").alias("_slots"),
    )
    targets = F.broadcast(placed.where("_is = 1").select("slot", F.col("date").alias("at")))
    day_slot = F.broadcast(placed.where("_is = 0").drop("_is"))
    last = (
        prices.join(day_slot, "date")
        .where(F.col("slot") < F.col("_slots"))
        .groupBy("symbol", "slot")
        .agg(
            F.max_by("price", "date").alias("price"),
            F.max("date").alias("last_date"),
            F.min("date").alias("_first"),
            F.count("price").alias("_rows"),
            F.max("_slots").alias("_slots"),
        )
    )
    order = Window.partitionBy("symbol").orderBy("slot")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        last.select(
            "symbol",
            "price",
            "last_date",
            "slot",
            F.min("_first").over(so_far).alias("first_date"),
            F.sum("_rows").over(so_far).alias("n_rows"),
            (F.coalesce(F.lead("slot").over(order), F.col("_slots")) - 1).alias("_upto"),
        )
        .withColumn("slot", F.explode(F.sequence("slot", "_upto")))
        .join(targets, "slot")
        .select("symbol", F.col("at").alias("date"), "price", "last_date", "first_date", "n_rows")
    )


def price_levels(prices: DataFrame, dates: DataFrame, days: DataFrame) -> DataFrame:
    """As-of price of every symbol on each of ``dates``."""
    return history_at(prices, dates, days).select("symbol", "date", "price")


def period_returns(
    prices: DataFrame, periods: DataFrame, days: DataFrame, key: list[str] | None = None
) -> DataFrame:
    """Simple return of each symbol between the two edges of each period.

    NULL when the symbol has no price on or before the base date.
    """
    key = key or ["k"]
    edges = periods.select(*key, F.col("base_date").alias("date"), F.lit(0).alias("_end")).unionByName(
        periods.select(*key, F.col("end_date").alias("date"), F.lit(1).alias("_end"))
    )
    levels = price_levels(prices, edges, days)
    both = levels.join(F.broadcast(edges), "date").groupBy("symbol", *key).agg(
        F.max(F.when(F.col("_end") == 0, F.col("price"))).alias("base_price"),
        F.max(F.when(F.col("_end") == 1, F.col("price"))).alias("end_price"),
    )
    change = F.col("end_price") - F.col("base_price")
    return both.where(F.col("end_price").isNotNull()).select(
        *key, "symbol", "base_price", "end_price", (change / F.col("base_price")).alias("ret")
    )


def daily_returns(prices: DataFrame) -> DataFrame:
    """Simple return of each observed day over the previous observed price.

    Carried days have return 0 and are left out; the first price of a symbol has NULL.
    """
    before = F.lag("price").over(_by_date())
    return prices.select(
        "symbol", "date", "price", ((F.col("price") - before) / before).alias("ret")
    )


def log_returns(prices: DataFrame) -> DataFrame:
    before = F.lag(F.ln("price")).over(_by_date())
    return prices.select(
        "symbol", "date", F.ln("price").alias("log_price"), (F.ln("price") - before).alias("log_ret")
    )
