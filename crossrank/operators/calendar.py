"""Evaluation calendar: nominal 28-day grid, resolution to trading days, past windows.

Tables here are keyed by days or periods, so their size is limited by the years covered
and not by the number of assets.  That is the bound behind the broadcasts and behind the
few windows without a partition key.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 28
COMPETITION_PERIODS = 12
EXCHANGES = {".L": "LSE"}
DEFAULT_EXCHANGE = "US"

def _all_days():
    return Window.orderBy("day")



def _as_date(value: date | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(value)


def period_label(k: Column) -> Column:
    """Label of evaluation ``k`` as submissions spell it; later periods are ``P2-nn``."""
    suffix = F.when(k == 1, "st").when(k == 2, "nd").when(k == 3, "rd").otherwise("th")
    extension = (k - COMPETITION_PERIODS).cast("string")
    padded = F.when(F.length(extension) < 2, F.lpad(extension, 2, "0")).otherwise(extension)
    return (
        F.when(k == 0, F.lit("Trial run"))
        .when(k <= COMPETITION_PERIODS, F.concat(k.cast("string"), suffix, F.lit(" Submission")))
        .otherwise(F.concat(F.lit("P2-"), padded))
    )


def period_phase(k: Column) -> Column:
    return (
        F.when(k == 0, F.lit("trial"))
        .when(k <= COMPETITION_PERIODS, F.lit("period1"))
        .otherwise(F.lit("period2"))
    )


def period_grid(spark: SparkSession, origin: date | str, until: date | str) -> DataFrame:
    """Every period whose nominal end is on or before ``until``."""
    first, last = _as_date(origin), _as_date(until)
    periods = max((last - first).days // PERIOD_DAYS, 0)
    k = F.col("id").cast("int")
    base = F.date_add(F.lit(first), k * PERIOD_DAYS)
    start = F.date_add(base, 3)
    return spark.range(0, periods, 1, 1).select(
        k.alias("k"),
        period_label(k).alias("label"),
        period_phase(k).alias("phase"),
        base.alias("base"),
        start.alias("start"),
        F.date_add(base, PERIOD_DAYS).alias("end"),
        (F.date_sub(start, 1).cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")).alias(
            "deadline"
        ),
    )


def last_complete_period(spark: SparkSession, origin: date | str, download: date | str) -> DataFrame:
    """The last period whose nominal end is strictly before the download date (one row)."""
    grid = period_grid(spark, origin, _as_date(download) - timedelta(days=1))
    latest = grid.agg(F.max_by(F.struct(*grid.columns), "k").alias("p"))
    return latest.select("p.*").select(
        F.when(F.col("k").isNull(), F.raise_error(F.lit("no complete period before the download")))
        .otherwise(F.col("k"))
        .alias("k"),
        *[c for c in grid.columns if c != "k"],
    )


def trading_days(prices: DataFrame) -> DataFrame:
    """Distinct price dates with their 0-based index, neighbours and the span of the panel."""
    days = prices.select(F.col("date").alias("day")).where(F.col("day").isNotNull()).distinct()
    whole = Window.orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return days.select(
        "day",
        (F.row_number().over(_all_days()) - 1).cast("int").alias("idx"),
        F.lead("day").over(_all_days()).alias("next_day"),
        F.first("day").over(whole).alias("first_day"),
        F.last("day").over(whole).alias("last_day"),
        (F.count("day").over(whole) - 1).cast("int").alias("last_idx"),
    )


def last_day_on_or_before(nominals: DataFrame, days: DataFrame) -> DataFrame:
    """Map each date of the one-column ``nominals`` to the last trading day on or before it.

    Both sides are calendar-sized; the result serves equality joins.  ``day`` is NULL before
    the first trading day.
    """
    name = nominals.columns[0]
    asked = nominals.where(F.col(name).isNotNull()).distinct()
    marks = days.select("day", "idx", "first_day", "last_day", F.col("day").alias("_at"), F.lit(0).alias("_ask"))
    marks = marks.unionByName(
        asked.select(F.col(name).alias("_at"), F.lit(1).alias("_ask")), allowMissingColumns=True
    )
    so_far = Window.orderBy("_at", "_ask")
    return marks.select(
        F.col("_at").alias("nominal"),
        "_ask",
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("day", "idx", "first_day", "last_day")],
    ).where("_ask = 1").drop("_ask")


def resolve(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """Add ``base_date``, ``end_date`` and ``n_days`` (trading days after base up to end)."""
    edges = calendar.select("base").union(calendar.select("end"))
    asof = last_day_on_or_before(edges, days)
    out = calendar
    for name in ("base", "end"):
        out = out.join(
            F.broadcast(
                asof.select(
                    F.col("nominal").alias(name),
                    F.col("day").alias(f"{name}_date"),
                    F.col("idx").alias(f"{name}_idx"),
                )
            ),
            name,
            "left",
        )
    missing = F.raise_error(
        F.concat(F.lit("no trading day on or before "), F.col("base").cast("string"))
    )
    return out.select(
        *calendar.columns,
        F.coalesce("base_date", missing.cast("date")).alias("base_date"),
        "end_date",
        (F.col("end_idx") - F.col("base_idx")).cast("int").alias("n_days"),
    )


def period_days(periods: DataFrame, days: DataFrame) -> DataFrame:
    """(k, date, base day excluded) for every trading day of every resolved period."""
    base = days.select(F.col("day").alias("base_date"), F.col("idx").alias("_from"))
    end = days.select(F.col("day").alias("end_date"), F.col("idx").alias("_to"))
    spans = (
        periods.select("k", "base_date", "end_date")
        .join(F.broadcast(base), "base_date")
        .join(F.broadcast(end), "end_date")
        .where(F.col("_to") > F.col("_from"))
        .select("k", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("idx"))
    )
    return spans.join(F.broadcast(days.select("idx", F.col("day").alias("date"))), "idx").select(
        "k", "date", "idx"
    )


def past_windows(origins: DataFrame, days: DataFrame, lookback: int | None = None) -> DataFrame:
    """Four-week windows stepping back from each ``origin``: ``j``, ``base_date``, ``end_date``.

    Windows stop at the first one without a trading day at its start or without a trading
    day after its base.
    """
    keys = origins.columns
    start = last_day_on_or_before(origins.select("origin"), days).select(
        F.col("nominal").alias("origin"), "first_day"
    )
    steps = F.floor(F.datediff("origin", "first_day") / F.lit(float(PERIOD_DAYS))).cast("int")
    stepped = (
        origins.join(F.broadcast(start), "origin")
        .where(F.col("first_day").isNotNull())
        .select(*keys, F.explode(F.sequence(F.lit(0), steps)).alias("j"))
        .withColumn("end_nominal", F.date_sub("origin", F.col("j") * PERIOD_DAYS))
        .withColumn("base_nominal", F.date_sub("end_nominal", PERIOD_DAYS))
    )
    asof = last_day_on_or_before(
        stepped.select("end_nominal").union(stepped.select("base_nominal")), days
    )
    for name in ("base", "end"):
        stepped = stepped.join(
            F.broadcast(
                asof.select(
                    F.col("nominal").alias(f"{name}_nominal"),
                    F.col("day").alias(f"{name}_date"),
                    F.col("idx").alias(f"_{name}_idx"),
                )
            ),
            f"{name}_nominal",
            "left",
        )
    bad = F.coalesce(F.col("_end_idx") <= F.col("_base_idx"), F.lit(True))
    stop = F.min(F.when(bad, F.col("j"))).over(Window.partitionBy("origin"))
    kept = stepped.withColumn("_stop", stop).where(
        F.col("_stop").isNull() | (F.col("j") < F.col("_stop"))
    )
    if lookback is not None:
        kept = kept.where(F.col("j") < lookback)
    return kept.select(*keys, "j", "base_date", "end_date")


def forward_end(bases: DataFrame, days: DataFrame, horizon: int = PERIOD_DAYS) -> DataFrame:
    """Add ``end_date``: last trading day within ``horizon`` days, NULL past the data."""
    ahead = bases.withColumn("_nominal", F.date_add("base_date", horizon))
    asof = last_day_on_or_before(ahead.select("_nominal"), days).select(
        F.col("nominal").alias("_nominal"), F.col("day").alias("_end"), "last_day"
    )
    return ahead.join(F.broadcast(asof), "_nominal", "left").select(
        *bases.columns,
        F.when(F.col("_nominal") <= F.col("last_day"), F.col("_end")).alias("end_date"),
    )


def exchange(symbol: Column) -> Column:
    out = F.lit(DEFAULT_EXCHANGE)
    for suffix, name in EXCHANGES.items():
        out = F.when(symbol.endswith(suffix), F.lit(name)).otherwise(out)
    return out


def reference_calendars(raw: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(exchange, day) on which enough of the symbols listed so far have a price."""
    present = raw.where(F.col("close").isNotNull()).select(
        exchange(F.col("symbol")).alias("exchange"), "symbol", "date"
    )
    first = present.groupBy("exchange", "symbol").agg(F.min("date").alias("date"))
    listed = first.groupBy("exchange", "date").agg(F.count(F.lit(1)).alias("new"))
    counts = present.groupBy("exchange", "date").agg(F.countDistinct("symbol").alias("present"))
    running = Window.partitionBy("exchange").orderBy("date")  # one row per day
    return (
        counts.join(listed, ["exchange", "date"], "left")
        .withColumn("listed", F.sum(F.coalesce("new", F.lit(0))).over(running))
        .where(F.col("present") / F.col("listed") >= F.lit(float(min_share)))
        .select("exchange", F.col("date").alias("day"))
    )
