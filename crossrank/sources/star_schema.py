"""Panels derived from the retail star schema (``lineitem``): supplier = asset.

The derivations follow FIXTURES.md.  Each one is a Spark job over the whole table; nothing
is sampled.  ``Panels`` keeps the staged tables of one data folder so that several queries
of a session read the same ones.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossrank.operators import calendar as cal
from crossrank.operators import forecasts as fc
from crossrank.operators import leaderboard as lb
from crossrank.operators import panel
from crossrank.operators import universe as un
from crossrank.plans import walk_forward as wf
from crossrank.schema import RANKS
from crossrank.staging import stage

GRID_ORIGIN = "1996-01-05"
SUBMISSION_DAYS = 112
TEAMS = 12
DELISTING_DATE = "1999-01-15"
COST_BPS = 10.0
BENCHMARK_TEAM = "T00"
BUCKET_ROWS = 400_000  # a task unfolds a bucket to its days, about four a row, and sorts them in memory


def symbol_of(key: Column) -> Column:
    name = F.concat(F.lit("S"), key.cast("string"))
    return F.when(key % 5 == 0, F.concat(name, F.lit(".L"))).otherwise(name)


def asset_key(symbol: Column) -> Column:
    return F.regexp_extract(symbol, r"^S(\d+)", 1).cast("long")


def legal_buckets(spark: SparkSession, wanted: int) -> int:
    return min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


class Panels:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _line(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lineitem.parquet")

    @cached_property
    def buckets(self) -> int:
        """About ``BUCKET_ROWS`` rows in a bucket, at least one bucket per core, and no more than Spark allows."""
        return legal_buckets(self.spark, max(self._line().count() // BUCKET_ROWS, self.spark.sparkContext.defaultParallelism))

    def _stage(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, label)

    @cached_property
    def prices(self) -> DataFrame:
        """A projection of the bucketed raw table: two numeric columns are read, not all."""
        return self.ohlcv.select("symbol", "date", F.col("level").alias("price"))

    @cached_property
    def ohlcv(self) -> DataFrame:
        """Raw price table with planted splits, stale runs and OHLC errors."""
        tick = F.round(F.col("l_discount") * 100).cast("long")
        day = (
            self._line()
            .select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_quantity")
            .groupBy("l_suppkey", "date")
            .agg(
                (F.floor(F.sum(tick) * F.lit(100.0) / F.count(F.lit(1))).cast("long") - 500).alias("step"),
                F.sum("l_quantity").alias("volume"),
            )
        )
        # Placed by symbol once: the running sum and the bucketed write share this shuffle.
        sk = F.col("l_suppkey")
        day = day.withColumn("symbol", symbol_of(sk)).repartition(self.buckets, "symbol")
        path = Window.partitionBy("symbol").orderBy("date")
        level = F.round(F.lit(100.0) * F.exp(F.sum("step").over(path) / F.lit(50000.0)), 4)
        early = F.col("date") < F.lit("1998-01-05").cast("date")
        unadjusted = F.when(early & (sk % 11 == 5), 4.0).otherwise(1.0)
        adjusted = F.when(early & (sk % 7 == 3), 4.0).otherwise(1.0)
        stale = (
            (sk % 13 == 1)
            & (F.col("date") >= F.lit("1999-03-01").cast("date"))
            & (F.col("date") <= F.lit("1999-05-31").cast("date"))
        )
        broken = (sk * 31 + F.dayofyear("date")) % 97 == 0
        raw = (
            day.withColumn("level", level)
            .withColumn("close", F.col("level") * adjusted * unadjusted)
            .withColumn(
                "adjusted_close", F.when(stale, F.lit(100.0)).otherwise(F.col("level") * unadjusted)
            )
            .withColumn("low", F.col("close") * 0.99)
            .withColumn(
                "high", F.when(broken, F.col("low") / 2).otherwise(F.col("close") * 1.01)
            )
        )
        out = raw.select(
            "symbol",
            "date",
            F.col("close").alias("open"),
            "high",
            "low",
            "close",
            "adjusted_close",
            "volume",
            "level",
        )
        return stage(out, "ohlcv", "symbol", self.buckets, placed=True)

    @cached_property
    def days(self) -> DataFrame:
        return self._stage(cal.trading_days(self.prices), "days")

    @cached_property
    def last_day(self) -> date:
        return self.days.select(F.max("last_day")).first()[0]

    @cached_property
    def n_periods(self) -> int:
        """Periods that are complete on the last trading day."""
        return max((self.last_day - date.fromisoformat(GRID_ORIGIN)).days // cal.PERIOD_DAYS, 0)

    @cached_property
    def calendar(self) -> DataFrame:
        grid = cal.period_grid(self.spark, GRID_ORIGIN, self.last_day)
        return self._stage(cal.resolve(grid, self.days), "calendar")

    @cached_property
    def origins(self) -> DataFrame:
        return self.calendar.select("k", F.col("base_date").alias("origin"))

    @cached_property
    def returns(self) -> DataFrame:
        return self._stage(panel.period_returns(self.prices, self.calendar, self.days), "returns")

    @cached_property
    def second_source(self) -> DataFrame:
        sk = asset_key(F.col("symbol"))
        dayno = F.datediff("date", F.lit("1995-01-01").cast("date"))
        noise = F.lit(1.0) + ((sk * 7 + dayno) % 5 - 2) / F.lit(100000.0)
        return self.prices.where((sk + dayno) % 17 != 0).select(
            "symbol", "date", F.round(F.col("price") * noise, 4).alias("price")
        )

    @cached_property
    def symbols(self) -> DataFrame:
        return self.prices.select("symbol").distinct()

    @cached_property
    def delistings(self) -> DataFrame:
        return self.symbols.where(asset_key(F.col("symbol")) % 25 == 7).select(
            "symbol", F.lit(DELISTING_DATE).cast("date").alias("delisted")
        )

    @cached_property
    def successors(self) -> DataFrame:
        sk = asset_key(F.col("symbol"))
        return self.delistings.select(
            "symbol", F.when(sk % 50 != 7, symbol_of(sk + 1)).alias("successor")
        )

    @cached_property
    def classes(self) -> DataFrame:
        return self.symbols.select(
            "symbol", F.concat(F.lit("class"), asset_key(F.col("symbol")) % 4).alias("class")
        )

    @cached_property
    def history_and_official(self) -> tuple[DataFrame, DataFrame]:
        start = F.lit("1998-01-05").cast("date")
        sk = asset_key(F.col("symbol"))
        history = self.prices.select(
            "symbol",
            "date",
            F.when(F.col("date") < start, F.col("price") * 3).otherwise(F.col("price")).alias("price"),
        )
        official = self.prices.where((F.col("date") >= start) & (sk % 10 != 9))
        return history, official

    @cached_property
    def _cell_parts(self) -> int:
        """About a million cells of the submissions in each part, whatever the number of assets."""
        cells = self.symbols.count() * TEAMS * max(self.n_periods, 1)
        return max(self.spark.sparkContext.defaultParallelism, cells // 1_000_000 + 1)

    @cached_property
    def submissions(self) -> DataFrame:
        """Every (team, period, symbol): band frequencies of the rows shipped in the 112 days."""
        base = F.lit(GRID_ORIGIN).cast("date")
        reach = SUBMISSION_DAYS // cal.PERIOD_DAYS
        shipped = F.col("l_shipdate").cast("date")
        slot = F.ceil(F.datediff(shipped, base) / F.lit(float(cal.PERIOD_DAYS))).cast("int")
        band = F.floor((F.col("l_quantity") - 1) / F.lit(10.0)).cast("int")
        raw = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
        # The same bounds as on the slot, on the stored column so that the scan can skip files.
        first = F.lit(GRID_ORIGIN).cast("timestamp") - F.expr(f"INTERVAL {SUBMISSION_DAYS - 1} DAYS")
        last = F.lit(GRID_ORIGIN).cast("timestamp") + F.expr(
            f"INTERVAL {cal.PERIOD_DAYS * (self.n_periods - 1) + 1} DAYS"
        )
        rows = (
            self._line()
            .where((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < last))
            .select(
                (F.col("l_partkey") % TEAMS).cast("int").alias("team"),
                F.col("l_suppkey").alias("sk"),
                slot.alias("slot"),
                band.alias("band"),
                raw.alias("raw"),
                F.lit(1).alias("one"),
            )
            .where((F.col("slot") > -reach) & (F.col("slot") < self.n_periods))
        )
        grid = self.symbols.select(
            F.explode(F.sequence(F.lit(0), F.lit(TEAMS - 1))).alias("team"),
            asset_key(F.col("symbol")).alias("sk"),
            F.lit(None).cast("int").alias("slot"),
            F.lit(None).cast("int").alias("band"),
            F.lit(0).alias("raw"),
            F.lit(0).alias("one"),
        )
        # Placed by asset once, before anything unfolds.  A row shipped in slot s counts for the
        # periods s .. s+3; a row of the grid adds nothing to any period, so that no cell is missing.
        final = F.lit(self.n_periods - 1)
        upto = F.when(F.col("slot").isNull(), final).otherwise(F.least(F.col("slot") + reach - 1, final))
        cells = (
            rows.unionByName(grid)
            .repartition(self._cell_parts, "sk")
            .select(
                "sk", "team", "band", "raw", "one",
                F.explode(F.sequence(F.greatest(F.coalesce("slot", F.lit(0)), F.lit(0)), upto)).alias("k"),
            )
            .groupBy("sk", "team", "k")
            .agg(
                *[F.count(F.when(F.col("band") == q, 1)).alias(f"c{q}") for q in range(5)],
                F.sum("raw").alias("raw"),
                F.sum("one").alias("n"),
            )
            .select("team", "k", symbol_of(F.col("sk")).alias("symbol"), *[f"c{q}" for q in range(5)], "raw", "n")
        )
        cells = self._stage(cells, "cells")
        gross = self._stage(
            cells.groupBy("team", "k").agg(F.sum(F.abs("raw")).alias("gross"), F.count(F.lit(1)).alias("assets")), "gross"
        )
        weight = F.when(F.col("gross") == 0, F.lit(1.0) / F.col("assets")).otherwise(
            F.col("raw") / F.col("gross")
        )
        team, k = F.col("team"), F.col("k")
        carried = (team + k) % 3 == 0
        # Counts are stored, not the shares made of them: they are small, and a share is one division.
        return cells.join(F.broadcast(gross), ["team", "k"]).select(  # one row per team and period
            F.concat(F.lit("T"), F.lpad(team.cast("string"), 2, "0")).alias("Team"),
            F.when(carried, cal.period_label(k - 1)).otherwise(cal.period_label(k)).alias("Submission"),
            cal.period_label(k).alias("Evaluation"),
            F.col("symbol").alias("Symbol"),
            weight.cast("double").alias("Decision"),
            *[((F.col(f"c{q}") + 1) / (F.col("n") + 5)).alias(c) for q, c in enumerate(RANKS)],
            F.when(team == TEAMS - 1, 0).otherwise(1).alias("IsActive"),
            k.alias("k"),
        )

    @cached_property
    def members(self) -> DataFrame:
        return self._stage(un.universe(self.prices, self.origins, self.days), "members")

    @cached_property
    def members_d2(self) -> DataFrame:
        out = un.universe(self.prices, self.origins, self.days, "d2", None, self.delistings)
        return self._stage(out, "members_d2")

    @cached_property
    def history_forecast(self) -> DataFrame:
        out = fc.historical_frequency(self.prices, self.origins, self.members, self.days)
        return self._stage(out, "history_forecast")

    @cached_property
    def team_forecasts(self) -> DataFrame:
        return self.submissions.select(
            F.col("Team").alias("model"), "k", F.col("Symbol").alias("symbol"), *RANKS,
            F.col("Decision").alias("weight"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Uniform, historical frequency and the twelve teams as models."""
        out = un.uniform_forecast(self.members).unionByName(self.history_forecast)
        return out.unionByName(self.team_forecasts)

    @cached_property
    def walk(self) -> wf.WalkForward:
        return wf.run(
            self.forecasts, self.prices, self.calendar, self.days, cost_bps=COST_BPS,
            members=self.members, returns=self.returns,
        )

    @cached_property
    def walk_d2(self) -> wf.WalkForward:
        """The two baselines under the universe that drops delisted symbols."""
        base = un.uniform_forecast(self.members_d2)
        hist = fc.historical_frequency(
            self.prices, self.origins, self.members_d2, self.days, self.delistings
        )
        both = base.unionByName(self._stage(hist, "history_d2"))
        return wf.run(
            both, self.prices, self.calendar, self.days, cost_bps=COST_BPS,
            members=self.members_d2, returns=self.returns,
        )

    @cached_property
    def competition(self) -> DataFrame:
        return self.calendar.where("phase = 'period1'")

    @cached_property
    def team_scores(self) -> lb.Scores:
        return lb.score_submissions(
            self.submissions, self.prices, self.competition, self.days, self.returns
        )


_PANELS: dict[tuple[str, str], Panels] = {}


def panels(spark: SparkSession, folder: str) -> Panels:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PANELS:
        _PANELS[key] = Panels(spark, folder)
    return _PANELS[key]
