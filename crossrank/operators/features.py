"""Price features at chosen dates, and their cross-sectional or leaky scalings.

Rolling windows count trading days, but only observed prices are stored.  Every signal is
rebuilt from as-of values on the trading-day index (range frames over the sparse rows), so
the dense asset x day grid is never materialised unless every day is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.operators.ordering import with_rank
from crossrank.operators.panel import spells

FEATURES = [
    "ret_5", "ret_20", "ret_60", "ret_120", "mom_250_20",
    "vol_20", "vol_60", "vol_ratio", "dist_high_250",
]
HIGH_DAYS, HIGH_MIN_DAYS = 250, 60
WHOLE_DATE = 1_000_000  # assets of a date that one task ranks; larger dates are ranked by many
NEAR_DAYS = 8  # dates that are shuffled together


def price_signals(prices: DataFrame, days: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(symbol, date, signals...) on the dates of ``at`` (column ``date``), or on every day.

    Row t uses only prices dated on or before t; a signal is NULL until its window is full.
    """
    order = "PARTITION BY symbol ORDER BY idx"
    observed = spells(prices, days).selectExpr(
        "symbol", "idx", "upto", "first_idx", "ln(price) AS lp",
        f"ln(price) - lag(ln(price)) OVER ({order}) AS r",
    ).selectExpr(
        "symbol", "idx AS own", "upto", "first_idx", "lp",
        f"coalesce(sum(r * r) OVER ({order}), 0D) AS sq",
    )
    every = observed.selectExpr("*", "explode(sequence(own, upto)) AS idx")
    if at is None:
        every = every.withColumn("_asked", F.lit(True))
    else:
        asked = days.join(at.select(F.col("date").alias("day")).distinct(), "day", "left_semi")
        every = every.join(
            F.broadcast(asked.select("idx", F.lit(True).alias("_asked"))), "idx", "left"
        ).where("_asked OR idx = own")

    def back(column: str, n: int) -> str:
        return (
            f"last({column}) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING)"
        )

    # The highest price of the last days: a sliding frame would read them again for every row.  Cut the
    # index into blocks of that length: a window is the end of one block and the start of the next.
    block = "PARTITION BY symbol, _block ORDER BY idx"
    every = every.selectExpr("*", f"idx div {HIGH_DAYS} AS _block").selectExpr(
        "*", f"max(lp) OVER ({block} DESC) AS _tail",
    ).selectExpr("*", f"max(lp) OVER ({block}) AS _head").selectExpr(
        "*", f"lead(struct(_block, _tail)) OVER ({order}) AS _next", f"max(lp) OVER ({order}) AS _ever"
    )
    lags = (5, 20, 60, 120, 250)
    state = every.selectExpr(
        "symbol", "idx", "_asked", "idx - first_idx AS age", "lp", "sq", "_block", "_head", "_ever",
        *[f"{back('lp', n)} AS lp{n}" for n in lags],
        *[f"{back('sq', n)} AS sq{n}" for n in (20, 60)],
        f"{back('lp', HIGH_DAYS - 1)} AS _carried", f"{back('_next', HIGH_DAYS)} AS _start",  # the window's first row
    ).where("_asked").selectExpr(
        "*",
        "greatest(_carried, _head, CASE WHEN _start IS NULL THEN _ever WHEN _start._block < _block THEN _start._tail END) AS high",
    )
    # Daily log returns telescope: their sum is lp - lp_n, their squares a running total.
    vol = {
        n: f"CASE WHEN age >= {n} THEN sqrt(greatest(sq - sq{n} - pow(lp - lp{n}, 2) / {n}, 0D) / {n - 1}) END"
        for n in (20, 60)
    }
    out = state.selectExpr(
        "symbol", "idx",
        *[f"lp - lp{n} AS ret_{n}" for n in (5, 20, 60, 120)],
        "lp20 - lp250 AS mom_250_20",
        f"{vol[20]} AS vol_20",
        f"{vol[60]} AS vol_60",
        f"CASE WHEN age >= {HIGH_MIN_DAYS - 1} THEN lp - high END AS dist_high_250",
    ).withColumn("vol_ratio", F.expr("try_divide(vol_20, vol_60)"))
    dates = F.broadcast(days.select("idx", F.col("day").alias("date")))
    return out.join(dates, "idx").select("symbol", "date", *FEATURES)


def cross_sectional(signals: DataFrame, decimals: int = 12, whole: int = WHOLE_DATE) -> DataFrame:
    """Each signal as its percentile rank among the assets with a value on that date.

    Values equal to ``decimals`` places are ties, so rounding noise does not order them.  A date of
    up to ``whole`` assets is ranked in one piece, all signals at once, so a row is shuffled once;
    the signals of a larger date are ranked apart, each by many tasks.
    """
    rows = signals.selectExpr("symbol", "date", *[f"round({c}, {decimals}) AS {c}" for c in FEATURES])
    sizes = signals.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole)
    large = [r["date"] for r in sizes.select("date").collect()]  # calendar-sized
    if not large:
        return _ranked_whole(rows)
    is_large = F.col("date").isin(large)
    return _ranked_whole(rows.where(~is_large)).unionByName(_ranked_apart(rows.where(is_large)))


def _ranked_whole(rows: DataFrame) -> DataFrame:
    """Percentile ranks of dates that fit a task.

    Neighbouring dates go to the same task: most signals of a symbol stay as they were the day before,
    and rows that follow each other compress to what has changed.
    """
    names = list(FEATURES)

    def ranks(date: pa.Table) -> pa.Table:
        out = [date["symbol"], date["date"]]
        for c in names:
            column = date[c].combine_chunks()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            share = np.zeros(len(known))
            _, at, ties = np.unique(column.drop_null().to_numpy(), return_inverse=True, return_counts=True)
            share[known] = ((np.cumsum(ties) - ties + (ties + 1) / 2) / known.sum())[at] if len(at) else 0.0
            out.append(pa.array(share, mask=~known))
        return pa.Table.from_arrays(out, names=["symbol", "date", *names])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_part", F.expr(f"int(pmod(unix_date(date) div {NEAR_DAYS}, {parts}))"))
    return placed.repartitionById(parts, "_part").groupBy("_part", "date").applyInArrow(ranks, rows.schema)


def _ranked_apart(rows: DataFrame) -> DataFrame:
    """Percentile ranks of dates of any size: each signal's values are placed by value ranges."""
    cells = ", ".join(f"'{c}', {c}" for c in FEATURES)
    long = rows.selectExpr("symbol", "date", f"stack({len(FEATURES)}, {cells}) AS (feature, value)")
    ranked = with_rank(
        long.where("value IS NOT NULL"), ["date", "feature"], "value", percentile="pct", bounded=True
    )
    wide = ranked.groupBy("symbol", "date").agg(
        *[F.expr(f"max(CASE WHEN feature = '{c}' THEN pct END) AS {c}") for c in FEATURES]
    )
    return rows.select("symbol", "date").join(wide, ["symbol", "date"], "left")


def naive_features(signals: DataFrame) -> DataFrame:
    """Leaky on purpose: z-scores with each symbol's full-sample mean and deviation.

    ``signals`` must hold every trading day for the statistics to be those of the sample.
    """
    whole = "OVER (PARTITION BY symbol)"  # one symbol: at most the trading days
    return signals.selectExpr(
        "symbol", "date",
        *[
            f"try_divide({c} - avg({c}) {whole}, stddev_samp({c}) {whole}) AS {c}"
            for c in FEATURES
        ],
    )
