"""Schemas of the core tables and the NaN -> NULL rule applied when data enter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = ["Rank1", "Rank2", "Rank3", "Rank4", "Rank5"]

PRICES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("price", T.DoubleType()),
    ]
)

_OHLC = ["open", "high", "low", "close", "adjusted_close", "volume"]

OHLCV = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in _OHLC],
    ]
)

SUBMISSIONS = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("Team", "Submission", "Evaluation", "Symbol")],
        T.StructField("Decision", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in RANKS],
        T.StructField("IsActive", T.IntegerType()),
        T.StructField("RpsHashCode", T.LongType()),
        T.StructField("IrHashCode", T.LongType()),
    ]
)


def all_strings(names: list[str]) -> T.StructType:
    """Raw official files are stored with every column as text."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column.

    Inside the library a missing number is always NULL: Spark treats NaN as a value
    (it propagates through sums and equals itself), NULL is skipped by aggregates.
    """
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )
