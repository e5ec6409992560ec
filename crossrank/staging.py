"""Intermediate tables that several stages read again.

A staged table is written once as Parquet below the shared folder named by
``spark.checkpoint.dir`` and read back.  That cuts the lineage, survives the loss of an
executor, gives the optimizer real sizes (so it broadcasts only what is small) and lets
column pruning reach the files.  With ``bucket_by`` the table is written bucketed, so
every later window or aggregation on that key needs no shuffle.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_PLACED = threading.RLock()


@contextmanager
def placed_joins(spark: SparkSession):
    """Tables staged inside join rows where they are, if both sides are placed alike by some of the keys.

    By default Spark moves both sides unless they are placed by all of them.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    with _PLACED:
        before = spark.conf.get(name)
        spark.conf.set(name, "false")
        try:
            yield
        finally:
            spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-crossrank-", dir="/tmp")
    return _FALLBACK[app]


def stage(
    df: DataFrame,
    label: str,
    bucket_by: str | None = None,
    buckets: int | None = None,
    placed: bool = False,
) -> DataFrame:
    """Write ``df`` and read it back.

    ``placed`` says the rows already sit in ``buckets`` hash partitions of ``bucket_by``, so
    the write needs no shuffle of its own.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_folder(spark)}/crossrank/{name}"
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets or spark.sparkContext.defaultParallelism
    rows = df if placed else df.repartition(n, bucket_by)
    (
        rows.write.bucketBy(n, bucket_by)
        .sortBy(bucket_by)
        .format("parquet")
        .option("path", path)
        .saveAsTable(name)
    )
    return spark.table(name)
