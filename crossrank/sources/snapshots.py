"""Snapshot manifest: which files belong to the wanted download, and whether they are intact."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers need no copy of this package: tasks carry these functions with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = (
    "snapshots ARRAY<STRUCT<name: STRING, downloaded: STRING, cutoff_period: STRING,"
    " cutoff_end: STRING, files: ARRAY<STRUCT<path: STRING, sha256: STRING, bytes: BIGINT>>>>"
)
MANIFEST_ROWS = (
    "name STRING, downloaded STRING, cutoff_period STRING, cutoff_end STRING,"
    " path STRING, sha256 STRING, bytes BIGINT"
)
_STEM = "regexp_replace(regexp_extract(path, '[^/]+$', 0), '[.][^.]*$', '')"
_STORED = f"regexp_replace({_STEM}, '_[^_]*$', '')"
_PIECE = 4 << 20  # bytes of a file read at once


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per snapshot."""
    document = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return document.select(F.explode("snapshots").alias("s")).select("s.*")


def snapshot(manifest: DataFrame, name: str, downloaded: str | None = None) -> DataFrame:
    """The latest snapshot of ``name`` (or the one downloaded on a date); fails when absent."""
    wanted = manifest.where(F.col("name") == name)
    if downloaded:
        wanted = wanted.where(F.col("downloaded") == downloaded)
    columns = manifest.columns
    latest = wanted.agg(F.max_by(F.struct(*columns), "downloaded").alias("s")).select("s.*")
    guard = f"CASE WHEN name IS NULL THEN raise_error('no snapshot {name}') ELSE name END AS name"
    return latest.selectExpr(guard, *[c for c in columns if c != "name"])


def snapshot_files(entry: DataFrame) -> DataFrame:
    """Files of a snapshot with their stored name: the file stem without its date suffix."""
    files = entry.select("name", "downloaded", F.explode("files").alias("f")).select(
        F.col("name").alias("snapshot"), "downloaded", "f.*"
    )
    return files.selectExpr("*", f"{_STORED} AS stored")


def read_manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of any size: JSON lines, one per file with its snapshot's name and date.

    A snapshot without files has one line without a path.
    """
    return spark.read.schema(MANIFEST_ROWS).json(path)


def listed_files(rows: DataFrame, name: str, downloaded: str | None = None) -> DataFrame:
    """The files ``snapshot_files`` gives, from manifest rows: those of the latest snapshot of
    ``name`` (or of the one downloaded on a date); fails when there is none.  No group holds
    more than one file."""
    wanted = rows.where(F.col("name") == name)
    if downloaded:
        wanted = wanted.where(F.col("downloaded") == downloaded)
    guard = f"CASE WHEN max(downloaded) IS NULL THEN raise_error('no snapshot {name}') ELSE max(downloaded) END"
    latest = wanted.agg(F.expr(f"{guard} AS downloaded"))
    files = wanted.join(F.broadcast(latest), "downloaded", "right").where("path IS NOT NULL")  # one row
    return files.selectExpr("name AS snapshot", "downloaded", "path", "sha256", "bytes", f"{_STORED} AS stored")


def _open(uri: str):
    """A byte stream of a file by its URI: local and mounted folders, or pyarrow's file systems."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        return open("/" + (rest or uri).lstrip("/"), "rb")
    from pyarrow import fs

    host, _, path = rest.lstrip("/").partition("/")
    if scheme in ("s3", "s3a", "s3n", "gs", "gcs"):  # object stores name the bucket in the path
        store, _ = fs.FileSystem.from_uri(("gs" if scheme.startswith("g") else "s3") + f"://{host}")
        return store.open_input_stream(f"{host}/{path}")
    store, _ = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store.open_input_stream(f"/{path}")


def file_digests(files: DataFrame, root: str) -> DataFrame:
    """(path, stored, sha256, actual): the SHA-256 of every listed file below ``root``, NULL when
    it is missing.

    The list is dealt over the tasks, and each reads its files in pieces of ``_PIECE`` bytes, so
    a file is never a row or a value and may have any length, none included.
    """
    spark = files.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)  # names the file system a bare path means
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")

    def digests(batches):
        import hashlib

        for batch in batches:
            found = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                try:
                    with _open(f"{base}/{path}") as stream:
                        while piece := stream.read(_PIECE):
                            digest.update(piece)
                    found.append(digest.hexdigest())
                except FileNotFoundError:
                    found.append(None)
            yield batch.assign(actual=found)

    listed = files.select("path", "stored", "sha256").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return listed.mapInPandas(digests, "path string, stored string, sha256 string, actual string")


def checksum_audit(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Manifest files missing under ``root`` or with another SHA-256 (none = intact)."""
    return file_digests(files, root).where("actual IS NULL OR actual != sha256")


def git_blob_sha(content: str = "content") -> str:
    """SQL: SHA-1 git gives a file with these bytes."""
    header = f"concat(encode(concat('blob ', octet_length({content})), 'UTF-8'), X'00')"
    return f"sha1(concat({header}, {content}))"
