"""Stored forms as queries: landed payloads, manifests, text stores, runs and result tables.

Every query writes rows derived from the panel in the stored form and returns what is read back.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.fragments import with_parts
from crossrank.sinks import tables as sink
from crossrank.sources import runs, snapshots, vendor
from crossrank.sources.star_schema import asset_key, panels
from crossrank.staging import shared_folder

# What a vendor sends instead of rows, and after rows it has cut.
REFUSAL = '{"error":"limit reached"}'
NOTICE = '{"warning":"rows limited"}'


def _new(spark, name):
    return f"{shared_folder(spark)}/crossrank/{name}_{uuid.uuid4().hex[:12]}"


def _landed(spark, folder):
    """One payload file per symbol: its rows in date order, at most one a day."""
    p = panels(spark, folder)
    path = _new(spark, "payloads")
    row = F.struct(
        F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "adjusted_close", "volume"
    )
    sk = asset_key(F.col("symbol"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: F.to_json(r)), ",")
    p.ohlcv.groupBy("symbol").agg(rows.alias("rows")).select(
        "symbol",
        F.when(sk % 10 == 2, F.lit(REFUSAL))
        .when(sk % 10 == 1, F.concat(F.lit("["), "rows", F.lit(f",{NOTICE}]")))
        .otherwise(F.concat(F.lit("["), "rows", F.lit("]")))
        .alias("value"),
    ).write.partitionBy("symbol").text(path)
    return vendor.payload_entries(spark.read.schema("value STRING, symbol STRING").text(path, wholetext=True))


@query(
    with_parts(
        "raw",
        """SELECT symbol, CASE WHEN symbol LIKE '%.L' THEN replace(symbol, '.L', '.LSE') ELSE symbol || '.US' END AS ticker,
        CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS entry_no, date, ROUND(open, 9) AS open, ROUND(high, 9) AS high,
        ROUND(low, 9) AS low, ROUND(close, 9) AS close, CAST(adjusted_close AS DOUBLE) AS adjusted_close, CAST(volume AS DOUBLE) AS volume
        FROM raw WHERE sk % 10 != 2""",
    )
)
def payload_rows(spark, folder):
    rows = vendor.payload_rows(_landed(spark, folder))
    return rows.withColumns({c: F.round(c, 9) for c in ("open", "high", "low", "close")})


@query(
    with_parts(
        "syms",
        f"""SELECT symbol, CASE WHEN sk % 10 = 2 THEN 'unexpected payload: {REFUSAL}' ELSE 'rows limited' END AS warning
        FROM syms WHERE sk % 10 IN (1, 2)""",
    )
)
def payload_warnings(spark, folder):
    return vendor.payload_warnings(_landed(spark, folder))


_CONTENT = "SELECT symbol, sk, symbol || ',' || COUNT(*) || ',' || MIN(date) || ',' || MAX(date) AS line FROM prices GROUP BY 1, 2"


@query(
    with_parts(
        "prices",
        f"""SELECT symbol, 'wrong digest' AS problem, repeat('0', 64) AS sha256, sha256(line || chr(10)) AS actual
        FROM ({_CONTENT}) WHERE sk % 7 = 3
        UNION ALL SELECT symbol, 'missing', sha256(line || chr(10)), NULL FROM ({_CONTENT}) WHERE sk % 11 = 4""",
    )
)
def checksum_audit(spark, folder):
    """A file per symbol; the manifest has some wrong digests and lists some files nobody stored."""
    p = panels(spark, folder)
    root, manifest = _new(spark, "snapshot"), _new(spark, "manifest")
    lines = p.prices.groupBy("symbol").agg(
        F.concat_ws(",", F.first("symbol"), F.count(F.lit(1)), F.min("date"), F.max("date")).alias("value")
    )
    lines.write.partitionBy("symbol").text(root)
    sk = asset_key(F.col("symbol"))
    digest = F.sha2(F.concat("value", F.lit("\n")), 256)
    bytes_ = (F.octet_length("value") + 1).cast("long").alias("bytes")
    stored = (
        spark.read.schema("value STRING, symbol STRING").text(root)
        .select("symbol", "value", F.substring_index("_metadata.file_path", root.rstrip("/") + "/", -1).alias("path"))
    )
    listed = stored.select("path", F.when(sk % 7 == 3, F.repeat(F.lit("0"), 64)).otherwise(digest).alias("sha256"), bytes_)
    absent = stored.where(sk % 11 == 4).select(
        F.concat(F.lit("symbol="), "symbol", F.lit("/absent.txt")).alias("path"), digest.alias("sha256"), bytes_
    )
    # A line per file; the older snapshot is an empty one.
    rows = listed.union(absent).select(
        F.lit("prices").alias("name"), F.lit(str(p.last_day)).alias("downloaded"), "path", "sha256", "bytes"
    )
    old = spark.createDataFrame([("prices", "1990-01-01")], "name STRING, downloaded STRING")
    rows.unionByName(old, allowMissingColumns=True).write.json(manifest)
    files = snapshots.listed_files(snapshots.read_manifest_rows(spark, manifest), "prices")
    audit = snapshots.checksum_audit(spark, files, root)
    return audit.select(
        F.regexp_extract("path", "symbol=([^/]+)/", 1).alias("symbol"),
        F.when(F.col("actual").isNull(), "missing").otherwise("wrong digest").alias("problem"),
        "sha256", "actual",
    )


@query(with_parts("prices", "SELECT symbol, date, price FROM prices"))
def text_store(spark, folder):
    """CSV stored as text columns, checked in both directions, then given its types."""
    path, target = _new(spark, "csv"), _new(spark, "text_store")
    panels(spark, folder).prices.select("symbol", "date", "price").write.option("header", True).csv(path)
    stored = sink.store_as_text(spark, path, target)
    return stored.selectExpr("symbol", "CAST(date AS DATE) AS date", "CAST(price AS DOUBLE) AS price")


_TOTALS = "SELECT symbol, COUNT(*) AS rows, MIN(price) AS low, MAX(price) AS high FROM prices GROUP BY 1"


def _totals(p):
    return p.prices.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("price").alias("low"), F.max("price").alias("high")
    )


@query(with_parts("prices", f"SELECT symbol, rows, low, high, TRUE AS refused FROM ({_TOTALS})"))
def immutable_run(spark, folder):
    """A stored run, and whether a second write of other rows under its name was refused."""
    p = panels(spark, folder)
    totals, root = _totals(p), _new(spark, "runs")
    run = sink.run_id(str(p.last_day), "abc1234def")
    path = sink.write_run(totals, root, run, "totals")
    try:
        sink.write_run(totals.where("rows < 0"), root, run, "totals")
        refused = False
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        refused = True
    return spark.read.schema(totals.schema).parquet(path).withColumn("refused", F.lit(refused))


@query(with_parts("prices", f"SELECT form, t.* FROM ({_TOTALS}) t, (SELECT unnest(['csv', 'json']) AS form)"))
def result_tables(spark, folder):
    totals, root = _totals(panels(spark, folder)), _new(spark, "tables")
    sink.write_tables({"totals": totals}, f"{root}/csv", "csv")
    sink.write_tables({"totals": totals}, f"{root}/json", "json")
    csv = spark.read.csv(f"{root}/csv/totals", header=True, schema=totals.schema)
    json = spark.read.schema(totals.schema).json(f"{root}/json/totals")
    return csv.withColumn("form", F.lit("csv")).unionByName(json.withColumn("form", F.lit("json")))


@query(
    with_parts(
        "syms",
        """SELECT 'core' AS "group", symbol FROM syms UNION ALL SELECT 'extended', symbol FROM syms WHERE sk % 4 = 1
        UNION ALL SELECT 'successors', 'S' || (sk + 1) || CASE WHEN (sk + 1) % 5 = 0 THEN '.L' ELSE '' END FROM syms WHERE sk % 25 = 7 AND sk % 50 != 7""",
    )
)
def symbol_groups(spark, folder):
    p = panels(spark, folder)
    path = _new(spark, "extended")
    p.symbols.where(asset_key(F.col("symbol")) % 4 == 1).select("symbol", F.lit("etf").alias("kind")).write.option(
        "header", True
    ).csv(path)
    groups = [
        vendor.group_symbols(spark, g, p.symbols, path, p.successors).select(F.lit(g).alias("group"), "symbol")
        for g in ("core", "extended", "successors")
    ]
    return groups[0].union(groups[1]).union(groups[2])


@query(
    with_parts(
        "cal",
        """SELECT phase, k, label, NULL::DATE AS base_date FROM cal WHERE phase IN ('period1', 'period2')
        UNION ALL SELECT phase, k, NULL, base_date FROM cal""",
    )
)
def harmonised_results(spark, folder):
    """Results of two runs, one naming its phase ``evaluation``."""
    p = panels(spark, folder)
    root = _new(spark, "results")
    first = sink.write_run(p.calendar.selectExpr("phase AS evaluation", "k", "label"), root, "a", "results")
    second = sink.write_run(p.calendar.select("phase", "k", "base_date"), root, "b", "results")
    return runs.harmonised([spark.read.parquet(first), spark.read.parquet(second)])
