"""Vendor price files: loads, landed API payloads, acceptance checks and symbol lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.operators.panel import require_empty

# Vendor codes that do not follow the suffix rule.
PRIMARY = {"overrides": {"RE": "EG.US"}, "london": ".LSE", "other": ".US"}
SECOND = {"overrides": {"RE": "EG"}, "london": ".L", "other": ""}

_ROW = (
    "date STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adjusted_close DOUBLE,"
    " volume DOUBLE, warning STRING"
)


def load_prices(raw: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Canonical panel from a vendor table: rows up to the cutoff, adjusted close as price."""
    if cutoff:
        raw = raw.where(F.col("date") <= F.lit(cutoff).cast("date"))
    return raw.select("symbol", "date", F.col("adjusted_close").alias("price"))


def ticker(symbol: str = "symbol", vendor: dict = PRIMARY) -> str:
    """SQL: vendor code of a symbol."""
    fixed = " ".join(f"WHEN {symbol} = '{k}' THEN '{v}'" for k, v in vendor["overrides"].items())
    return (
        f"CASE {fixed} WHEN endswith({symbol}, '.L') THEN"
        f" concat(left({symbol}, length({symbol}) - 2), '{vendor['london']}')"
        f" ELSE concat({symbol}, '{vendor['other']}') END"
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, entry_no, entry, is_list) of landed JSON payloads, one file per symbol."""
    return payload_entries(
        spark.read.text(path, wholetext=True).selectExpr(
            "value", "regexp_extract(input_file_name(), '([^/]+)[.]json$', 1) AS symbol"
        )
    )


def payload_entries(landed: DataFrame) -> DataFrame:
    """The same of payloads (symbol, value), each the whole text of a file.

    White space around the document, such as a file's last line break, is no part of it.
    """
    is_list = "startswith(value, '[')"
    document = F.regexp_replace("value", r"^\s+|\s+$", "")
    return landed.select("symbol", document.alias("value")).selectExpr(
        "symbol",
        f"{is_list} AS is_list",
        f"posexplode_outer(CASE WHEN {is_list} THEN from_json(value, 'array<string>')"
        " ELSE array(value) END) AS (entry_no, entry)",
    )


def payload_rows(entries: DataFrame) -> DataFrame:
    parsed = entries.where("is_list").select(
        "symbol", "entry_no", F.from_json("entry", _ROW).alias("r")
    )
    return parsed.where("r.date IS NOT NULL").selectExpr(
        "symbol", f"{ticker()} AS ticker", "entry_no", "to_date(r.date) AS date",
        *[f"r.{c}" for c in ("open", "high", "low", "close", "adjusted_close", "volume")],
    )


def payload_warnings(entries: DataFrame) -> DataFrame:
    """Entries without a date, or the payload itself when it is not a list."""
    parsed = entries.where("entry IS NOT NULL").select(
        "symbol", "entry_no", "is_list", "entry", F.from_json("entry", _ROW).alias("r")
    )
    return parsed.where("NOT is_list OR r.date IS NULL").selectExpr(
        "symbol",
        "CASE WHEN NOT is_list THEN concat('unexpected payload: ', entry)"
        " ELSE coalesce(r.warning, entry) END AS warning",
    )


def download_report(symbols: DataFrame, rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per requested symbol: rows, first and last date, warnings and problems of the series.

    ``rows`` keeps the payload order in ``entry_no``.
    """
    order = "OVER (PARTITION BY symbol ORDER BY entry_no)"
    marked = rows.selectExpr(
        "symbol", "date", "entry_no", "adjusted_close", f"date < lag(date) {order} AS _back"
    )
    series = marked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("date").alias("_dates"),
        F.min_by("date", "entry_no").alias("first"),
        F.max_by("date", "entry_no").alias("last"),
        F.expr("coalesce(bool_or(_back), false) AS _unsorted"),
        F.expr("coalesce(bool_or(adjusted_close <= 0), false) AS _low"),
    )
    notes = warnings.groupBy("symbol").agg(F.sort_array(F.collect_list("warning")).alias("warnings"))
    return (
        symbols.select("symbol")
        .join(series, "symbol", "left")
        .join(notes, "symbol", "left")
        .selectExpr(
            "symbol", f"{ticker()} AS ticker", "coalesce(rows, 0L) AS rows", "first", "last",
            "coalesce(warnings, CAST(array() AS ARRAY<STRING>)) AS warnings",
            "CASE WHEN rows IS NULL THEN array('no rows') ELSE filter(array("
            "CASE WHEN _dates < rows THEN 'duplicated dates' END,"
            " CASE WHEN _unsorted THEN 'dates not sorted' END,"
            " CASE WHEN _low THEN 'non-positive adjusted_close' END), p -> p IS NOT NULL) END AS problems",
        )
    )


def require_clean(report: DataFrame, strict: bool) -> None:
    """Strict groups reject the whole load when any symbol has a warning or a problem."""
    if strict:
        failed = report.where("size(warnings) > 0 OR size(problems) > 0").select("symbol", "problems")
        require_empty(failed, "load rejected")


def group_symbols(
    spark: SparkSession, group: str, core: DataFrame, extended_csv: str, successors: DataFrame
) -> DataFrame:
    """Symbols of a download group: ``core``, ``extended`` (CSV list) or ``successors``."""
    if group == "core":
        return core.select("symbol")
    if group == "extended":
        return spark.read.csv(extended_csv, header=True, schema="symbol STRING, kind STRING").select(
            "symbol"
        )
    if group == "successors":
        return successors.where("successor IS NOT NULL").select(F.col("successor").alias("symbol"))
    raise ValueError(f"unknown group {group!r}")
