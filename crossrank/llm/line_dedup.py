"""Line dedup: remove lines that stand on many sites.

A line is normalised (A-Z lower-cased, white space collapsed, trimmed) and hashed.  Per hash one
aggregation merges HyperLogLog sketches of the sites, so a line that a third of all documents
hold is combined in every task before it is shuffled.  A line far from the threshold is decided
by its estimate; lines near it (``band``, several times the sketch's error) get exact distinct
counts.  A line on at least ``min_sites`` sites is boilerplate.  It stays once, in the document
with the smallest id, at its first place there, and goes everywhere else, so that no text is lost.

Lines of fewer than ``min_words`` words never count as boilerplate: they recur by chance.

Defined results: a null source counts as the empty one; null and
empty texts have no lines and stay as they are; lines without a word are kept; a null id is the
smallest; rows of one id are one document, whatever their sites and texts: where it is the one that
keeps a line, they all keep it; an empty table gives no rows;
texts and lines of any length are used whole; columns other than text pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import SPACES, WORD, lower_ascii
from crossrank.staging import stage

MIN_SITES = 8
MIN_WORDS = 4
LG_K = 12  # sketch size: 4,096 registers, a relative error of about 1.6 %
BAND = 0.1


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(line), SPACES, " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key (of the text), site, h: the distinct long enough lines of every document."""
    long_enough = F.filter(
        F.transform(_lines(F.col("text")), _normal), lambda x: F.regexp_count(x, F.lit(WORD)) >= min_words
    )
    hashes = F.array_distinct(F.transform(long_enough, lambda x: F.xxhash64(x)))
    return docs.select(
        "doc_id", F.xxhash64("text").alias("key"), F.coalesce("source", F.lit("")).alias("site"), F.explode(hashes).alias("h")
    )


def boilerplate(
    hashes: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND
) -> DataFrame:
    """h, owner: the lines on at least ``min_sites`` sites and the smallest document id of each."""
    spread = stage(
        hashes.groupBy("h")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
            F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"].alias("owner"),
        )
        .where(F.col("sites") >= min_sites * (1 - band) - 1),
        "line_spread",
    )
    sure = F.col("sites") > min_sites * (1 + band) + 1
    near = spread.where(~sure).select("h", "owner")
    exact = (
        hashes.join(near, "h").select("h", "owner", "site").distinct()
        .groupBy("h", "owner").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    )
    return spread.where(sure).select("h", "owner").unionByName(exact.select("h", "owner"))


def dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K, band: float = BAND
) -> DataFrame:
    """The documents with boilerplate lines removed; adds ``n_lines`` and ``n_removed``, in place of columns of that name.

    Lines to remove are found on (document, hash) rows; each document then gets its own list, and
    only the text of the document itself is rewritten.
    """
    hashes = stage(line_hashes(docs, min_words), "line_hashes")
    found = stage(boilerplate(hashes, min_sites, lg_k, band), "boilerplate")
    marks = (
        hashes.join(found, "h")
        .groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
        .agg(
            F.collect_set(F.when(~F.col("doc_id").eqNullSafe(F.col("owner")), F.col("h"))).alias("__gone"),
            F.collect_set(F.when(F.col("doc_id").eqNullSafe(F.col("owner")), F.col("h"))).alias("__once"),
        )
    )
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    joined = keyed.join(
        marks, keyed["doc_id"].eqNullSafe(marks["__id"]) & (keyed["__text_key"] == marks["__key"]), "left"
    )
    numbered = F.transform(_lines(F.col("text")), lambda x: F.struct(x.alias("line"), F.xxhash64(_normal(x)).alias("h")))
    none = F.array().cast("array<bigint>")
    gone, once = F.coalesce("__gone", none), F.coalesce("__once", none)
    # The owner keeps the first place of a line: lines at a hash already seen are dropped.
    with_place = joined.withColumn("__lines", numbered).withColumn("__hashes", F.transform("__lines", lambda x: x["h"]))
    kept = F.filter(
        F.col("__lines"),
        lambda x, i: ~F.array_contains(gone, x["h"])
        & (~F.array_contains(once, x["h"]) | (F.array_position(F.col("__hashes"), x["h"]) == i + 1)),
    )
    out = with_place.withColumn("__kept", kept)
    n_lines, n_kept = F.size("__lines"), F.size("__kept")
    text = F.when(n_kept == n_lines, F.col("text")).otherwise(F.array_join(F.transform("__kept", lambda x: x["line"]), "\n"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in kept_columns],
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        (n_lines - n_kept).cast("long").alias("n_removed"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Documents after line dedup, without those whose every line stands elsewhere."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    out = dedup(packed, **options)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
