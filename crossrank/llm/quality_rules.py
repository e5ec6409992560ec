"""Quality rules: measures of one document, and lines that many documents of a host repeat.

Base measures (``measures``) are functions of the text alone.  The verdict adds cross-document
line frequency: lines are normalised (A-Z lower-cased, white space collapsed) and hashed, the
documents that hold a line are counted per host, and lines above both limits are removed; a
document that keeps less than ``min_kept`` of its words is depleted and rejected.

A line is above the limits when more than ``min_docs`` documents and more than ``max_share`` of
the host's documents hold it.  A host can therefore have at most 1 / max_share times as many such
lines as its documents have lines on average, so they fit in one array per host and documents
need no second shuffle of their lines; hosts are joined by whatever size Spark measures.

Defined results: a null or empty text has no words and no lines and fails the base rules; a line
without a word is no line; every row is one document, repeated rows too; null is a host of its
own.  Very long texts and lines are used whole.  Empty tables give no rows.  ``judge`` reads doc_id,
source and text only; ``without_frequent_lines`` passes every other column on unchanged, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import SPACES, WORD, lower_ascii
from crossrank.staging import stage

SYMBOLS = r"[^#*$%&|<>]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda variable, not a repeated expression)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(lower_ascii(line), SPACES, " ")))


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """How many words stand in windows of ``width`` words that occur more than once in the text.

    Windows are sorted with their positions; equal neighbours are repeats.  Their positions, in
    order, each add the words the one before did not cover.
    """

    def windows(t):
        n = F.size(t)
        parts = [F.slice(t, i + 1, F.greatest(n - (width - 1), F.lit(0))) for i in range(width)]
        return F.transform(
            F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)]),
            lambda z, i: F.struct(F.concat_ws(" ", z["w0"], z["w1"], z["w2"]).alias("w"), i.alias("i")),
        )

    def starts(s):
        n = F.size(s)
        return F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["w"] == x["w"]))
            | ((j + 1 < n) & (F.get(s, j + 1)["w"] == x["w"])),
        )

    def covered(p):
        return F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(width), i - a["last"])).cast("long").alias("n"), i.alias("last")
            ),
            lambda a: a["n"],
        )

    repeats = _let(tokens, lambda t: _let(F.array_sort(windows(t)), starts))
    return F.coalesce(covered(F.array_sort(F.transform(repeats, lambda x: x["i"]))), F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, the base columns, and the hashes and word counts of the document's lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", "source", text.alias("text"), words(text).alias("t"), lines(text).alias("l"))
    normal = F.transform(
        F.col("l"), lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))
    )
    return parts.select(
        "doc_id",
        "source",
        F.size("t").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("t")).alias("n_repeat_words"),
        normal.alias("lines"),
    )


def frequent_lines(docs: DataFrame, min_docs: int = 5, max_share: float = 0.1) -> DataFrame:
    """Per host the hashes of its lines above both limits, and its number of documents."""
    normal = F.transform(lines(F.col("text")), line_hash)
    counts = (
        docs.select("source", F.explode(F.array_distinct(normal)).alias("h"))
        .groupBy("source", "h")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > min_docs)
        .withColumnRenamed("source", "line_source")
    )
    hosts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    above = counts.join(hosts, F.col("line_source").eqNullSafe(F.col("source"))).where(
        F.col("n") > F.col("n_docs") * max_share
    )
    return above.groupBy(F.col("source").alias("host")).agg(F.collect_list("h").alias("frequent"))


def without_frequent_lines(docs: DataFrame, min_docs: int = 5, max_share: float = 0.1) -> DataFrame:
    """The documents with the lines above the limits removed; lines without a word stay."""
    frequent = stage(frequent_lines(docs, min_docs, max_share), "frequent_lines").withColumnsRenamed(
        {"host": "__host", "frequent": "__frequent"}
    )
    rows = docs.join(frequent, docs["source"].eqNullSafe(frequent["__host"]), "left")
    gone = lambda x: x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("__frequent", line_hash(x))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~gone(x)), "\n")
    text = F.when(F.col("__frequent").isNull(), F.col("text")).otherwise(left)
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def judge(docs: DataFrame, min_docs: int = 5, max_share: float = 0.1, min_kept: float = 0.3) -> DataFrame:
    """One row per document: the base measures, the words ``without_frequent_lines`` leaves, and the verdict."""
    frequent = stage(frequent_lines(docs, min_docs, max_share), "frequent_lines")
    rows = measures(docs).join(frequent, F.col("source").eqNullSafe(F.col("host")), "left")
    removed = F.aggregate(
        F.filter("lines", lambda x: F.array_contains(F.col("frequent"), x["h"])),
        F.lit(0).cast("long"),
        lambda a, x: (a + x["n"]).cast("long"),
    )
    kept_words = F.col("n_words") - F.when(F.col("frequent").isNull(), F.lit(0).cast("long")).otherwise(removed)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.withColumn("n_kept_words", kept_words)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_kept_words") >= min_kept * F.col("n_words")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_kept_words", "base_failed", "kept",
        )
    )
