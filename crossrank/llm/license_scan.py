"""License scans by diagonal voting.

Every rolling word 2-gram of a text is joined, by hash and then by its words, to the positions of
the same 2-gram in the license templates.  A match at document word d and template word t votes
for diagonal d - t; votes are summed per document, template and diagonal.  A template that stands
word for word fills its diagonal; one with words added or left out spreads over neighbouring
diagonals, which are merged, and the merged span is verified: it must cover ``MIN_COVER`` of the
template's positions within a span little longer than the template.

The template table is a constant of this module, so it is the broadcast side; documents are not
shuffled for the join, and only matches are.

Texts are keyed by doc_id and a digest of the text: identical rows give identical results, and no
row number is needed.  Defined results: null or empty text has no words, no places, null first and
last words, empty labels and score 0; a text of one word has no 2-gram; texts of any length are
scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossrank.llm.common import TERM, lower_ascii
from crossrank.staging import stage

# Phrases whose places are counted, with their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Openings of license notices, with the labels the method adds.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
MIN_COVER = 0.8
GAP = 2  # diagonals this close are merged
UPPER_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_rows(phrases=PHRASES, notices=NOTICES) -> list[tuple[str, bool, int, str, int]]:
    """label, base, size, gram, position: the 2-grams of every template."""
    rows = []
    for base, templates in ((True, phrases), (False, notices)):
        for label, text in templates:
            words = text.split(" ")
            rows += [(label, base, len(words), f"{a} {b}", i) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    rows = template_rows(phrases, notices)
    return spark.createDataFrame(rows, "label string, base boolean, size int, t_gram string, t_pos int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))


def grams(docs: DataFrame) -> DataFrame:
    """doc_id, key, pos, gram: all rolling 2-grams."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    rows = _keyed(docs).select("doc_id", "key", words.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(
        F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return rows.select("doc_id", "key", F.posexplode(pairs).alias("pos", "gram"))


def votes(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per document, template and diagonal: the template positions that voted."""
    hit = grams(docs).join(
        F.broadcast(patterns), (F.xxhash64("gram") == F.xxhash64("t_gram")) & (F.col("gram") == F.col("t_gram"))
    )
    return hit.groupBy("doc_id", "key", "label", "base", "size", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("positions")
    )


def spans(diagonals: DataFrame, min_cover: float = MIN_COVER, gap: int = GAP) -> DataFrame:
    """Verified spans: doc_id, key, label, first and last word, cover."""
    start = F.col("diagonal") + F.array_min("positions")
    end = F.col("diagonal") + F.array_max("positions") + 1
    each = diagonals.withColumn("start", start).withColumn("end", end)
    order = Window.partitionBy("doc_id", "key", "label", "base").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > gap) | F.lag("diagonal").over(order).isNull()
    merged = (
        each.withColumn("island", F.sum(fresh.cast("int")).over(order))
        .groupBy("doc_id", "key", "label", "base", "size", "island")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"),
            F.min("start").alias("start"), F.max("end").alias("end"),
        )
        .drop("island")
    )
    cover = F.size("positions") / (F.col("size") - 1)
    return (
        each.select(*merged.columns).unionByName(merged)
        .withColumn("cover", cover)
        .where((F.col("cover") >= min_cover) & (F.col("end") - F.col("start") + 1 <= F.col("size") * 1.25 + 2))
        .select("doc_id", "key", "label", "start", "end", "cover")
    )


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, labels and score."""
    diagonals = stage(votes(docs, templates(docs.sparkSession, phrases, notices)), "license_votes")
    full = F.col("base") & (F.size("positions") == F.col("size") - 1)
    places = diagonals.where(full).select(
        "doc_id", "key", "label", F.col("diagonal").alias("place"), F.lit(1.0).alias("cover")
    )
    added = spans(diagonals.where("not base")).select(
        "doc_id", "key", "label", F.lit(None).cast("int").alias("place"), "cover"
    )
    found = places.unionByName(added).groupBy(F.col("doc_id").alias("id"), F.col("key").alias("text_key")).agg(
        F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("place").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = _keyed(docs).select(
        "doc_id", "key", F.regexp_count("text", F.lit(UPPER_TERM)).cast("long").alias("n_words")
    )
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
