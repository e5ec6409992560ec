"""Benchmark decontamination: one automaton over the benchmark's windows, one scan of each text.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
window.  The windows become the patterns of an Aho-Corasick automaton over normalised text (A-Z
lower-cased, words joined by one space), so a document is read once however many items there are.
Matches are mapped back to word numbers and to offsets in the original text.

The benchmark is the small side: its windows are sent to the tasks in blocks of at most
``BLOCK`` windows, each with its own automaton, so a larger benchmark costs more scans and never
more memory; hits of several blocks are merged in the document's row.  Documents are not shuffled.

Defined results: a null or empty text, or one without a word, has no words and no hits; an item
without words has no window; a null item id counts as an empty string; items repeated under one id
count once; texts of any length are scanned whole; repeated rows are scanned and reported alike.
Only the columns named in the arguments are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import TERM, lower_ascii, ship
from crossrank.staging import stage

ship(__name__)

BLOCK = 200_000
WIDTH = 10
_RUN = "struct<first_word:long,last_word:long,start:long,end:long>"
# Bytes of a word keep their (lower-cased) value, all others become a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id (string), window: the distinct windows of every item."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("w"))
    last = F.greatest(F.size("w") - (width - 1), F.lit(1))
    parts = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("w", i, width), " "))
    return items.where(F.size("w") > 0).select("item_id", F.explode(parts).alias("window")).distinct()


def _automaton(patterns):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    automaton.add_word("\0", -1)  # never in normalised text; lets an empty block have an automaton
    for k, pattern in enumerate(patterns):
        automaton.add_word(f" {pattern} ", k)
    automaton.make_automaton()
    return automaton


def _matches(automaton, lengths, text):
    """Words of the text and, per match, (pattern, first word, last word)."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    normal = " " + b" ".join(words).decode("latin-1") + " "
    ends = list(automaton.iter(normal))
    if not ends:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), dtype=np.uint8) == 32)
    last = np.searchsorted(spaces, [e for e, _ in ends]) - 1
    return len(words), [(k, w - lengths[k] + 1, w) for (_, k), w in zip(ends, last.tolist())]


def _word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of every word in the original text."""
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def _merged(found: list[tuple[int, int]], text: str) -> list[dict]:
    """Runs of hit words, overlapping and touching ones merged, with their original offsets."""
    runs: list[list[int]] = []
    for first, last in sorted(found):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(last, runs[-1][1])
        else:
            runs.append([first, last])
    places = _word_offsets(text)
    return [
        {"first_word": a, "last_word": b, "start": places[a][0], "end": places[b][1]} for a, b in runs
    ]


def _blocks(benchmark: DataFrame, width: int, block: int):
    """Lists of at most ``block`` (window, item ids), read partition by partition."""
    grouped = windows(benchmark, width).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = []
    for row in grouped.toLocalIterator():
        rows.append((row["window"], list(row["items"])))
        if len(rows) == block:
            yield rows
            rows = []
    yield rows


def spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, items and hits of every document.

    ``hits`` lists merged runs of hit words as (first_word, last_word, start, end), where
    ``start`` and ``end`` are code point offsets in the original text, and ``items`` the items
    whose windows occur.
    """
    session = docs.sparkSession
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast(f"array<{_RUN}>").alias("hits"),
    )
    blocks = _blocks(benchmark, width, block)
    rows = next(blocks)
    while rows is not None:
        following = next(blocks, None)
        shared = session.sparkContext.broadcast(rows)

        def scan(batches, shared=shared, keep_text=following is not None):
            patterns = [p.encode("utf-8").decode("latin-1") for p, _ in shared.value]
            items = [i for _, i in shared.value]
            lengths = [p.count(" ") + 1 for p in patterns]
            automaton = _automaton(patterns)
            for batch in batches:
                out = []
                for doc_id, text, _, named, hits in batch.itertuples(index=False, name=None):
                    n, found = _matches(automaton, lengths, text or "")
                    if found:
                        named = sorted({*named, *(i for k in {k for k, _, _ in found} for i in items[k])})
                        hits = _merged([*((h["first_word"], h["last_word"]) for h in hits), *((a, b) for _, a, b in found)], text)
                    out.append((doc_id, text if keep_text else None, n, list(named), list(hits)))
                frame = pd.DataFrame(out, columns=["doc_id", "text", "n_words", "items", "hits"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

        state = state.mapInPandas(scan, state.schema)
        if following is not None:
            state = stage(state, "benchmark_hits")
        rows = following
    return state.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = spans(docs, benchmark, width, block)
    sizes = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last_word"] - x["first_word"] + 1)
    return found.select(
        "doc_id", "n_words", sizes.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (sizes > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    The test runs on the row itself, so repeated rows, null ids and clashing names need no join.
    """
    keyed = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("__row"))
    return _flagged(keyed, benchmark, width, block).where("hit_count = 0").select("__row.*")


def _flagged(rows: DataFrame, benchmark: DataFrame, width: int, block: int) -> DataFrame:
    session = rows.sparkSession
    state = rows.select("text", "__row", F.lit(0).cast("long").alias("hit_count"))
    for part in _blocks(benchmark, width, block):
        shared = session.sparkContext.broadcast([p for p, _ in part])

        @F.pandas_udf("long")
        def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            patterns = [p.encode("utf-8").decode("latin-1") for p in shared.value]
            automaton = _automaton(patterns)
            lengths = [p.count(" ") + 1 for p in patterns]
            for series in texts:
                yield pd.Series([len(_matches(automaton, lengths, t or "")[1]) for t in series], dtype="int64")

        state = state.withColumn("hit_count", F.col("hit_count") + hits("text"))
    return state
