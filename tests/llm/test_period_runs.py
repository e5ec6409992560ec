"""Runs against all periods tried one by one; the query's columns from their definitions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from crossrank.llm import period_runs


def every_run(words):
    """Maximal stretches for each period; a stretch belongs to its smallest period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        same = [words[i] == words[i - q] for i in range(q, len(words))] + [False]
        since = None
        for i, equal in enumerate(same):
            if equal and since is None:
                since = i
            elif not equal and since is not None:
                length = i - since + q
                if length >= max(24, 3 * q):
                    found.setdefault((since, length), q)
                since = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng, limit=200):
    words = []
    letters = rng.choice([1, 2, 2, 3, 5])
    for _ in range(rng.randrange(8)):
        piece = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        words += piece if rng.random() < 0.5 else (piece * rng.randrange(1, 9))[: rng.randrange(1, 120)]
    return words[:limit]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        words = random_words(rng)
        assert period_runs.find_runs(words) == every_run(words), words


def test_words_may_come_in_any_pieces():
    rng = random.Random(12)
    for _ in range(100):
        words, finder = random_words(rng), period_runs.RunFinder()
        at = 0
        while at < len(words):
            step = rng.randrange(1, 20)
            finder.extend(words[at : at + step])
            at += step
        assert finder.finish() == every_run(words)


@pytest.mark.parametrize("words, runs", [
    ([], []), (["a"] * 23, []), (["a"] * 24, [(0, 24, 1)]), (list("abcdefghij") * 2 + list("abcdefghi"), []),
    (list("abcdefghij") * 3, [(0, 30, 10)]), (["x"] + ["a", "b"] * 12 + ["b"], [(1, 24, 2)]),
])
def test_limits(words, runs):
    assert period_runs.find_runs(words) == runs


def test_long_and_nested():
    words = ((["a"] * 30 + ["b"]) * 4 + ["c"]) * 3
    assert period_runs.find_runs(words) == every_run(words)
    long = [str(i) for i in range(700)] * 5
    assert period_runs.find_runs(long) == [(0, 3500, 700)]


ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (None, "go " * 30), (5, "go " * 30), (5, "go " * 30),
    (6, "a b c " * 9 + "tail  x y " + "é ß 日 " * 10), (7, "x" * 40_000 + " " + "la li " * 4_000),
    *((i, " ".join(f"w{i}_{j}" for j in range(i * 7 % 90))) for i in range(10, 60)), (-5, "minus " * 5),
]


def frame(spark, rows=ROWS):
    docs = [(i, t, "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(docs, "doc_id long, text string, start string, length string, n_runs string").repartition(3)


def test_report_equals_definition(spark):
    """Every column, with the tenth of the documents whose end is rewritten."""
    def expected(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = every_run(words) if len(words) < 5000 else period_runs.find_runs(words)
        best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if runs else (None,) * 3
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (
            doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        )

    found = [tuple(r) for r in period_runs.report(frame(spark), period_runs.planted).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(found, key=key) == sorted((expected(*r) for r in ROWS), key=key)
    assert sum(r[1] for r in found) > 5


def test_spans_and_collapse(spark):
    spans = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in period_runs.spans(frame(spark)).collect()}
    assert {(5, 0, 30, 1), (None, 0, 30, 1), (6, 0, 27, 3), (7, 1, 8000, 2)} <= spans
    docs = frame(spark)
    out = period_runs.collapse(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] is None and texts[3] == " \n\t " and texts[5] == "go" and texts[7] == "x" * 40_000 + " la li"


def test_empty_table(spark):
    none = frame(spark).where("false")
    assert period_runs.report(none).count() == 0 and period_runs.spans(none).count() == 0
    assert period_runs.collapse(none).count() == 0
