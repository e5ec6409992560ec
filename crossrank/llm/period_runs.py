"""Periodic runs of words: online dyadic square catching.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are equal) and
a length of at least ``MIN_LENGTH`` and of ``EXPONENT`` periods.

The words of a text are appended one by one.  Whenever an aligned block of 8, 16, 32, ... words is
complete, a catcher of that block looks for its next occurrences: blocks of 8 for periods below 16,
blocks of B = 2^k words for periods from B to 2B - 1.  A stretch of three periods (and of 24 words)
always contains an aligned block of its size together with its copy, so no run is missed.  A
catcher waits for its first word in a dictionary; once awake, every appended word advances its
comparison by one step of the Morris-Pratt automaton of the block, so matching is exact and linear.
A hit gives a period; it is extended to the left, and from then on each appended word is compared
with the word one period before it.  Each equal word completes one more square of the stretch, all
of which merge into it; the first unequal word ends it.  Hits inside a stretch that is still
growing with a divisor of their period belong to it.  A catcher retires two blocks after its own.

State is bounded by the text: two live catchers a block size.  Documents are never shuffled or
grouped, each is read whole in one task, whatever its length.

Defined results: null and empty texts have no words, hence no runs; a null doc_id is passed on;
repeated rows give repeated results; runs of equal exponent are ranked by start, then period; an
empty table gives no rows; only doc_id and text are read, so other columns may have any name, and
``collapse`` passes them on unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import ship

ship(__name__)

MIN_LENGTH = 24
EXPONENT = 3
FIRST_BLOCK = 8  # a third of MIN_LENGTH


class Catcher:
    """Looks for the block ``text[begin : begin + size]`` in the words after it."""

    __slots__ = ("begin", "size", "matched", "fails", "live")

    def __init__(self, begin: int, size: int):
        self.begin, self.size, self.matched, self.live = begin, size, 0, True
        self.fails: list[int] | None = None

    def borders(self, text: list) -> list[int]:
        """Morris-Pratt failure links, made when a comparison first needs them."""
        if self.fails is None:
            begin, fails, k = self.begin, [0, 0], 0
            for j in range(1, self.size):
                word = text[begin + j]
                while k and text[begin + k] != word:
                    k = fails[k]
                k += text[begin + k] == word
                fails.append(k)
            self.fails = fails
        return self.fails

    def advance(self, text: list, word) -> bool:
        """One appended word; whether the block has just occurred."""
        k, begin = self.matched, self.begin
        if k > 1 and (k == self.size or text[begin + k] != word):
            fails = self.borders(text)
            k = fails[k]
            while k and text[begin + k] != word:
                k = fails[k]
        elif k == 1 and text[begin + 1] != word:
            k = 0
        self.matched = k = k + (text[begin + k] == word)
        return k == self.size


class RunFinder:
    """Append words with ``extend``, then call ``finish`` for the runs as (start, length, period)."""

    def __init__(self, min_length: int = MIN_LENGTH):
        self.min_length = min_length
        self.text: list = []
        self.waiting: dict = {}  # first word of a block -> its catchers that match nothing yet
        self.awake: list[Catcher] = []
        self.growing: list[tuple[int, int]] = []  # (period, start) of stretches up to the last word
        self.live: dict[int, list[Catcher]] = {}  # block size -> catchers, oldest first
        self.found: dict[tuple[int, int], int] = {}  # (start, length) -> smallest period

    def extend(self, words: Iterable) -> None:
        text, waiting = self.text, self.waiting
        append, first = text.append, FIRST_BLOCK - 1
        at = len(text)
        for word in words:
            append(word)
            if self.growing:
                self._grow(at, word)
            if self.awake:
                self._advance(at, word)
            if word in waiting:
                for catcher in waiting.pop(word):
                    if catcher.live:
                        catcher.matched = 1
                        self.awake.append(catcher)
            if at & first == first:
                self._complete(at + 1)
            at += 1

    def _grow(self, at: int, word) -> None:
        text = self.text
        ended = [s for s in self.growing if text[at - s[0]] != word]
        if ended:
            self.growing = [s for s in self.growing if text[at - s[0]] == word]
            for period, start in ended:
                self._end(period, start, at)

    def _end(self, period: int, start: int, end: int) -> None:
        length = end - start
        if length >= self.min_length and length >= EXPONENT * period:
            key = (start, length)
            self.found[key] = min(period, self.found.get(key, period))

    def _advance(self, at: int, word) -> None:
        text, still = self.text, []
        for catcher in self.awake:
            if not catcher.live:
                continue
            if catcher.advance(text, word):
                self._caught(catcher.begin, at + 1 - catcher.size - catcher.begin, at)
            if catcher.matched:
                still.append(catcher)
            else:
                self.waiting.setdefault(text[catcher.begin], []).append(catcher)
        self.awake = still

    def _caught(self, begin: int, period: int, at: int) -> None:
        """The block at ``begin`` occurs again one ``period`` later, ending at word ``at``."""
        for known, start in self.growing:
            if period % known == 0 and start <= begin:
                return
        text = self.text
        start = begin
        while start and text[start - 1] == text[start - 1 + period]:
            start -= 1
        self.growing.append((period, start))

    def _complete(self, end: int) -> None:
        """Catchers of the blocks that end before ``end``; those two blocks older retire."""
        text, size = self.text, FIRST_BLOCK
        while end % size == 0:
            catcher = Catcher(end - size, size)
            head = text[catcher.begin]
            if size == FIRST_BLOCK and head in text[end - size + 1 : end]:
                catcher.matched = catcher.borders(text)[size]  # periods below the block's size
            alive = self.live.setdefault(size, [])
            if len(alive) == 2:
                alive.pop(0).live = False
            alive.append(catcher)
            if catcher.matched:
                self.awake.append(catcher)
            else:
                self.waiting.setdefault(head, []).append(catcher)
            size *= 2

    def finish(self) -> list[tuple[int, int, int]]:
        """Runs by start, then period."""
        for period, start in self.growing:
            self._end(period, start, len(self.text))
        self.growing = []
        return sorted(((s, n, q) for (s, n), q in self.found.items()), key=lambda r: (r[0], r[2]))


def find_runs(words: Iterable, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    finder = RunFinder(min_length)
    finder.extend(words)
    return finder.finish()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that stay: all but those of a run after its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for start, stop in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:start]
        at = max(at, stop)
    return kept + words[at:]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def planted(doc_id: int | None, words: list) -> list:
    """The query's own test of its texts: a tenth of the documents repeat a stretch to their end."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _per_text(docs: DataFrame, schema: str, rows: Callable[[int | None, str | None], Iterator[tuple]], columns) -> DataFrame:
    """``rows(doc_id, text)`` of every document, each text read in the task that holds it."""
    def run(batches):
        for batch in batches:
            out = [row for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in rows(*pair)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(columns), columns)],
                names=[str(i) for i in range(len(columns))],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def report(docs: DataFrame, change: Callable[[int | None, list], list] = lambda doc_id, words: words) -> DataFrame:
    """One row per document: its number of runs, its strongest run, and digests of all runs and of
    the collapsed text.  ``change`` may rewrite the words of a document first."""
    def row(doc_id, text):
        words = change(doc_id, words_of(text))
        runs = find_runs(words)
        best = strongest(runs)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        kept = b" ".join(repeats(words, runs))
        yield (doc_id, len(runs), *top, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())

    whole = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return _per_text(
        whole,
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string",
        row,
        [pa.int64()] * 6 + [pa.string()] * 2,
    )


def spans(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period (in words)."""
    def rows(doc_id, text):
        return ((doc_id, *run) for run in find_runs(words_of(text)))

    whole = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return _per_text(whole, "doc_id long, start long, length long, period long", rows, [pa.int64()] * 4)


def collapse(docs: DataFrame) -> DataFrame:
    """The documents with every run cut to its first period; texts without a run stay as they are."""
    @F.pandas_udf("string")
    def collapsed(texts):
        def one(text):
            words = words_of(text)
            runs = find_runs(words)
            return b" ".join(repeats(words, runs)).decode("utf-8", "surrogatepass") if runs else text

        return texts.map(one, na_action="ignore")

    return docs.select(*[collapsed("text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
