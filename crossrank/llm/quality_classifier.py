"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its words, the character n-grams of each word, and one feature
for a word that repeats the one before it.  Every bucket has a learned vector; a document is the
average of its features' vectors, and a softmax layer turns that into class probabilities.  Both
are learned by stochastic gradient descent in numpy, at the driver, from at most ``max_rows``
labelled documents, each used whole (their bucket counts, not their texts, are collected).

Scoring needs no vectors: average and output layer are linear, so each bucket has one number, and
a word's sum is computed once per task and looked up afterwards.  Documents are never shuffled.

Defined results: null and empty texts have no feature and get the bias alone; without labels, or
with labels of one class only, every score is that class's smoothed share; a doc_id with several
labels takes their majority (a tie counts as 1), one with several texts the smallest of them; null
labels and ids are not learned from; repeated rows score alike; only the named columns are read.  Reruns agree: rows, order and
starting vectors depend on ids and the seed only.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import ship

ship(__name__)

BUCKETS = 1 << 14
DIM = 8
NGRAMS = (1, 2, 3)
MAX_ROWS = 4000
EPOCHS = 8
SMOOTH = 40.0  # featureless mass: very short texts stay near the bias
RATE = 0.5
CACHE = 400_000


@dataclass
class Model:
    weights: np.ndarray  # per bucket: its vector's part of the difference of the two outputs
    bias: float


def buckets_of(word: str, size: int = BUCKETS) -> list[int]:
    """The word's own bucket and those of its character n-grams (``<`` and ``>`` mark its ends)."""
    marked = f"<{word}>"
    found = [zlib.crc32(b"w " + word.encode("utf-8", "surrogatepass")) % size]
    for n in NGRAMS:
        text = word if n == 1 else marked
        found += [
            zlib.crc32(text[i : i + n].encode("utf-8", "surrogatepass")) % size for i in range(len(text) - n + 1)
        ]
    return found


def _repeat(size: int) -> int:
    return zlib.crc32(b"same word again") % size


def _counts(text: str | None, known: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = (text or "").split()
    total: dict[int, int] = {}
    for word in words:
        if (own := known.get(word)) is None:
            if len(known) > CACHE:
                known.clear()
            own = known[word] = buckets_of(word, size)
        for b in own:
            total[b] = total.get(b, 0) + 1
    if again := sum(map(operator.eq, words, words[1:])):
        total[_repeat(size)] = total.get(_repeat(size), 0) + again * 8
    return np.fromiter(total.keys(), np.int32, len(total)), np.fromiter(total.values(), np.float32, len(total))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list:
    """Bucket counts and label of a bounded, id-determined sample of the rows one may learn from."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
        .select(F.col("doc_id").alias("label_id"), "label")
    )
    # At most max_rows rows, so this side may be broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    # One row per id, the smallest text, before anything is collected.
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(batches):
        known: dict = {}
        for batch in batches:
            parts = [_counts(t, known, BUCKETS) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "buckets": [b.tobytes() for b, _ in parts], "counts": [c.tobytes() for _, c in parts],
            })

    found = rows.select("doc_id", "text", "label").mapInPandas(features, "doc_id long, label int, buckets binary, counts binary")
    return sorted(found.collect(), key=lambda r: (r["doc_id"], bytes(r["buckets"])))


def fit(rows: list, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling linearly to zero."""
    labels = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    documents = []
    for r in rows:
        b, c = np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)
        order = np.argsort(b)
        c = c[order]
        documents.append((b[order], c / (c.sum() + SMOOTH)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    step, steps = 0, epochs * len(documents)
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            now = rate * (1 - step / steps)
            step += 1
            at, weight = documents[i]
            hidden = weight @ vectors[at]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = p @ output
            output -= now * np.outer(p, hidden)
            bias -= now * 0.1 * p
            # A feature moves in proportion to its share of the text, scaled by the features present.
            vectors[at] -= np.outer(now * np.minimum(weight * len(at), 4.0), back)
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    return fit(training_rows(docs, labels, max_rows))


def scorer(model: Model):
    """A column function: text -> probability of label 1."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = len(weights)
        repeat = float(weights[_repeat(size)])

        class Known(dict):
            def __missing__(self, word):
                if len(self) > CACHE:
                    self.clear()
                self[word] = value = float(weights[buckets_of(word, size)].sum())
                return value

        known = Known()
        for series in texts:
            out = []
            for text in series:
                words = (text or "").split()
                again = 8 * sum(map(operator.eq, words, words[1:]))
                n = 2 * len(words) + len(NGRAMS) * sum(map(len, words)) + again
                total = sum(map(known.__getitem__, words)) + again * repeat
                out.append(total / (n + SMOOTH) + bias)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -40, 40))))

    return score


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    return docs.where(scorer(model)("text") >= threshold)
