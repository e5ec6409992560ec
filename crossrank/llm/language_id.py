"""Language identification: a bidirectional gated recurrent network over bytes.

Each direction has its own cells: update, reset and candidate gates computed from the byte (a row
of a table) and the state.  At every byte the two states give a softmax over the learned
languages; a document's probabilities are the average over all its bytes.  The network is
trained in numpy by backpropagation through time with Adam, at the driver, on a bounded sample.

* Learning: about ``per_language`` documents of each language (never above twice as many in all),
  drawn by a hash of the id; ``WINDOWS`` windows of ``WINDOW`` bytes from anywhere in each.
* Predicting: every text is read whole, cut into windows of ``WINDOW`` bytes whose states start at
  zero, so a task runs thousands of windows of many documents in one matrix product and a text of
  any length needs a bounded batch.  Documents are never shuffled.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when
nothing can be learned; one learned language gets score 1; null ids and null languages are not
learned from; rows of one id count once in the sample; equal texts score alike (to rounding;
scores have six places); ties of
probability go to the smaller name; an empty table gives no rows; only doc_id, text and lang are read, so
other columns may have any name.  Reruns agree: sample, order and start depend on ids and the seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import ship

ship(__name__)

HIDDEN = 16
WINDOW = 128
PER_LANGUAGE = 500
WINDOWS = 3
EPOCHS = 10
BATCH = 128
RATE = 0.01
ROWS_AT_ONCE = 1024  # windows in one matrix product
UNKNOWN = "und"


@dataclass
class Network:
    """``table``: (2, 256, 3H) input part of the gates; ``state``: (2, H, 3H); ``out``: (2, H, L); ``bias``: (L,)."""

    table: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    languages: list[str] = field(default_factory=list)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.table, self.state, self.out, self.bias]


def start(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    table = draw(2, 256, 3 * hidden, scale=0.3)
    table[:, :, :hidden] += 1.0  # states begin by changing slowly
    return Network(
        table, draw(2, hidden, 3 * hidden, scale=hidden**-0.5), draw(2, hidden, len(languages), scale=hidden**-0.5),
        np.zeros(len(languages), np.float32), languages,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; far below zero it is 0."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _ways(window_bytes: np.ndarray) -> np.ndarray:
    """(N, T) bytes -> (2, T, N): as read forwards and backwards, by step."""
    steps = np.ascontiguousarray(window_bytes.T)
    return np.stack([steps, steps[::-1]])


def position_probabilities(net: Network, window_bytes: np.ndarray) -> np.ndarray:
    """(N, T) bytes -> (L, T, N): the languages' probabilities at every position.

    The three gates have arrays of their own and languages come first, so every pass over memory is contiguous.
    """
    size = net.state.shape[1]
    ways = _ways(window_bytes)
    _, length, n = ways.shape
    thirds = [slice(k * size, (k + 1) * size) for k in range(3)]
    states = np.empty((length, n, 2, size), np.float32)
    update, reset, new, given = (np.empty((n, size), np.float32) for _ in range(4))
    for way in range(2):
        tables = [np.ascontiguousarray(net.table[way][:, k]) for k in thirds]
        inner = [np.ascontiguousarray(net.state[way][:, k]) for k in thirds]
        h = np.zeros((n, size), np.float32)
        for t in range(length):
            byte = ways[way, t]
            for k, gate in enumerate((update, reset, new)):
                np.matmul(h, inner[k], out=gate)
            update += tables[0].take(byte, 0, given, "clip")
            reset += tables[1].take(byte, 0, given, "clip")
            new *= _sigmoid(reset)
            new += tables[2].take(byte, 0, given, "clip")
            np.tanh(new, out=new)
            h -= new
            h *= _sigmoid(update)
            h += new
            states[t if way == 0 else length - 1 - t, :, way] = h
    logits = (states.reshape(length * n, 2 * size) @ net.out.reshape(2 * size, -1)).T + net.bias[:, None]
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits.reshape(-1, length, n)


def loss_and_gradient(net: Network, window_bytes: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
    """Mean cross entropy over the valid positions, and its gradient by backpropagation through time."""
    size = net.state.shape[1]
    ways = _ways(window_bytes)
    _, length, n = ways.shape
    both = np.arange(2)[:, None]
    shape = (length, 2, n, size)
    before, update, reset, new, own = (np.empty(shape, net.table.dtype) for _ in range(5))
    h = np.zeros((2, n, size), net.table.dtype)
    states = np.empty(shape, net.table.dtype)
    for t in range(length):
        given, inner = net.table[both, ways[:, t]], h @ net.state
        gates = _sigmoid(given[..., : 2 * size] + inner[..., : 2 * size])
        before[t], update[t], reset[t], own[t] = h, gates[..., :size], gates[..., size:], inner[..., 2 * size :]
        new[t] = np.tanh(given[..., 2 * size :] + reset[t] * own[t])
        h = new[t] + update[t] * (h - new[t])
        states[t] = h
    ahead, back = states[:, 0], states[::-1, 1]
    p = _softmax(ahead @ net.out[0] + back @ net.out[1] + net.bias)
    valid = (np.arange(length)[:, None] < sizes[None, :]).astype(p.dtype)
    total = valid.sum()
    picked = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (length, n, 1)), 2)[..., 0]
    loss = float(-(np.log(np.maximum(picked, 1e-30)) * valid).sum() / total)
    p[:, np.arange(n), labels] -= 1
    p *= valid[..., None] / total
    flat = p.reshape(-1, p.shape[-1])
    out = np.stack([ahead.reshape(-1, size).T @ flat, back.reshape(-1, size).T @ flat])
    from_out = np.stack([p @ net.out[0].T, p[::-1] @ net.out[1].T], 1)
    state, given = np.zeros_like(net.state), np.empty((length, 2, n, 3 * size), net.table.dtype)
    carried = np.zeros((2, n, size), net.table.dtype)
    turned = net.state.transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        d = carried + from_out[t]
        d_new = d * (1 - update[t]) * (1 - new[t] ** 2)
        d_update = d * (before[t] - new[t]) * update[t] * (1 - update[t])
        d_reset = d_new * own[t] * reset[t] * (1 - reset[t])
        inner = np.concatenate([d_update, d_reset, d_new * reset[t]], 2)
        state += before[t].transpose(0, 2, 1) @ inner
        carried = d * update[t] + inner @ turned
        given[t] = np.concatenate([d_update, d_reset, d_new], 2)
    table = np.zeros_like(net.table)
    for way in range(2):
        byte = ways[way].reshape(-1)
        order = np.argsort(byte, kind="stable")
        seen, first = np.unique(byte[order], return_index=True)
        table[way, seen] = np.add.reduceat(given[:, way].reshape(-1, 3 * size)[order], first)
    return loss, [table, state, out, flat.sum(0)]


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (N, window) of whole texts, zero-padded; valid bytes of each; the text of each."""
    counts = np.array([-(-len(t) // window) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(int(k) * window, b"\0") for t, k in zip(texts, counts))
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(owner), window, dtype=np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    sizes[last] = [(len(t) - 1) % window + 1 for t in texts if t]
    return np.frombuffer(joined, np.uint8).reshape(-1, window), sizes, owner


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> list:
    """(lang, window) of the sample; at most ``2 * per_language`` documents a language, all together."""
    learn = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    # One row per language: the network has an output for each of them anyway.
    counts = learn.groupBy("lang").count().collect()
    if not counts:
        return []
    rates = learn.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "of_lang string, rate double"
    )
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chosen = (
        learn.withColumn("draw", draw).join(F.broadcast(rates), F.col("lang") == F.col("of_lang"))
        .where("draw < rate").groupBy("lang", "doc_id").agg(F.min("text").alias("text"), F.min("draw").alias("draw"))
        .orderBy("draw", "doc_id", "lang").limit(2 * per_language * len(counts))
    )

    def pieces(batches):
        for batch in batches:
            langs, out = [], []
            for lang, text, place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(int(place * (1 << 30)))
                for begin in rng.integers(0, max(1, len(raw) - WINDOW + 1), windows if len(raw) > WINDOW else 1):
                    langs.append(lang)
                    out.append(raw[begin : begin + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "bytes"])

    found = chosen.select("lang", "text", "draw").mapInArrow(pieces, "lang string, bytes binary").collect()
    return sorted((r["lang"], bytes(r["bytes"])) for r in found)


def fit(rows: list, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Network | None:
    """Adam on shuffled batches, the rate falling linearly; None without rows."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    net = start(languages, hidden, seed)
    if len(languages) == 1:
        return net
    data, sizes, owner = cut([raw for _, raw in rows])
    labels = np.array([languages.index(rows[i][0]) for i in owner])
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in net.parts] for _ in range(2))
    step, steps = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, gradients = loss_and_gradient(net, data[pick], sizes[pick], labels[pick])
            now = rate * (1 - step / steps)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            for w, g, m, v in zip(net.parts, gradients, first, second):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.005 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)
    return net


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    return fit(training_windows(docs, per_language))


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, L): average of the positions' probabilities; zero rows for empty texts."""
    data, sizes, owner = cut(texts)
    sums = np.zeros((len(texts), len(net.languages)))
    steps = np.arange(data.shape[1])[:, None]
    for at in range(0, len(data), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        p = position_probabilities(net, data[part])
        p *= steps < sizes[part]
        np.add.at(sums, owner[part], p.sum(1).T)
    return sums / np.maximum([len(t) for t in texts], 1)[:, None]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score: one row per document."""
    kind = docs.schema["doc_id"].dataType
    if net is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(net.languages) == 1:
        lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return docs.select(
            "doc_id", F.when(lettered, net.languages[0]).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(lettered, 1.0).otherwise(0.0).alias("score"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(net.languages, dtype=object)
        for batch in batches:
            p = pooled(net, [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
            best, known = p.argmax(1), np.array(batch.column(1).is_valid())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                 pa.array(np.where(known, np.clip(p.max(1, initial=0.0), 0.0, 1.0).round(6), 0.0), pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    # Texts without a letter reach the network as null.
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, lang_pred string, score double")
