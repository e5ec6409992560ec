"""The network against a step-by-step reading, numeric gradients, and held-out documents."""

import random

import numpy as np
import pytest

from crossrank.llm import language_id as lid

SOUNDS = {"aa": ["tha", "ing", "sh", "ou"], "bb": ["schä", "ung", "zu", "ei"], "cc": ["eau", "çon", "ré", "ou"]}
CLASH = "langs score draw rate of_lang held_out bytes".split()


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, rows):
    data = [(i, t, lang, *CLASH) for i, t, lang in rows]
    kinds = "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame(data, f"doc_id long, text string, lang string{kinds}").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(i, prose(rng, lang), lang) for i, lang in enumerate(rng.choices(list(SOUNDS), [6, 2, 1], k=360))]
    made += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "cc"), (None, prose(rng, "aa"), "aa")]
    made += [(1003, prose(rng, "bb"), None), (1004, prose(rng, "cc", 4000), "cc"), (1005, "ß", "bb")]
    return made + [(1006, made[0][1], made[0][2])] * 400


def scalar_reading(net, text):
    """Every gate of every byte, one after the other."""
    size = net.state.shape[1]
    sig = lambda x: 1 / (1 + np.exp(-x))
    states = np.zeros((2, len(text), size))
    for way in range(2):
        h = np.zeros(size)
        for t in range(len(text)) if way == 0 else reversed(range(len(text))):
            x, u = net.table[way, text[t]].astype(float), h @ net.state[way]
            z, r = sig(x[:size] + u[:size]), sig(x[size : 2 * size] + u[size : 2 * size])
            n = np.tanh(x[2 * size :] + r * u[2 * size :])
            h = (1 - z) * n + z * h
            states[way, t] = h
    logits = states[0] @ net.out[0] + states[1] @ net.out[1] + net.bias
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_positions_equal_scalar_reading():
    net = lid.start(["a", "b", "c"], hidden=5)
    data = np.random.default_rng(1).integers(0, 256, (6, 9)).astype(np.uint8)
    found = lid.position_probabilities(net, data)
    for i, text in enumerate(data):
        assert np.abs(found[:, :, i].T - scalar_reading(net, text)).max() < 1e-5


def test_gradient_is_numeric():
    rng = np.random.default_rng(0)
    net = lid.start(["a", "b", "c"], hidden=4)
    net = lid.Network(*[w.astype(np.float64) for w in net.parts], net.languages)
    data, labels = rng.integers(97, 102, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    sizes = np.array([7, 7, 4, 7, 1])
    _, gradients = lid.loss_and_gradient(net, data, sizes, labels)
    for w, g in zip(net.parts, gradients):
        places = np.argwhere(g)
        for i in map(tuple, places[rng.integers(0, len(places), 15)]):
            old = w[i]
            w[i] = old + 1e-6
            up, _ = lid.loss_and_gradient(net, data, sizes, labels)
            w[i] = old - 1e-6
            down, _ = lid.loss_and_gradient(net, data, sizes, labels)
            w[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-7


def test_windows_cover_whole_texts():
    texts = [b"x" * n for n in (0, 1, 127, 128, 129, 1000)]
    data, sizes, owner = lid.cut(texts)
    assert [int(sizes[owner == i].sum()) for i in range(len(texts))] == [len(t) for t in texts]
    assert (data != 0).sum() == sum(map(len, texts))


def test_pooled_is_the_average_of_all_positions():
    net = lid.start(["a", "b"], hidden=6)
    texts = [bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8)) for n in (5, 300, 0, 128)]
    for text, p in zip(texts, lid.pooled(net, texts)):
        padded = text.ljust(-(-len(text) // lid.WINDOW) * lid.WINDOW, b"\0")
        parts = [scalar_reading(net, padded[i : i + lid.WINDOW]) for i in range(0, len(padded), lid.WINDOW)]
        expected = np.concatenate(parts)[: len(text)].mean(0) if text else np.zeros(2)
        assert np.abs(p - expected).max() < 1e-5


def test_held_out_documents(spark, rows):
    docs = frame(spark, rows)
    sample = lid.training_windows(docs, per_language=100)
    assert len(sample) <= 2 * 100 * 3 * lid.WINDOWS and {lang for lang, _ in sample} == set(SOUNDS)
    assert sample == lid.training_windows(docs.repartition(5), per_language=100)
    net = lid.fit(sample, hidden=8, epochs=12)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in lid.predict(docs, net).collect()]
    assert len(found) == len(rows) and all(0 <= s <= 1 for _, _, s in found)
    wanted = {i: lang for i, _, lang in rows}
    unknown = {i: (p, s) for i, p, s in found if i in (1000, 1001, 1002)}
    assert unknown == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    named = [(wanted[i], p) for i, p, _ in found if i is not None and i < 360 or i == 1004]
    assert sum(a == b for a, b in named) >= 0.97 * len(named)
    assert {p for i, p, _ in found if i == 1003} == {"bb"} and len({x for x in found if x[0] == 1006}) == 1


def test_held_out_rows_are_not_learned(spark, rows):
    import zlib

    docs = frame(spark, [(i, t, lang if i is None or zlib.crc32(str(i).encode()) % 4 != 2 else "secret") for i, t, lang in rows])
    assert "secret" not in {lang for lang, _ in lid.training_windows(docs, per_language=50)}


def test_repeated_ids_stay_within_the_bound(spark):
    docs = frame(spark, [(8, "word", "aa")] * 3000)
    assert len(lid.training_windows(docs, per_language=5000)) == 1


@pytest.mark.parametrize("rows, expected", [
    ([], []), ([(3, "text", None)], [(3, "und", 0.0)]), ([(8, "text", "xx"), (8, None, "xx")], [(8, "und", 0.0), (8, "xx", 1.0)]),
])
def test_little_to_learn_from(spark, rows, expected):
    docs = frame(spark, rows)
    found = lid.predict(docs, lid.train(docs)).collect()
    assert sorted(map(tuple, found)) == expected
