"""Whitening against numpy on all rows at once."""

import math

import numpy as np
import pytest

from crossrank.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x string, part string, index string, z string, id string, at string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, *"abcdefg") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=8):
    width = max((len(v) for _, v in rows if v), default=0)
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows
            if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=float)
    n, sums = len(kept), [sum(v[j] for _, v in kept) for j in range(width)]
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    z = centred @ vectors / np.sqrt(np.where(values > 1e-9, values, np.nan))
    exact = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in kept]
    return kept, n, exact, z, values / np.trace(centred.T @ centred / n)


def check(found, rows, k=8):
    kept, n, exact, z, share = brute(rows, k)
    columns = min(k, z.shape[1])
    assert len(found) == n * columns
    by_id = {}
    for r in found:
        by_id.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    signs = {}
    for (i, _), dev, line in zip(kept, exact, z):
        for r in by_id[(i, dev)]:
            j = r["component"] - 1
            assert r["n"] == n and r["deviation_decimal"] == dev and abs(r["explained"] - share[j]) < 1e-9
            assert r["identity_error"] < 1e-8
            if abs(line[j]) > 1e-6:
                signs.setdefault(j, np.sign(line[j] * r["whitened"]))
            if not math.isnan(line[j]):
                assert abs(r["whitened"] * signs.get(j, 1) - line[j]) < 1e-6
    return found


def vectors(rng, n, width):
    base = rng.normal(0, 1, (n, width)) * np.linspace(0.02, 0.4, width) + rng.normal(0, 0.3, width)
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("n, width", [(700, 12), (60, 3)])
def test_against_numpy(spark, n, width):
    rows = vectors(np.random.default_rng(n), n, width)
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_many_blocks_and_slabs(spark, monkeypatch):
    """Small blocks: several slabs, whose products are added."""
    monkeypatch.setattr(whitening, "BLOCK", 12 * 16)
    monkeypatch.setattr(whitening, "SLAB", 3)
    rows = vectors(np.random.default_rng(4), 500, 12)
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_awkward_rows(spark):
    rows = vectors(np.random.default_rng(5), 80, 4)
    same = rows[3][1]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]),
           (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    rows += bad + [(300 + i, same) for i in range(40)] + [(7, rows[7][1]), (None, rows[8][1])]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert not {r["vec_id"] for r in found} & {i for i, _ in bad}
    check(found, rows)


def test_no_variance(spark):
    rows = [(i, [0.5, 0.25]) for i in range(5)]
    for r in whitening.whiten(frame(spark, rows)).collect():
        assert r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None
    line = [(i, [0.1 * i, 0.0]) for i in range(5)]
    found = whitening.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in found if r["whitened"] is None} == {2}
    assert all(r["identity_error"] < 1e-9 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_left(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.count() == 0 and out.columns[:4] == ["vec_id", "component", "n", "deviation"]
