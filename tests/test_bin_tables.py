"""The bin-table learner against a row-by-row reading, its prefixes, its search and the cascade on it."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from crossrank.functions.scores import TARGETS
from crossrank.operators import bin_tables as bt
from crossrank.operators import samples as sm
from crossrank.operators import targets as tg
from crossrank.operators.features import FEATURES
from crossrank.plans import cascade as cs
from crossrank.schema import RANKS
from crossrank.staging import stage

GRID = bt.Grid(bins=(2, 5), smoothing=(3.0, 40.0), rounds=(1, 9, 18))


def made(n_windows=8, n_symbols=14, seed=1):
    """Windows of four weeks whose first feature drives the target, with gaps in the others."""
    rng = np.random.default_rng(seed)
    bases = pd.date_range("2020-01-03", periods=n_windows + 1, freq="28D")
    rows = []
    for base, end in zip(bases, bases[1:]):
        for s in range(n_symbols):
            x = rng.random(len(FEATURES))
            share = np.zeros(5)
            share[min(4, int(5 * x[0]))] = 1.0
            if s % 4 == 0:
                share = share / 2 + np.eye(5)[rng.integers(5)] / 2
            values = [None if rng.random() < 0.1 and j else float(v) for j, v in enumerate(x)]
            rows.append((base.date(), end.date(), f"A{s:02d}", *values, *map(float, share)))
    return rows


SCHEMA = "base_date date, end_date date, symbol string, " + ", ".join(f"{c} double" for c in [*FEATURES, *TARGETS])


def cell_of(values, table, bins):
    code = 0
    for i in table:
        v = values[i]
        b = bins if v is None else int(max(0, min(bins - 1, math.floor(v * bins))))
        code = code * (bins + 1) + b
    return code


def one_by_one(train, values, bins, smoothing, rounds):
    shares = []
    for table in bt.TABLES[:rounds]:
        own = cell_of(values, table, bins)
        same = [r for r in train if cell_of(r[3 : 3 + len(FEATURES)], table, bins) == own]
        total = np.sum([r[-5:] for r in same], axis=0) if same else np.zeros(5)
        shares.append((total + 0.2 * smoothing) / (len(same) + smoothing))
    return np.mean(shares, axis=0)


def uses_of(spark, rows, ks):
    """Origin k trains on the windows that end by the k-th base."""
    bases = sorted({r[:2] for r in rows})
    return spark.createDataFrame([(k, *w) for k in ks for w in bases[:k]], "k int, base_date date, end_date date")


def test_forecasts_equal_a_reading_row_by_row(spark):
    rows = made()
    samples = stage(spark.createDataFrame(rows, SCHEMA).repartition(3), "bt_samples")
    uses = uses_of(spark, rows, (3, 6))
    bases = sorted({r[0] for r in rows})
    tests = spark.createDataFrame([(k, *r[2 : 3 + len(FEATURES)]) for k in (3, 6) for r in rows if r[0] == bases[k]],
                                  "k int, symbol string, " + ", ".join(f"{c} double" for c in FEATURES))
    tables = bt.fitted(bt.cell_counts(samples, cs.WINDOW, GRID, "ranks"), uses, cs.WINDOW, ["k"])
    got = bt.predicted(tests, ["k", "symbol"], ["k"], tables, GRID, "ranks").collect()
    assert len(got) == 2 * 14 * 4 * 18
    values = {(k, r[2]): r[3 : 3 + len(FEATURES)] for k in (3, 6) for r in rows if r[0] == bases[k]}
    configs = {i: (b, a) for i, b, a in GRID.configs()}
    for r in random.Random(1).sample(got, 300):
        train = [x for x in rows if x[0] < bases[r["k"]]]
        bins, smoothing = configs[r["config"]]
        want = one_by_one(train, values[(r["k"], r["symbol"])], bins, smoothing, r["rounds"])
        assert [r[c] for c in RANKS] == pytest.approx(want, abs=1e-12)


def test_each_prefix_equals_a_fit_of_its_own(spark, monkeypatch):
    rows = made()
    samples = stage(spark.createDataFrame(rows, SCHEMA), "bt_samples")
    uses, search = uses_of(spark, rows, (5,)), cs.Search(grid=GRID)
    tests = samples.where("base_date = date'2020-06-19'").selectExpr("5 AS k", "symbol", *FEATURES)
    key = ["config", "rounds", "k", "symbol"]
    whole = cs.walk_candidates(samples, uses, tests, search, "ranks").toPandas().set_index(key)
    for n in (1, 9):
        monkeypatch.setattr(bt, "TABLES", bt.TABLES[:n] if n == 1 else list(ALL[:n]))
        short = cs.Search(grid=bt.Grid(GRID.bins, GRID.smoothing, (n,)))
        own = cs.walk_candidates(samples, uses, tests, short, "ranks").toPandas().set_index(key)
        assert len(own) == 14 * 4
        np.testing.assert_allclose(own[RANKS], whole.loc[own.index, RANKS], atol=1e-12)


ALL = list(bt.TABLES)


def test_early_stopping_equals_a_loop(spark):
    rng = random.Random(3)
    series = {(k, c): [round(rng.uniform(0.1, 0.2), 2) for _ in range(rng.randrange(1, 15))] for k in range(5) for c in range(4)}
    scores = spark.createDataFrame([(k, c, t, v) for (k, c), s in series.items() for t, v in enumerate(s, 1)], "k int, config int, rounds int, rps double")
    for patience in (1, 3, 50):
        got = {(r["k"], r["config"]): (r["rounds"], r["val_rps"], r["stopped_at"]) for r in bt.early_stopped(scores, ["k", "config"], patience).collect()}
        for key, s in series.items():
            best, at, last = math.inf, 0, 0
            for t, v in enumerate(s, 1):
                last = t
                if v < best:
                    best, at = v, t
                elif t - at >= patience:
                    break
            assert got[key] == (at, best, last)


def test_search_sees_only_the_past(spark):
    """Whatever happens from the origin on, its search and its forecast stay; too few windows give 0.2."""
    rows = made(n_windows=12)
    bases = sorted({r[0] for r in rows})
    changed = [r if r[1] <= bases[9] else (*r[:3], *[0.5] * len(FEATURES), 0.0, 0.0, 0.0, 0.0, 1.0) for r in rows]
    search = cs.Search(grid=GRID, n_val=3, embargo=1, patience=4, min_train_windows=4)
    found = []
    for data in (rows, changed):
        samples = stage(spark.createDataFrame(data, SCHEMA), "bt_samples")
        windows = uses_of(spark, rows, (5, 9))
        tests = stage(spark.createDataFrame([(k, *r[2 : 3 + len(FEATURES)]) for k in (5, 9) for r in rows if r[0] == bases[k]],
                                            "k int, symbol string, " + ", ".join(f"{c} double" for c in FEATURES)), "bt_tests")
        probs, table = cs.honest(samples, windows, tests, search)
        found.append((probs.orderBy("k", "symbol").collect(), table.orderBy("k", "config").collect()))
    assert found[0] == found[1]
    probs, table = found[0]
    assert {r["k"] for r in table} == {9} and sum(r["chosen"] for r in table) == 1
    assert min(r["val_rps"] for r in table) == next(r["val_rps"] for r in table if r["chosen"])
    assert all(r[c] == 0.2 for r in probs if r["k"] == 5 for c in RANKS)
    best = {r["symbol"]: max(range(5), key=lambda q: r[RANKS[q]]) for r in probs if r["k"] == 9}
    truth = {r[2]: min(4, int(5 * r[3])) for r in rows if r[0] == bases[9]}
    assert sum(best[s] == truth[s] for s in best) >= 9  # the first feature is learned


def test_out_of_fold_rows_are_not_trained_on(spark):
    rows = made()
    samples = stage(spark.createDataFrame(rows, SCHEMA), "bt_samples")
    origins = samples.select("base_date").distinct().selectExpr("1 AS k", "base_date AS origin").where("origin = date'2020-05-22'")
    search = cs.Search(grid=bt.Grid((2,), (3.0,), (18,)), folds=3)
    got = {r["symbol"]: [r[c] for c in RANKS] for r in cs.kfold_candidates(samples, origins, search, "ranks").collect()}
    folds = {(r["symbol"], r["base_date"]): r["fold"] for r in sm.shuffled_folds(samples, 3, search.seed).collect()}
    at = origins.first()["origin"]
    for r in rows:
        if r[0] == at:
            train = [x for x in rows if folds[(x[2], x[0])] != folds[(r[2], at)]]
            assert got[r[2]] == pytest.approx(one_by_one(train, r[3 : 3 + len(FEATURES)], 2, 3.0, 18), abs=1e-12)
    assert len(got) == 14


def test_rows_are_forecast_and_scored_where_they_are(spark):
    """Forecasting shuffles nothing, and scores equal those of the written-out forecasts, also under several models."""
    rows = made()
    samples = stage(spark.createDataFrame(rows, SCHEMA).repartition(3), "bt_samples")
    uses = uses_of(spark, rows, (3, 5))
    tables = stage(bt.fitted(bt.cell_counts(samples, cs.WINDOW, GRID, "ranks"), uses, cs.WINDOW, ["k"]), "bt_tables")
    bases = sorted({r[:2] for r in rows})
    tests = samples.where("base_date >= date'2020-06-01'")
    models = {w: [(k,) for k in (3, 5, 99)] for w in bases if str(w[0]) >= "2020-06-01"}  # 99 was never fitted
    every = stage(tests.crossJoin(spark.createDataFrame([(3,), (5,), (99,)], "k int")), "bt_every")
    forecasts = bt.predicted(every, ["k", *cs.WINDOW, "symbol"], ["k"], tables, GRID, "ranks", (9, 18))
    plan = forecasts._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Window", "Generate"))
    want = tg.mean_rps(tg.rps_per_asset(forecasts, samples, [*cs.WINDOW, "symbol"]), ["k", *cs.WINDOW, "config", "rounds"]).toPandas()
    got = bt.scored(tests, cs.WINDOW, ["k"], tables, GRID, "ranks", (9, 18), models).toPandas()
    key = ["k", *cs.WINDOW, "config", "rounds"]
    both = got.merge(want, on=key, suffixes=("", "_want"))
    assert len(both) == len(got) == len(want) == 3 * len(models) * 4 * 2 and (both["n"] == both["n_assets"]).all()
    np.testing.assert_allclose(both["rps"], both["rps_want"], atol=1e-12)


def test_a_query_makes_only_the_tables_it_needs(monkeypatch):
    from crossrank.catalog import cascades

    assert cascades.Steps.__dict__["samples"].__class__.__name__ == "cached_property"
    made_now = []
    monkeypatch.setattr(cascades, "stage", lambda df, label, *a, **k: made_now.append(label) or df)
    monkeypatch.setattr(cascades.sm, "weekly_bases", lambda days, origins: "bases")
    panel = type("P", (), {"days": None, "origins": None, "calendar": type("C", (), {"where": lambda s, c: s, "select": lambda s, c: s})()})()
    monkeypatch.setattr(cascades.F, "broadcast", lambda df: df)
    assert cascades.Steps(panel).bases == "bases" and made_now == ["weekly_bases"]


def test_stored_bins_give_the_counts_of_the_features(spark):
    """features stored as bins are counted as the features are, missing rows as missing values."""
    values = [f"CASE WHEN id % 7 = {i % 7} THEN NULL ELSE (id * {i + 3} % 41) / 10D - 2 END AS {f}" for i, f in enumerate(FEATURES)]
    rows = spark.range(200).selectExpr("id", "int(id % 3) AS fold", *values, *[f"double(id % 5 = {q}) AS {t}" for q, t in enumerate(TARGETS)])
    rows = rows.selectExpr("id", "fold", *[f"CASE WHEN id % 20 = 0 THEN NULL ELSE {f} END AS {f}" for f in FEATURES], *TARGETS)
    codes = bt.coded(rows.drop(*TARGETS), bt.Grid(), "scores").where("id % 20 <> 0")
    stored = rows.drop(*FEATURES).join(codes.drop("fold"), "id", "left")
    assert {t for c, t in codes.dtypes if c.startswith("_b")} == {"tinyint"}
    order = ["fold", "round", "bins", "cell"]
    want, got = (bt.cell_counts(r, ["fold"], bt.Grid(), "scores").orderBy(*order).collect() for r in (rows, stored))
    assert len(want) > 100 and got == want
