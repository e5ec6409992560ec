"""Ranks and order statistics against pandas / numpy, with heavy ties and hot groups."""

import numpy as np
import pandas as pd
import pytest

from crossrank.operators import ordering as od
from crossrank.operators import significance as sg


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows and a third of all rows share one value."""
    rng = np.random.default_rng(1)
    n = 4000
    return pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)),
            "v": np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 3)),
            "id": np.arange(n),
        }
    )


@pytest.mark.parametrize("bounded", [True, False])
def test_ranks_match_pandas(spark, skewed, bounded):
    df = spark.createDataFrame(skewed)
    out = od.with_rank(df, ["g"], "v", low="lo", average="av", percentile="pct", bounded=bounded).toPandas()
    out = out.sort_values("id").reset_index(drop=True)
    by = out.groupby("g")["v"]
    assert (out["lo"] == by.rank(method="min")).all()
    assert (out["av"] == by.rank(method="average")).all()
    np.testing.assert_allclose(out["pct"], by.rank(pct=True))


def test_rank_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "g string, v double")
    out = {r["v"]: r["lo"] for r in od.with_rank(df, ["g"], "v", low="lo").collect()}
    assert out == {1.0: 1, None: None, 3.0: 2}


@pytest.mark.parametrize("bounded", [True, False])
def test_order_statistics_are_exact(spark, skewed, bounded):
    df = spark.createDataFrame(skewed)
    places = [od.Place(0.0, "1"), od.Place(0.37, "floor(n * 0.37D)"), od.Place(1.0, "n"),
              # a level far from the position: the bracket misses and the search must widen
              od.Place(0.9, "2"), od.Place(0.1, "n - 1")]
    got = od.order_statistics(df, ["g"], "v", places, bounded).toPandas()
    for g, rows in skewed.groupby("g"):
        values = np.sort(rows["v"].to_numpy())
        n = len(values)
        want = [1, int(np.floor(n * 0.37)), n, 2, n - 1]
        mine = got[got["g"] == g].set_index("slot")
        for slot, position in enumerate(want):
            v = values[position - 1]
            assert mine.loc[slot, "value"] == v
            assert mine.loc[slot, "less"] == (values < v).sum()
            assert mine.loc[slot, "ties"] == (values == v).sum()
            assert mine.loc[slot, "n"] == n


def test_quantiles_interpolate_like_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = od.exact_quantiles(df, ["g"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.9}).toPandas().set_index("g")
    for g, rows in skewed.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["lo", "mid", "hi"]].astype(float), np.quantile(rows["v"], [0.025, 0.5, 0.9]))


def by_definition(p):
    """Holm: the largest penalised value among those at most as large; Benjamini-Hochberg: the smallest
    among those at least as large.  Each value alone, from the two definitions."""
    rank = {v: i for i, v in reversed(list(enumerate(sorted(p), 1)))}  # first place of a value
    last = {v: i for i, v in enumerate(sorted(p), 1)}
    m, holm, bh = len(p), [], []
    for own in p:
        holm.append(min(1.0, max((m - rank[v] + 1) * v for v in rank if v <= own)))
        bh.append(min(1.0, min(m / last[v] * v for v in last if v >= own)))
    return holm, bh


def test_adjusted_pvalues_small_families(spark):
    families = {"a": [0.2, 0.013, 0.6, 0.02, 0.02], "b": [0.5], "c": [1.0, 0.0004, 1.0]}
    df = spark.createDataFrame([(i, f, p) for f, ps in families.items() for i, p in enumerate(ps)], "i int, f string, p_value double")
    out = sg.adjust_pvalues(df, ["f"]).orderBy("f", "i").toPandas()
    for f, ps in families.items():
        holm, bh = by_definition(ps)
        np.testing.assert_allclose(out[out["f"] == f]["p_holm"], holm)
        np.testing.assert_allclose(out[out["f"] == f]["p_bh"], bh)


def test_adjusted_pvalues_large_family(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(700) ** 2, 3)
    df = spark.createDataFrame([(i, "f", float(x)) for i, x in enumerate(p)], "i int, f string, p_value double")
    out = sg.adjust_pvalues(df, ["f"]).orderBy("i").toPandas()
    holm, bh = by_definition(p)
    np.testing.assert_allclose(out["p_holm"], holm)
    np.testing.assert_allclose(out["p_bh"], bh)


def test_common_values_are_spread(spark):
    """Four rows in ten share one value, and no task gets much more than its share of the rows."""
    rows = spark.range(40_000).selectExpr("id", "'g' AS g", "CASE WHEN id % 5 < 2 THEN 7L ELSE id END AS v")
    placed = od.place(rows, ["g"], "v")
    sizes = placed.groupBy("_bucket", "_salt").count().toPandas()["count"]
    assert sizes.sum() == 40_000 and sizes.max() < 40_000 / 20
    got = placed.where("v = 7").selectExpr("_less", "_ties", "_n").distinct().collect()
    assert [tuple(r) for r in got] == [(3, 16_001, 40_000)]  # below: 2, 3 and 4; id 7 is itself 7
    other = placed.where("v != 7").selectExpr("sum(_ties) AS t", "max(_less) AS top").first()
    assert other["t"] == 23_999 and other["top"] == 39_999


def test_ranks_join_nothing_on_the_value(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 AS g", "id % 7 AS v")
    plan = od.with_rank(rows, ["g"], "v", low="lo", bounded=True)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("v#" in line for line in joins)


def test_adjusted_pvalues_keep_missing_ones(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", None), ("f", 1.0), ("f", 1.0)], "f string, p_value double")
    out = sg.adjust_pvalues(df, ["f"]).toPandas().sort_values("p_value")
    assert out["p_holm"].isna().sum() == 1 and out["p_bh"].isna().sum() == 1
    np.testing.assert_allclose(out["p_holm"][:3], [0.03, 1.0, 1.0])
