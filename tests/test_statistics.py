"""Tests of means, bootstraps, correlations and special functions."""

import math

import numpy as np
import pandas as pd
import pytest

from crossrank.functions.special import hypergeometric_two_sided, student_p
from crossrank.operators import association as asc
from crossrank.operators import significance as sg
from crossrank.schema import RANKS


def series(spark, values, name="m"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(values)], "model string, k int, rps_diff double")


def upper_tails(spark, cases):
    """P(T > t) of (t, df) rows."""
    table = spark.createDataFrame([(i, float(t), n) for i, (t, n) in enumerate(cases)], "i int, t double, n int")
    return [r["p"] for r in table.selectExpr("i", f"{student_p('t', 'n', 'greater')} AS p").orderBy("i").collect()]


def test_student_tail_published_values(spark):
    # Two-sided 5 % points of Student's t for 1, 5, 10 and 60 degrees of freedom, then published tests of 12 and 49 periods.
    points = [(12.7062047364, 1), (2.5705818366, 5), (2.2281388520, 10), (2.0002978220, 60)]
    *five, twelve, many = upper_tails(spark, [*points, (2.6411, 11), (9.1501, 48)])
    assert five == pytest.approx([0.025] * 4, abs=5e-11)
    assert twelve == pytest.approx(0.011474, abs=2e-6)
    assert many == pytest.approx(2.13e-12, rel=5e-3)


def test_student_tail_closed_forms_and_integrals(spark):
    ts = [-40.0, -1.5, -1e-9, 0.0, 0.01, 0.7, 3.0, 250.0]
    one = upper_tails(spark, [(t, 1) for t in ts])
    assert one == pytest.approx([math.atan2(1, t) / math.pi for t in ts], rel=1e-12)
    two = upper_tails(spark, [(t, 2) for t in ts if t > 0])
    assert two == pytest.approx([1 / (r * (r + t)) for t in ts if t > 0 for r in [math.sqrt(t * t + 2)]], rel=1e-12)
    grid = np.linspace(0, 1, 200_001)  # over u = 1 / x, which makes the tail finite
    for n in (7, 30, 400):
        log_scale = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi)
        for t in (0.3, 1.9):
            x = t / np.maximum(grid, 1e-300)
            density = np.where(grid > 0, np.exp(log_scale - (n + 1) / 2 * np.log1p(np.minimum(x, 1e150) ** 2 / n)), 0.0)
            tail = np.trapezoid(np.where(grid > 0, density * t / np.maximum(grid, 1e-300) ** 2, 0.0), grid)
            assert upper_tails(spark, [(t, n)])[0] == pytest.approx(tail, rel=1e-7)


def test_student_alternatives_and_missing_statistic(spark):
    table = spark.createDataFrame([(1.2, 9), (None, 9)], "t double, n int")
    for row in table.selectExpr("t", *[f"{student_p('t', 'n', a)} AS `{a}`" for a in sg.ALTERNATIVES]).collect():
        if row["t"] is None:
            assert row["less"] is row["greater"] is row["two-sided"] is None
        else:
            assert row["less"] == pytest.approx(1 - row["greater"]) and row["two-sided"] == pytest.approx(2 * row["greater"])


def test_fisher_published_table():
    assert hypergeometric_two_sided(89, 36, 27, 11) == pytest.approx(1.0)
    assert hypergeometric_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-8)


def dm_by_definition(d, h):
    """Mean over the root of its long-run variance, with the small-sample factor."""
    n, c = len(d), d - d.mean()
    variance = sum((1 if lag == 0 else 2) * (c[lag:] @ c[: n - lag]) for lag in range(h)) / n
    return d.mean() / math.sqrt(variance / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


@pytest.mark.parametrize("h", [1, 2, 3])
def test_dm_statistic_of_smoothed_series(spark, h):
    steps = np.random.default_rng(31).normal(-0.002, 0.004, (6, 22))
    smooth = {f"s{i}": np.convolve(row, [0.5, 0.3, 0.2], "valid") for i, row in enumerate(steps)}
    rows = [(m, k, float(v)) for m, d in smooth.items() for k, v in enumerate(d)]
    table = spark.createDataFrame(rows, "model string, k int, rps_diff double")
    tails = {a: {r["model"]: r for r in sg.diebold_mariano(table, ["model"], h=h, alternative=a).collect()} for a in sg.ALTERNATIVES}
    for model, d in smooth.items():
        less, greater, both = (tails[a][model] for a in ("less", "greater", "two-sided"))
        assert less["dm_stat"] == pytest.approx(dm_by_definition(d, h))
        assert less["p_value"] + greater["p_value"] == pytest.approx(1)
        assert both["p_value"] == pytest.approx(2 * min(less["p_value"], greater["p_value"]))


def test_dm_without_a_positive_variance(spark):
    swinging = [0.01, -0.03] * 7  # its first autocovariance outweighs the variance
    for values, h in ((swinging, 2), ([0.25] * 9, 1)):
        row = sg.diebold_mariano(series(spark, values), ["model"], h=h).first()
        assert row["dm_stat"] is None and row["p_value"] == 1.0
    with pytest.raises(Exception, match="at least 3"):
        sg.diebold_mariano(series(spark, swinging[:2]), ["model"]).collect()
    with pytest.raises(ValueError):
        sg.diebold_mariano(series(spark, swinging), ["model"], alternative="other")


def test_block_bootstrap_equals_the_enumerated_resamples(spark):
    """Four periods in blocks of two: sixteen equally likely resamples."""
    d, draws = np.array([-0.031, 0.052, -0.043, 0.017]), 4000
    halves = (d + np.roll(d, -1)) / 2
    means = np.add.outer(halves, halves).ravel() / 2
    rows = series(spark, d, "mixed").union(series(spark, [-0.125] * 6, "flat"))
    run = [{r["model"]: r for r in sg.block_bootstrap(rows, ["model"], block=2, n_boot=draws, seed=9).collect()} for _ in range(2)]
    assert run[0] == run[1]
    mixed, flat = run[0]["mixed"], run[0]["flat"]
    exact = np.mean(means - d.mean() <= d.mean())
    assert mixed["p_boot"] == pytest.approx(exact, abs=4 * math.sqrt(exact * (1 - exact) / draws))
    assert [mixed["ci_low"], mixed["ci_high"]] == pytest.approx([means.min(), means.max()])
    assert flat["p_boot"] == 1.0 and flat["ci_low"] == flat["ci_high"] == -0.125


def pairs(spark, x, y):
    frame = pd.DataFrame({"g": "a", "id": [f"t{i}" for i in range(len(x))], "a": x, "b": y})
    df = spark.createDataFrame(frame, "g string, id string, a double, b double")
    return asc.complete_pairs(df, ["g"], "a", "b", "id")


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=60), 1)
    y = x + rng.normal(size=60)
    x[3] = np.nan
    keep = np.isfinite(x)
    ranks = [pd.Series(v[keep]).rank() for v in (x, y)]
    got = asc.correlation(pairs(spark, x, y), ["g"], "spearman", 300, 300, seed=4).first()
    assert got["n"] == 59 and got["estimate"] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert got["ci_low"] < got["estimate"] < got["ci_high"] and got["p_perm"] == pytest.approx(1 / 301)
    se = (1 - got["estimate"] ** 2) / np.sqrt(59)
    assert (got["ci_high"] - got["ci_low"]) / 2 == pytest.approx(1.96 * se, rel=0.4)
    plain = asc.correlation(pairs(spark, x, y), ["g"], "pearson", 0, 0).first()
    assert plain["estimate"] == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1])
    noise = asc.correlation(pairs(spark, rng.normal(size=40), rng.normal(size=40)), ["g"], "pearson", 0, 300).first()
    assert noise["p_perm"] > 0.02
    with pytest.raises(Exception, match="at least 4"):
        asc.correlation(pairs(spark, x[:3], y[:3]), ["g"], n_boot=0, n_perm=0).collect()
    with pytest.raises(ValueError):
        asc.correlation(pairs(spark, x, y), ["g"], "kendall")


def test_permutations_are_uniform(spark):
    """Permuted correlations of unrelated data centre on zero with spread 1 / sqrt(n - 1)."""
    rng = np.random.default_rng(8)
    base = asc.complete_pairs(
        spark.createDataFrame(pd.DataFrame({"g": "a", "id": [f"t{i}" for i in range(50)], "a": rng.normal(size=50), "b": rng.normal(size=50)})),
        ["g"], "a", "b", "id",
    )
    estimate = spark.createDataFrame([("a", 50, 0.14)], "g string, n bigint, estimate double")
    numbered = base.selectExpr("g", "id", "x", "y", "x AS sx", "y AS sy", "50L AS n", "bigint(substring(id, 2)) AS pos")
    p = asc._permutation(numbered, estimate, ["g"], 800, 3).first()["p_perm"]
    assert p == pytest.approx(2 * 0.164, abs=0.08)  # P(|r| > 0.14) for n = 50


def test_fisher_table(spark):
    rows = [("a", False, False)] * 89 + [("a", False, True)] * 36 + [("a", True, False)] * 27 + [("a", True, True)] * 11
    out = asc.fisher_table(spark.createDataFrame(rows, "g string, x boolean, y boolean"), ["g"], "x", "y").first()
    assert out["odds_ratio"] == pytest.approx(1.0072, abs=1e-4) and out["p_value"] == pytest.approx(1.0)


def test_fisher_tails_equal_full_enumeration():
    rng = np.random.default_rng(11)
    for _ in range(300):
        a, b, c, d = (int(rng.integers(0, 31)) for _ in range(4))
        row, col, n = a + b, a + c, a + b + c + d
        mass = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(m for m in mass.values() if m <= mass[a] * (1 + 1e-7)) / math.comb(n, col)
        assert hypergeometric_two_sided(a, b, c, d) == pytest.approx(want, rel=1e-9)
    assert 0 < hypergeometric_two_sided(50_001_000, 50_000_000, 50_000_000, 50_000_000) < 1


def test_team_months_compare_symbols_only_at_the_top(spark):
    rows = [
        ("A", "m1", "S2", 0.5), ("A", "m1", "S10", -0.5), ("A", "m1", "S1", 0.1), ("A", "m1", "S0", None),
        ("A", "m2", "S3", 0.0), ("A", "m2", "S2", 0.0), ("B", "m1", "S5", None), ("B", "m1", "S4", None),
    ]
    table = spark.createDataFrame([(*r, *[0.3, 0.1, 0.2, 0.2, 0.2]) for r in rows], "Team string, Evaluation string, Symbol string, Decision double, " + ", ".join(f"{c} double" for c in RANKS))
    out = asc.team_months(table)
    got = {(r["Team"], r["Evaluation"]): r for r in out.collect()}
    assert [got[k]["largest_position"] for k in (("A", "m1"), ("A", "m2"), ("B", "m1"))] == ["S10", "S2", "S4"]
    assert [got[k]["largest_weight"] for k in (("A", "m1"), ("A", "m2"), ("B", "m1"))] == [-0.5, 0.0, None]
    assert got["A", "m1"]["gross_exposure"] == 1.1 and math.isclose(got["B", "m1"]["mean_abs_dev_uniform"], 0.04)
    assert "min_by" not in out._jdf.queryExecution().executedPlan().toString()


def test_fidelity_of_one_rerun_for_all_teams(spark):
    rng = np.random.default_rng(3)
    shares = lambda: [float(x) for x in rng.dirichlet(np.ones(5))]
    ddl = ", ".join(f"{c} double" for c in RANKS)
    rerun = [(k, f"S{i}", *shares()) for k in (1, 2) for i in range(6)]
    teams = [(t, k, f"S{i}", *shares()) for t in ("A", "B") for k in (1, 2) for i in range(7 if t == "A" else 4)]
    truth = [(k, f"S{i}", *[float(j == (i + k) % 5) for j in range(5)]) for k in (1, 2) for i in range(1, 8)]
    one = spark.createDataFrame(rerun, f"k int, symbol string, {ddl}")
    submitted = spark.createDataFrame(teams, f"team string, k int, symbol string, {ddl}")
    targets = spark.createDataFrame(truth, "k int, symbol string, " + ", ".join(f"Target{q} double" for q in range(1, 6)))
    each = one.crossJoin(submitted.select("team").distinct())
    got, want = (
        asc.fidelity(r, submitted, targets, ["team"]).toPandas().set_index(["team", "k"]).sort_index() for r in (one, each)
    )
    pd.testing.assert_frame_equal(got, want[got.columns])
    ours, real = {r[:2]: np.array(r[2:]) for r in rerun}, {r[:2]: np.array(r[2:]) for r in truth}
    for (team, k), row in got.iterrows():
        mine = {r[2]: np.array(r[3:]) for r in teams if r[:2] == (team, k)}
        both = [s for s in mine if (k, s) in ours]
        x, y = (np.concatenate(v) - 0.2 for v in ([ours[k, s] for s in both], [mine[s] for s in both]))
        shrink = (x @ y) / (x @ x)
        scores = [np.mean(np.cumsum(real[k, s] - p) ** 2) for s, p in mine.items() if (k, s) in real]
        again = [np.mean(np.cumsum(real[k, s] - p) ** 2) for (j, s), p in ours.items() if j == k and (k, s) in real]
        want_row = [np.corrcoef(x, y)[0, 1], shrink, abs(x - y).mean(), abs(x - y).max(), abs(y - shrink * x).mean(), abs(y - shrink * x).max(), np.mean(scores), np.mean(again)]
        np.testing.assert_allclose(row[["corr", "shrink", "mean_abs_diff", "max_abs_diff", "mean_abs_resid", "max_abs_resid", "rps_submission", "rps_reproduction"]].to_numpy(float), want_row, atol=1e-12)
