"""Leaderboard rules on a small table, and the registered queries against their SQL."""

import numpy as np
import pandas as pd
import pytest

from crossrank.operators import leaderboard as lb

FOLDER = "/root/testdata/sf0.001"
# A cross-section of the registry; tests/compare.py runs all of it.
CHECKED = ["uniform_rps", "quintile_targets_ties", "leaderboard", "gaps", "spliced_prices", "turnover", "fisher_exact"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    from compare import compare, duck

    import __spark_entry__ as entry

    assert compare(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name]) == ""


def test_every_statement_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranks_follow_the_official_rules(spark):
    rows = [("a", 0.1600001, 3.0), ("b", 0.1600004, 3.0), ("c", 0.15, 1.0), ("d", 0.17, 5.0), ("e", 0.17, 2.0)]
    df = spark.createDataFrame([("g", 1, *r) for r in rows], "level string, period int, team string, rps double, ir double")
    got = lb.rank(df, ["level", "period"]).toPandas().set_index("team")
    table = pd.DataFrame(rows, columns=["team", "rps", "ir"]).set_index("team")
    want = pd.DataFrame({"rps_rank": table["rps"].round(6).rank(), "ir_rank": (-table["ir"]).rank()})
    want["overall_rank"] = want.mean(axis=1)
    want["position"] = want["overall_rank"].rank(method="min")
    for c in want:
        np.testing.assert_allclose(got[c].sort_index(), want[c].sort_index())


def test_missing_evaluations_fail(spark):
    import datetime as dt

    table = spark.createDataFrame([("t", 1, 0.16, True)], "team string, k int, rps double, fresh boolean")
    daily = spark.createDataFrame([("t", 1, dt.date(2022, 1, d), 0.01 * d) for d in (1, 2, 3)], "team string, k int, date date, ret double")
    scores = lb.Scores(table, daily)
    month = lb.leaderboard(scores, ("month",)).collect()
    assert len(month) == 1 and month[0]["position"] == 1
    with pytest.raises(Exception, match="evaluations missing for team t"):
        lb.leaderboard(scores, ("global",), ranked=False).collect()
    with pytest.raises(ValueError):
        lb.leaderboard(scores, ("year",))
