import datetime as dt

import pandas as pd
import pytest

from crossrank.operators import calendar as cal
from crossrank.operators import panel


def days_table(spark, dates):
    df = spark.createDataFrame([("A", d, 1.0) for d in dates], "symbol string, date date, price double")
    return cal.trading_days(df)


def test_grid_is_contiguous_fridays(spark):
    grid = cal.period_grid(spark, "2022-02-04", "2026-10-16").toPandas()
    assert grid["label"].tolist()[:4] == ["Trial run", "1st Submission", "2nd Submission", "3rd Submission"]
    assert grid["label"][12] == "12th Submission" and grid["label"][13] == "P2-01"
    assert grid["phase"].tolist()[:2] == ["trial", "period1"] and grid["phase"].iloc[-1] == "period2"
    assert (grid["base"].iloc[1:].to_numpy() == grid["end"].iloc[:-1].to_numpy()).all()
    assert all(d.weekday() == 4 for d in grid["base"])
    assert grid["deadline"][1] == pd.Timestamp("2022-03-06 18:00")
    assert (grid["phase"] == "period2").sum() == 49 - 1 or len(grid) == 61


def test_holiday_moves_the_boundary_back(spark):
    dates = [d.date() for d in pd.bdate_range("2022-01-31", "2022-04-29") if d.date() != dt.date(2022, 3, 4)]
    out = cal.resolve(cal.period_grid(spark, "2022-02-04", "2022-04-29"), days_table(spark, dates)).toPandas()
    assert out["end_date"][0] == dt.date(2022, 3, 3) and out["base_date"][1] == dt.date(2022, 3, 3)
    assert out["n_days"].tolist() == [19, 20, 20]


def test_resolve_fails_before_the_first_day(spark):
    late = [d.date() for d in pd.bdate_range("2022-02-10", "2022-04-29")]
    with pytest.raises(Exception, match="no trading day"):
        cal.resolve(cal.period_grid(spark, "2022-02-04", "2022-04-29"), days_table(spark, late)).collect()


def test_last_complete_period_is_strictly_before_the_download(spark):
    on_end = cal.last_complete_period(spark, "2022-02-04", "2022-04-01").first()
    after = cal.last_complete_period(spark, "2022-02-04", "2022-04-02").first()
    assert (on_end["k"], after["k"]) == (0, 1)
    with pytest.raises(Exception, match="no complete period"):
        cal.last_complete_period(spark, "2022-02-04", "2022-02-05").collect()


def test_past_windows_touch_and_stop_at_the_data(spark):
    dates = [d.date() for d in pd.bdate_range("2021-01-01", "2021-06-30")]
    origins = spark.createDataFrame([(dt.date(2021, 6, 25),)], "origin date")
    out = cal.past_windows(origins, days_table(spark, dates)).orderBy("j").toPandas()
    assert out["end_date"][0] == dt.date(2021, 6, 25)
    assert (out["base_date"].iloc[:-1].to_numpy() == out["end_date"].iloc[1:].to_numpy()).all()
    assert len(out) == 6 and out["base_date"].min() >= dates[0]
    assert cal.past_windows(origins, days_table(spark, dates), 2).count() == 2


def test_forward_end_is_null_past_the_data(spark):
    dates = [d.date() for d in pd.bdate_range("2021-01-01", "2021-02-26")]
    bases = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2021, 2, 1),)], "base_date date")
    out = {r["base_date"]: r["end_date"] for r in cal.forward_end(bases, days_table(spark, dates)).collect()}
    assert out == {dt.date(2021, 1, 1): dt.date(2021, 1, 29), dt.date(2021, 2, 1): None}


def test_period_prices_need_trading_day_edges(spark):
    dates = [d.date() for d in pd.bdate_range("2022-01-31", "2022-03-31")]
    prices = spark.createDataFrame([("A", d, 1.0) for d in dates], "symbol string, date date, price double")
    bad = spark.createDataFrame([(0, dt.date(2022, 2, 5), dt.date(2022, 3, 4))], "k int, base_date date, end_date date")
    with pytest.raises(Exception, match="must be dates present"):
        panel.period_prices(prices, bad, cal.trading_days(prices)).collect()


def test_duplicates_are_reported(spark):
    df = spark.createDataFrame([("A", dt.date(2022, 1, 3), 1.0)] * 2, "symbol string, date date, price double")
    with pytest.raises(ValueError, match="twice"):
        panel.require_empty(panel.duplicate_keys(df), "priced twice")


def test_history_cut_ignores_later_rows(spark, walk_panel):
    frame, prices, days, calendar = walk_panel
    dates = calendar.selectExpr("base_date AS date")
    before = panel.history_at(prices, dates, days).toPandas()
    cut = dates.agg({"date": "max"}).first()[0]
    tampered = prices.selectExpr("symbol", "date", f"CASE WHEN date > DATE '{cut}' THEN price * 1000 ELSE price END AS price")
    after = panel.history_at(tampered, dates, days).toPandas()
    key = ["symbol", "date"]
    pd.testing.assert_frame_equal(before.sort_values(key, ignore_index=True), after.sort_values(key, ignore_index=True))
    wide = frame.pivot(index="date", columns="symbol", values="price").ffill()
    for r in before.sample(20, random_state=0).itertuples():
        assert r.price == wide.loc[r.date, r.symbol]


def test_periods_follow_the_data():
    """Two more years of rows give two more years of periods; nothing is fixed in the code."""
    from datetime import date

    from crossrank.sources.star_schema import Panels

    for last, periods in ((date(2001, 11, 4), 76), (date(2003, 11, 4), 102), (date(1996, 1, 9), 0)):
        panels = Panels(None, "")
        panels.last_day = last
        assert panels.n_periods == periods


def test_bucket_count_stays_legal(spark):
    from crossrank.sources.star_schema import legal_buckets

    assert legal_buckets(spark, 800_000) == 100_000 and legal_buckets(spark, 12) == 12
