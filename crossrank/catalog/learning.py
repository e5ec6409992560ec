"""Feature, sample, covariance and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.evaluation import rounded
from crossrank.catalog.fragments import rps_sql, with_parts
from crossrank.functions.scores import TARGETS
from crossrank.operators import calendar as cal
from crossrank.operators import covariance as cv
from crossrank.operators import features as ft
from crossrank.operators import samples as sm
from crossrank.operators import targets as tg
from crossrank.operators import universe as un
from crossrank.schema import RANKS
from crossrank.sources.star_schema import panels
from crossrank.staging import stage

_F9 = ", ".join(f"ROUND({c}, 9) AS {c}" for c in ft.FEATURES)
_T9 = ", ".join(f"ROUND({c}, 9) AS {c}" for c in TARGETS)
_R9 = dict.fromkeys([*ft.FEATURES, *TARGETS], 9)


def _windows(p):
    return stage(cal.past_windows(p.origins, p.days), "windows")


_SIGNALS: dict = {}
_FEATURES: dict = {}


def _base_signals(p):
    """Signals of every symbol at the bases and origins of all windows, made once per panel."""
    if p not in _SIGNALS:
        windows = cal.past_windows(p.origins, p.days)
        dates = windows.selectExpr("base_date AS date").union(p.origins.selectExpr("origin AS date"))
        _SIGNALS[p] = stage(ft.price_signals(p.prices, p.days, dates), "signals")
    return _SIGNALS[p]


def _base_features(p):
    """Their ranks among all symbols."""
    if p not in _FEATURES:
        _FEATURES[p] = stage(ft.cross_sectional(_base_signals(p)), "base_features")
    return _FEATURES[p]


def _samples(p):
    windows = _windows(p)
    return stage(sm.window_samples(p.prices, windows, _base_features(p), p.days), "samples"), windows


def _weekly_windows(p):
    """Labelled rows of the weekly samples, and their bases."""
    bases = stage(sm.weekly_bases(p.days, p.origins), "weekly")
    return sm.window_targets(p.prices, bases, p.days), bases


def _weekly(p):
    """Weekly samples: features scaled over every day of a symbol, where its prices are, and kept on the bases."""
    labelled, bases = _weekly_windows(p)
    every = ft.naive_features(ft.price_signals(p.prices, p.days))
    dates = F.broadcast(bases.selectExpr("base_date AS date"))  # calendar-sized
    return sm.with_features(labelled, every.join(dates, "date", "left_semi"))


@query(with_parts("win", "SELECT k, origin, j, wb AS base_date, we AS end_date FROM win"))
def past_windows(spark, folder):
    p = panels(spark, folder)
    return cal.past_windows(p.origins, p.days).select("k", "origin", "j", "base_date", "end_date")


@query(with_parts("win", "SELECT k, j, wb AS base_date, we AS end_date FROM win WHERE j < 12"))
def past_windows_lookback(spark, folder):
    p = panels(spark, folder)
    return cal.past_windows(p.origins, p.days, 12).select("k", "j", "base_date", "end_date")


@query(
    with_parts(
        "days",
        "SELECT day AS base_date, CASE WHEN day + 28 <= (SELECT MAX(day) FROM days) "
        "THEN (SELECT MAX(b.day) FROM days b WHERE b.day <= a.day + 28) END AS end_date FROM days a",
    )
)
def forward_end(spark, folder):
    p = panels(spark, folder)
    return cal.forward_end(p.days.selectExpr("day AS base_date"), p.days)


@query(with_parts("signals", f"SELECT symbol, date, {_F9} FROM signals"))
def price_signals(spark, folder):
    p = panels(spark, folder)
    return rounded(ft.price_signals(p.prices, p.days), **_R9)


@query(with_parts("basefeat", f"SELECT symbol, date, {_F9} FROM basefeat"))
def cross_sectional_features(spark, folder):
    p = panels(spark, folder)
    return rounded(_base_features(p), **_R9)


@query(with_parts("dayfeat", f"SELECT symbol, date, {_F9} FROM dayfeat"))
def cross_sectional_daily(spark, folder):
    """The ranks of every trading day; ``cross_sectional_features`` has those of window bases and origins."""
    p = panels(spark, folder)
    return rounded(ft.cross_sectional(ft.price_signals(p.prices, p.days)), **_R9)


@query(with_parts("naive", "SELECT symbol, date, " + ", ".join(f"ROUND({c}, 5) AS {c}" for c in ft.FEATURES) + " FROM naive"))
def naive_features(spark, folder):
    p = panels(spark, folder)
    out = ft.naive_features(ft.price_signals(p.prices, p.days))
    return rounded(out, **dict.fromkeys(ft.FEATURES, 5))


@query(with_parts("basefeat members cal", f"SELECT m.k, m.symbol, {_F9.replace('ROUND(', 'ROUND(f.')} FROM members m JOIN cal USING (k) LEFT JOIN basefeat f ON f.symbol = m.symbol AND f.date = cal.base_date"))
def origin_features(spark, folder):
    p = panels(spark, folder)
    features = _base_features(p)
    return rounded(sm.origin_rows(features, p.origins, p.members), **_R9)


@query(with_parts("samples", f"SELECT base_date, end_date, symbol, {_F9}, {_T9} FROM samples"))
def window_samples(spark, folder):
    return rounded(_samples(panels(spark, folder))[0], **_R9)


@query(
    with_parts(
        "samples win",
        "SELECT w.k, w.origin, s.base_date, s.end_date, COUNT(*) AS assets, ROUND(AVG(s.ret_20), 9) AS ret_20, "
        "ROUND(SUM(s.Target5), 9) AS top FROM samples s JOIN win w ON w.wb = s.base_date AND w.we = s.end_date GROUP BY 1, 2, 3, 4",
    )
)
def training_windows(spark, folder):
    samples, windows = _samples(panels(spark, folder))
    used = sm.training_windows(samples, windows)
    return used.groupBy("k", "origin", "base_date", "end_date").agg(
        F.count(F.lit(1)).alias("assets"),
        F.round(F.avg("ret_20"), 9).alias("ret_20"),
        F.round(F.sum("Target5"), 9).alias("top"),
    )


@query(
    with_parts(
        "win",
        "SELECT k, wb AS base_date, we AS end_date, CASE WHEN b <= 12 THEN 'val' WHEN b <= 13 THEN 'gap' ELSE 'train' END AS part "
        "FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY wb DESC) AS b FROM win)",
    )
)
def window_split(spark, folder):
    p = panels(spark, folder)
    windows = cal.past_windows(p.origins, p.days).select("k", "base_date", "end_date")
    return sm.split_windows(windows, 12, 1)


_LABELS = " UNION ALL ".join(
    f"SELECT base_date, end_date, symbol, ret_20, {q} AS label, Target{q + 1} AS weight FROM samples WHERE Target{q + 1} > 0"
    for q in range(5)
)


@query(with_parts("samples", f"SELECT base_date, end_date, symbol, ROUND(ret_20, 9) AS ret_20, label, ROUND(weight, 9) AS weight FROM ({_LABELS})"))
def expanded_labels(spark, folder):
    samples, _ = _samples(panels(spark, folder))
    out = sm.expand_targets(samples).select(
        "base_date", "end_date", "symbol", "ret_20", "label", "weight"
    )
    return rounded(out, ret_20=9, weight=9)


_W5 = "SELECT base_date, end_date, symbol, " + ", ".join(
    f"ROUND({c}, 5) AS {c}" for c in ("ret_5", "vol_20", "dist_high_250")
) + f", {_T9}"
_WK = ["base_date", "end_date", "symbol", "ret_5", "vol_20", "dist_high_250", *TARGETS]
_WKR = {"ret_5": 5, "vol_20": 5, "dist_high_250": 5, **dict.fromkeys(TARGETS, 9)}


@query(with_parts("wksamples", f"{_W5} FROM wksamples"))
def weekly_samples(spark, folder):
    return rounded(_weekly(panels(spark, folder)).select(*_WK), **_WKR)


@query(
    with_parts(
        "wksamples cal",
        "SELECT c.k, COUNT(*) AS rows, COUNT(*) FILTER (s.end_date > c.base_date) AS leaking, MAX(s.end_date) AS last_label "
        "FROM wksamples s JOIN cal c ON s.base_date < c.base_date GROUP BY 1",
    )
)
def unpurged_training_rows(spark, folder):
    p = panels(spark, folder)
    rows = stage(_weekly_windows(p)[0].select("base_date", "end_date"), "weekly_dates")  # all that is asked of a row
    used = sm.unpurged_past(rows, p.origins)
    return used.groupBy("k").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr("end_date > origin")).alias("leaking"),
        F.max("end_date").alias("last_label"),
    )


@query(
    with_parts(
        "wksamples",
        "SELECT base_date, symbol, CAST(CAST('0x' || substr(md5(concat(symbol, '|', CAST(base_date AS VARCHAR), '|2026')), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM wksamples",
    )
)
def shuffled_folds(spark, folder):
    out = sm.shuffled_folds(_weekly_windows(panels(spark, folder))[0])  # a fold follows from the key of its row
    return out.select("base_date", "symbol", "fold")


@query(
    with_parts(
        "cal",
        "SELECT c.k, (l.i * 2 + m.i)::INTEGER AS config, l.v AS min_data_in_leaf, m.v AS num_leaves, r.v AS rounds FROM cal c, "
        "(VALUES (0, 100::BIGINT), (1, 500::BIGINT)) l(i, v), (VALUES (0, 7::BIGINT), (1, 31::BIGINT)) m(i, v), (VALUES (50), (100), (200)) r(v)",
    )
)
def search_grid(spark, folder):
    p = panels(spark, folder)
    grid = sm.grid_table(spark)
    tries = grid.groupBy().agg(F.collect_list(F.struct(*grid.columns)).alias("g"))
    return (
        p.origins.select("k", F.lit(1).alias("_one"))
        .join(F.broadcast(tries.withColumn("_one", F.lit(1))), "_one")  # one row: the grid
        .selectExpr("k", "inline(g)")
    )


_PICK = """SELECT o.k, s.model, ROUND(AVG(s.rps), 9) AS mean_score, COUNT(*) AS n_windows FROM cal o
JOIN periods s ON s.k < o.k AND s.k >= o.k - 12 GROUP BY 1, 2"""


@query(
    with_parts(
        "periods cal",
        f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY mean_score, model) = 1 AS chosen FROM ({_PICK})",
    )
)
def select_by_past_score(spark, folder):
    p = panels(spark, folder)
    scores = p.walk.periods.selectExpr(
        "model", "rps AS score", "explode(sequence(k + 1, k + 12)) AS k"
    ).where(F.col("k") < p.n_periods)
    out = sm.select_candidates(scores.withColumn("score", F.round("score", 12)), ["k"], "model")
    return rounded(out, mean_score=9)


@query(
    with_parts(
        "periods",
        "SELECT *, row_number() OVER (PARTITION BY phase ORDER BY mean_score, model) = 1 AS chosen FROM "
        "(SELECT phase, model, ROUND(AVG(rps), 9) AS mean_score, COUNT(*) AS n_windows FROM periods GROUP BY 1, 2)",
    )
)
def select_ex_post(spark, folder):
    p = panels(spark, folder)
    scores = p.walk.periods.selectExpr("phase", "model", "rps AS score")
    return rounded(sm.select_candidates(scores, ["phase"], "model"), mean_score=9)


@query(
    with_parts(
        "hist targets",
        "SELECT k, ROUND(SUM(w * rps) / SUM(w), 9) AS rps, ROUND(SUM(w), 6) AS weight FROM ("
        + " UNION ALL ".join(
            f"SELECT f.k, t.Target{q + 1} AS w, "
            + rps_sql().replace("t.Target", "h.h").replace("h.h", "h")
            + f" AS rps FROM hist f JOIN targets t USING (k, symbol), (SELECT "
            + ", ".join(f"{int(q == i)} AS h{i + 1}" for i in range(5))
            + f") h WHERE t.Target{q + 1} > 0"
            for q in range(5)
        )
        + ") GROUP BY 1",
    )
)
def label_rps(spark, folder):
    p = panels(spark, folder)
    targets = tg.quintile_targets(p.returns, ["k"], bounded=True)
    rows = sm.expand_targets(targets.select("k", "symbol", *TARGETS)).join(
        p.history_forecast.select("k", "symbol", *RANKS), ["k", "symbol"]
    )
    return rounded(tg.label_rps(rows, ["k"]), rps=9, weight=6)


@query(
    with_parts(
        "periods",
        "SELECT model, ROUND(AVG(rps), 9) AS rps, COUNT(*) AS n_windows FROM periods GROUP BY 1",
    )
)
def window_mean_rps(spark, folder):
    p = panels(spark, folder)
    targets = tg.quintile_targets(p.returns, ["k"], bounded=True)
    scored = tg.rps_per_asset(p.forecasts, targets, ["k", "symbol"])
    return rounded(tg.window_mean_rps(scored, ["k"], ["model"]), rps=9)


@query(
    with_parts(
        "rets",
        "SELECT symbol, COUNT(*) AS n_scenarios, "
        + ", ".join(f"ROUND(AVG(CAST(q = {q} AS INT)), 9) AS Rank{q}" for q in range(1, 6))
        + " FROM (SELECT symbol, CASE "
        + " ".join(f"WHEN p <= {q}*n//5 THEN {q}" for q in range(1, 5))
        + " ELSE 5 END AS q FROM (SELECT symbol, row_number() OVER (PARTITION BY k ORDER BY ret, CAST('0x' || substr(md5(symbol), 1, 15) AS BIGINT)) AS p, "
        "COUNT(*) OVER (PARTITION BY k) AS n FROM rets)) GROUP BY 1",
    )
)
def quintile_frequencies(spark, folder):
    p = panels(spark, folder)
    return rounded(tg.quintile_frequencies(p.returns, "k", bounded=True), **dict.fromkeys(RANKS, 9))


# Half-lives of the search, in trading days.
HALFLIVES = (21, 63, 126, 252)


def _cov_sql(select: str) -> str:
    """Every origin and half-life, all pairs of symbols."""
    lives = ", ".join(f"({h})" for h in HALFLIVES)
    return with_parts(
        "fill cal syms",
        f"""SELECT * FROM (WITH moves AS MATERIALIZED (SELECT symbol, sk, idx, LN(price) - lag(LN(price)) OVER (PARTITION BY symbol ORDER BY idx) AS r FROM fill JOIN syms USING (symbol)),
        ends AS (SELECT k, h, idx AS last FROM cal JOIN days ON day = base_date, (VALUES {lives}) v(h)),
        w AS MATERIALIZED (SELECT k, h, symbol, sk, idx, r, POWER(0.5, (last - idx) / CAST(h AS DOUBLE)) AS w
          FROM moves JOIN ends ON idx <= last AND idx > last - 5 * h WHERE r IS NOT NULL),
        var AS MATERIALIZED (SELECT k, h, symbol, SUM(w * r * r) / SUM(w) AS v FROM w GROUP BY 1, 2, 3),
        cov AS MATERIALIZED (SELECT a.k, a.h, a.symbol AS i, b.symbol AS j, SUM(a.w * a.r * b.r) / SUM(a.w) AS cov
          FROM w a JOIN w b USING (k, h, idx) GROUP BY ALL)
        {select})""",
    )


def _cov(spark, folder):
    p = panels(spark, folder)
    return cv.ewma_covariances(p.prices, p.days, p.origins, list(HALFLIVES))


@query(_cov_sql("SELECT k, h::DOUBLE AS halflife, i, j, ROUND(cov, 12) AS cov FROM cov"))
def ewma_covariance(spark, folder):
    """At every origin and half-life, all pairs of symbols."""
    return rounded(_cov(spark, folder).drop("var_i", "var_j"), cov=12)


@query(
    _cov_sql(
        "SELECT c.k, c.h::DOUBLE AS halflife, c.i, c.j, ROUND(CASE WHEN c.i = c.j THEN 1.0 WHEN a.v * b.v = 0 THEN 0 ELSE c.cov / (SQRT(a.v) * SQRT(b.v)) END, 9) AS corr "
        "FROM cov c JOIN var a ON a.k = c.k AND a.h = c.h AND a.symbol = c.i JOIN var b ON b.k = c.k AND b.h = c.h AND b.symbol = c.j"
    )
)
def correlation_matrix(spark, folder):
    return rounded(cv.correlation_matrix(_cov(spark, folder)), corr=9)


@query(
    with_parts(
        "fill syms",
        "SELECT 'class' || (sk % 4) AS class, ROUND(AVG(r), 12) AS mean, COUNT(r) AS n_returns FROM (SELECT symbol, date, "
        "LN(price) - lag(LN(price)) OVER (PARTITION BY symbol ORDER BY idx) AS r FROM fill) JOIN syms USING (symbol) "
        "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1",
    )
)
def class_means(spark, folder):
    p = panels(spark, folder)
    out = cv.class_means(p.prices, p.days, p.classes, "1996-01-01", "1998-12-31")
    return rounded(out, mean=12)


_VAR = "SELECT symbol, sk, CASE WHEN sk % 3 != 0 THEN VAR_SAMP(LN(price)) END AS value FROM prices GROUP BY 1, 2"


@query(
    with_parts(
        "prices",
        f"SELECT symbol, 'class' || (sk % 4) AS class, ROUND(COALESCE(value, MEDIAN(value) OVER (PARTITION BY sk % 4), "
        f"MEDIAN(value) OVER ()), 9) AS value, value IS NULL AS filled FROM ({_VAR})",
    )
)
def fill_by_class(spark, folder):
    from crossrank.sources.star_schema import asset_key

    p = panels(spark, folder)
    values = p.prices.groupBy("symbol").agg(F.var_samp(F.ln("price")).alias("v")).select(
        "symbol", F.when(asset_key(F.col("symbol")) % 3 != 0, F.col("v")).alias("value")
    )
    return rounded(cv.fill_by_class(values, p.classes), value=9)


@query(
    with_parts(
        "fill days",
        "SELECT symbol, CAST(m - idx AS INTEGER) AS age, ROUND(LN(price), 9) AS log_price FROM fill, (SELECT MAX(idx) AS m FROM days) "
        "WHERE m - idx < 256 AND symbol IN (SELECT symbol FROM fill GROUP BY 1 HAVING COUNT(*) >= 2450)",
    )
)
def recent_context(spark, folder):
    p = panels(spark, folder)
    return rounded(cv.recent_context(p.prices, p.days, 256, 2450), log_price=9)


