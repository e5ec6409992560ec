"""Universe, weights, walk-forward and leaderboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.fragments import rps_sql, targets_sql, uniform_sql, with_parts
from crossrank.operators import forecasts as fc
from crossrank.operators import leaderboard as lb
from crossrank.operators import portfolio as pf
from crossrank.operators import universe as un
from crossrank.schema import RANKS
from crossrank.sources.star_schema import BENCHMARK_TEAM, COST_BPS, panels

_R = ", ".join(f"ROUND(Rank{q}, 9) AS Rank{q}" for q in range(1, 6))


def rounded(df, **digits):
    return df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


@query(with_parts("members", "SELECT k, symbol FROM members"))
def universe_official(spark, folder):
    return panels(spark, folder).members


@query(with_parts("members_d2", "SELECT k, symbol FROM members_d2"))
def universe_point_in_time(spark, folder):
    return panels(spark, folder).members_d2


@query(
    with_parts(
        "syms",
        "SELECT DISTINCT CASE WHEN sk % 25 = 7 THEN 'S' || (sk + 1) || CASE WHEN (sk + 1) % 5 = 0 THEN '.L' ELSE '' END "
        "ELSE symbol END AS symbol FROM syms WHERE NOT (sk % 25 = 7 AND sk % 50 = 7)",
    )
)
def universe_survivors(spark, folder):
    p = panels(spark, folder)
    return un.survivors_universe(p.symbols, p.successors)


@query(
    with_parts(
        "syms",
        "SELECT symbol, CASE WHEN sk % 4 = 3 THEN 'stock' ELSE 'class' || (sk % 4) END AS class FROM syms",
    )
)
def asset_classes(spark, folder):
    p = panels(spark, folder)
    return un.asset_class(p.symbols, p.classes.where("class != 'class3'"))


@query(with_parts("members", f"SELECT model, k, symbol, Rank1, Rank5, ROUND(weight, 12) AS weight FROM ({uniform_sql('members')})"))
def uniform_forecast(spark, folder):
    p = panels(spark, folder)
    out = un.uniform_forecast(p.members)
    return rounded(out.select("model", "k", "symbol", "Rank1", "Rank5", "weight"), weight=12)


@query(with_parts("hist", f"SELECT model, k, symbol, {_R}, ROUND(weight, 12) AS weight FROM hist"))
def historical_frequency(spark, folder):
    p = panels(spark, folder)
    return rounded(p.history_forecast, weight=12, **{c: 9 for c in RANKS})


@query(with_parts("hist_d2", f"SELECT model, k, symbol, {_R}, ROUND(weight, 12) AS weight FROM hist_d2"))
def historical_frequency_point_in_time(spark, folder):
    p = panels(spark, folder)
    out = fc.historical_frequency(p.prices, p.origins, p.members_d2, p.days, p.delistings)
    return rounded(out, weight=12, **{c: 9 for c in RANKS})


_TILT = (
    "SELECT model, k, symbol, ROUND(CASE WHEN SUM(ABS(s)) OVER w = 0 THEN 1.0 / COUNT(*) OVER w "
    "ELSE s / SUM(ABS(s)) OVER w END, 9) AS weight FROM (SELECT *, "
    "Rank1 + 2*Rank2 + 3*Rank3 + 4*Rank4 + 5*Rank5 - 3 AS s FROM {0}) WINDOW w AS (PARTITION BY model, k)"
)


@query(with_parts("hist", _TILT.format("hist")))
def expected_rank_weights(spark, folder):
    p = panels(spark, folder)
    out = un.with_weights(p.history_forecast, ["model", "k"], "expected_rank")
    return rounded(out.select("model", "k", "symbol", "weight"), weight=9)


@query(with_parts("fc", "SELECT model, k, COUNT(*) AS n, ROUND(SUM(ABS(weight)), 9) AS gross, "
       "ROUND(MAX(weight), 9) AS top FROM (" + _TILT.replace("ROUND(CASE", "(CASE").replace("END, 9)", "END)").format("fc") + ") GROUP BY 1, 2"))
def replay_weights(spark, folder):
    p = panels(spark, folder)
    out = un.with_weights(p.forecasts, ["model", "k"], "expected_rank")
    return out.groupBy("model", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.abs("weight")), 9).alias("gross"),
        F.round(F.max("weight"), 9).alias("top"),
    )


_BROKEN = (
    "SELECT model, k, symbol, Rank1 - CASE WHEN model = 'T03' AND k = 5 THEN 0.5 ELSE 0 END AS Rank1, Rank2, Rank3, Rank4, Rank5, "
    "weight * CASE WHEN model = 'T04' THEN 1.5 ELSE 1 END AS weight FROM fc WHERE NOT (model = 'T05' AND k < 3 AND symbol LIKE '%.L')"
)


@query(
    with_parts(
        "fc",
        f"""SELECT model, k, problem, COUNT(*) AS rows FROM (
        SELECT model, k, 'gross_exposure' AS problem FROM ({_BROKEN}) GROUP BY 1, 2
          HAVING NOT (SUM(ABS(weight)) BETWEEN 0.25 - 1e-6 AND 1 + 1e-6)
        UNION ALL SELECT model, k, 'sum_not_one' FROM ({_BROKEN}) WHERE ABS(Rank1 + Rank2 + Rank3 + Rank4 + Rank5 - 1) > 1e-6
        UNION ALL SELECT model, k, 'negative_probability' FROM ({_BROKEN}) WHERE LEAST(Rank1, Rank2, Rank3, Rank4, Rank5) < -1e-6
        UNION ALL SELECT f.model, f.k, 'missing_symbol' FROM fc f WHERE f.model = 'T05' AND f.k < 3 AND f.symbol LIKE '%.L'
        ) GROUP BY 1, 2, 3""",
    )
)
def forecast_violations(spark, folder):
    p = panels(spark, folder)
    broken = p.forecasts.where("NOT (model = 'T05' AND k < 3 AND symbol LIKE '%.L')").selectExpr(
        "model", "k", "symbol",
        "Rank1 - CASE WHEN model = 'T03' AND k = 5 THEN 0.5D ELSE 0D END AS Rank1",
        "Rank2", "Rank3", "Rank4", "Rank5",
        "weight * CASE WHEN model = 'T04' THEN 1.5D ELSE 1D END AS weight",
    )
    return fc.forecast_violations(broken, p.members)


@query(with_parts("turn", "SELECT model, k, ROUND(turnover, 9) AS turnover FROM turn"))
def turnover(spark, folder):
    p = panels(spark, folder)
    return rounded(pf.turnover(p.forecasts, p.calendar, ["model"]).drop("repeated"), turnover=9)


@query(with_parts("net", "SELECT model, k, date, is_first, ROUND(ret, 9) AS ret, ROUND(ret_net, 9) AS ret_net FROM net"))
def walk_forward_daily(spark, folder):
    return rounded(panels(spark, folder).walk.daily, ret=9, ret_net=9)


_PERIOD = (
    "SELECT model, k, label, phase, origin, end_date, n_assets, ROUND(rps, 9) AS rps, ROUND(ir, 6) AS ir, "
    "ROUND(ir_net, 6) AS ir_net, ROUND(turnover, 9) AS turnover FROM periods{0}"
)


@query(with_parts("periods", _PERIOD.format("")))
def walk_forward_periods(spark, folder):
    return rounded(panels(spark, folder).walk.periods, rps=9, ir=6, ir_net=6, turnover=9)


@query(with_parts("periods_d2", _PERIOD.format("_d2")))
def walk_forward_periods_point_in_time(spark, folder):
    return rounded(panels(spark, folder).walk_d2.periods, rps=9, ir=6, ir_net=6, turnover=9)


_SHARPE = "ROUND(CASE WHEN STDDEV_SAMP({0}) > 0 THEN AVG({0}) / STDDEV_SAMP({0}) * SQRT(252) END, 6)"


@query(
    with_parts(
        "periods",
        "SELECT a.*, b.ir, b.ir_net, b.sharpe, b.sharpe_net FROM (SELECT model, phase, COUNT(*) AS n_periods, ROUND(AVG(rps), 9) AS rps FROM periods GROUP BY 1, 2) a "
        "JOIN (SELECT model, phase, ROUND(SUM(ret) / STDDEV_SAMP(ret), 6) AS ir, ROUND(SUM(ret_net) / STDDEV_SAMP(ret_net), 6) AS ir_net, "
        f"{_SHARPE.format('ret')} AS sharpe, {_SHARPE.format('ret_net')} AS sharpe_net "
        "FROM net JOIN cal USING (k) GROUP BY 1, 2) b USING (model, phase)",
    )
)
def walk_forward_summary(spark, folder):
    return rounded(
        panels(spark, folder).walk.summary(), rps=9, ir=6, ir_net=6, sharpe=6, sharpe_net=6
    )


@query(with_parts("subs", "SELECT Team, Submission, Evaluation, Symbol, ROUND(Decision, 12) AS Decision, "
                  f"{_R}, IsActive, k FROM subs"))
def submissions(spark, folder):
    p = panels(spark, folder)
    return rounded(p.submissions, Decision=12, **{c: 9 for c in RANKS})


@query(with_parts("tscores", "SELECT team, k, ROUND(rps, 9) AS rps, fresh FROM tscores"))
def team_scores(spark, folder):
    return rounded(panels(spark, folder).team_scores.table, rps=9)


@query(with_parts("tdaily", "SELECT team, k, date, ROUND(ret, 9) AS ret FROM tdaily"))
def team_daily_returns(spark, folder):
    return rounded(panels(spark, folder).team_scores.daily, ret=9)


_SUM = "level, period, team, ROUND(rps, 9) AS rps, ROUND(ir, 6) AS ir, ROUND(returns, 9) AS returns, ROUND(risk, 9) AS risk"


@query(with_parts("summary0", f"SELECT {_SUM} FROM summary0"))
def team_summaries(spark, folder):
    p = panels(spark, folder)
    out = lb.leaderboard(p.team_scores, zero_variance=None, ranked=False)
    return rounded(out, rps=9, ir=6, returns=9, risk=9)


@query(with_parts("board", f"SELECT {_SUM}, rps_rank, ir_rank, overall_rank, position FROM board"))
def leaderboard(spark, folder):
    p = panels(spark, folder)
    return rounded(lb.leaderboard(p.team_scores), rps=9, ir=6, returns=9, risk=9)


def _bench(compare_to: str) -> str:
    ref = "level = 'global'" if compare_to == "global" else "level = t.level AND period = t.period"
    better = (
        "AVG(CAST(COALESCE(t.ir > r.ir, TRUE) AS INT))"
        if compare_to == "global"
        else "AVG(CASE WHEN t.ir IS NOT NULL THEN CAST(t.ir > r.ir AS INT) END)"
    )
    on = "r.level = 'global'" if compare_to == "global" else "r.level = t.level AND r.period = t.period"
    return with_parts(
        "summary0",
        f"""SELECT a.*, ROUND(o.returns, 9) AS bench_returns, ROUND(o.risk, 9) AS bench_risk, ROUND(o.ir, 6) AS bench_ir FROM (
        SELECT t.level, t.period, COUNT(*) AS n_teams,
        ROUND(100 * AVG(CAST(t.returns > r.returns AS INT)), 6) AS better_returns_pct,
        ROUND(100 * AVG(CAST(t.risk < r.risk AS INT)), 6) AS better_risk_pct,
        ROUND(100 * {better}, 6) AS better_ir_pct,
        ROUND(AVG(t.returns), 9) AS mean_returns, ROUND(AVG(t.risk), 9) AS mean_risk, ROUND(AVG(t.ir), 6) AS mean_ir,
        ROUND(STDDEV_SAMP(t.returns), 9) AS sd_returns, ROUND(STDDEV_SAMP(t.risk), 9) AS sd_risk, ROUND(STDDEV_SAMP(t.ir), 6) AS sd_ir
        FROM summary0 t JOIN summary0 r ON r.team = '{BENCHMARK_TEAM}' AND {on}
        WHERE t.level IN ('month', 'global') AND t.team IN (
          SELECT g.team FROM summary0 g, summary0 b WHERE g.level = 'global' AND b.level = 'global'
          AND b.team = '{BENCHMARK_TEAM}' AND ABS(g.ir - b.ir) > 1e-12)
        GROUP BY 1, 2) a JOIN summary0 o ON o.team = '{BENCHMARK_TEAM}' AND o.level = a.level AND o.period = a.period""",
    )


def _bench_query(spark, folder, compare_to):
    p = panels(spark, folder)
    out = lb.benchmark_table(p.team_scores, BENCHMARK_TEAM, compare_to)
    digits = {c: 9 for c in out.columns if c.endswith(("returns", "risk"))}
    digits |= {c: 6 for c in out.columns if c.endswith(("_ir", "pct"))}
    return rounded(out, **digits)


@query(_bench("global"))
def benchmark_table(spark, folder):
    return _bench_query(spark, folder, "global")


@query(_bench("period"))
def benchmark_table_by_period(spark, folder):
    return _bench_query(spark, folder, "period")


@query(
    with_parts(
        "summary1",
        f"""SELECT COUNT(*) AS teams, COUNT(*) FILTER (ROUND(t.rps, 6) < 0.16) AS better_rps,
        COUNT(*) FILTER (t.ir > b.ir) AS better_ir, COUNT(*) FILTER (ROUND(t.rps, 6) < 0.16 AND t.ir > b.ir) AS both
        FROM summary1 t JOIN summary1 b ON b.level = 'global' AND b.team = '{BENCHMARK_TEAM}' WHERE t.level = 'global'""",
    )
)
def beat_benchmark(spark, folder):
    p = panels(spark, folder)
    return lb.beat_benchmark(lb.leaderboard(p.team_scores, ("global",)), BENCHMARK_TEAM)


_OFFICIAL = (
    "SELECT level, period, team, ROUND(rps, 5) AS rps, ROUND(ir, 5) AS ir, rps_rank, ir_rank, overall_rank, "
    "position + CASE WHEN team = 'T07' THEN 1 ELSE 0 END AS position FROM board WHERE NOT (level = 'month' AND team = 'T02')"
)


@query(
    with_parts(
        "board",
        f"""SELECT b.level, COUNT(*) AS rows, 0::BIGINT AS missing_in_reproduction,
        COUNT(*) FILTER (o.rps IS NULL) AS missing_in_official,
        ROUND(MAX(ABS(b.rps - o.rps)), 8) AS max_abs_diff_rps, ROUND(MAX(ABS(b.ir - o.ir)), 8) AS max_abs_diff_ir,
        COUNT(*) FILTER (COALESCE(b.rps_rank != o.rps_rank, TRUE)) AS mismatches_rps_rank,
        COUNT(*) FILTER (COALESCE(b.ir_rank != o.ir_rank, TRUE)) AS mismatches_ir_rank,
        COUNT(*) FILTER (COALESCE(b.overall_rank != o.overall_rank, TRUE)) AS mismatches_overall_rank,
        COUNT(*) FILTER (COALESCE(b.position != o.position, TRUE)) AS mismatches_position
        FROM board b LEFT JOIN ({_OFFICIAL}) o USING (level, period, team) GROUP BY 1""",
    )
)
def compare_official(spark, folder):
    p = panels(spark, folder)
    board = lb.leaderboard(p.team_scores)
    official = board.where("NOT (level = 'month' AND team = 'T02')").selectExpr(
        "level", "period", "team", "round(rps, 5) AS rps", "round(ir, 5) AS ir", "rps_rank", "ir_rank",
        "overall_rank", "position + CASE WHEN team = 'T07' THEN 1 ELSE 0 END AS position",
    )
    code = lb.leaderboard(p.team_scores, zero_variance=None, ranked=False)
    out = lb.comparison_checks(lb.compare_official(board, code, official))
    return rounded(out, max_abs_diff_rps=8, max_abs_diff_ir=8)


@query(
    with_parts(
        "summary0",
        """SELECT CAST(d AS INTEGER) AS decimals, ROUND(MAX(ABS(m - p)), 6) AS max_abs_diff, COUNT(*) AS cells FROM (
        SELECT 2 AS d, ROUND(100 * rps, 2) AS m, ROUND(100 * rps, 1) AS p FROM summary0 UNION ALL
        SELECT 3, ROUND(returns, 3), ROUND(returns, 2) FROM summary0) GROUP BY 1""",
    )
)
def compare_published(spark, folder):
    p = panels(spark, folder)
    table = lb.leaderboard(p.team_scores, zero_variance=None, ranked=False).withColumn(
        "rps", F.col("rps") * 100
    )
    published = rounded(table, rps=1, returns=2)
    key = ["level", "period", "team"]
    out = lb.compare_published(table, published, key, {"rps": 2, "returns": 3})
    return rounded(out, max_abs_diff=6)


@query(
    with_parts(
        "members targets",
        f"SELECT f.k, ROUND(AVG({rps_sql()}), 9) AS rps, COUNT(*) AS n_assets FROM ({uniform_sql('members')}) f "
        "JOIN targets t USING (k, symbol) GROUP BY 1",
    )
)
def uniform_rps(spark, folder):
    from crossrank.operators import targets as tg

    p = panels(spark, folder)
    targets = tg.quintile_targets(p.returns, ["k"], bounded=True)
    scored = tg.rps_per_asset(un.uniform_forecast(p.members), targets, ["k", "symbol"])
    return rounded(tg.mean_rps(scored, ["k"]), rps=9)
