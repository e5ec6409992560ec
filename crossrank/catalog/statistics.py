"""Significance, multiple-testing and association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.evaluation import rounded
from crossrank.catalog.fragments import PARTS, average_rank_sql, daily_sql, part, rps_sql, with_parts
from crossrank.functions.draws import uniform_int
from crossrank.operators import association as asc
from crossrank.operators import leaderboard as lb
from crossrank.operators import significance as sg
from crossrank.operators import targets as tg
from crossrank.plans import model_comparison as mc
from crossrank.schema import RANKS
from crossrank.sources.star_schema import BENCHMARK_TEAM, panels
from crossrank.staging import stage

AFTER = "1998-06-30"
BLOCKS = {"period1": 2, "period2": 4}
N_BOOT = N_DRAWS = 10_000
SEED = 2026


def t_cdf_sql(t: str, nu: str) -> str:
    """Student's t distribution function for integer degrees of freedom, as a finite sum."""
    a = f"ATAN(ABS({t}) / SQRT({nu}))"
    even = (
        f"SIN({a}) * COALESCE(list_sum([EXP(lgamma(j + 0.5) - lgamma(j + 1)) / SQRT(PI()) * POWER(COS({a}), 2*j) "
        f"for j in range(0, {nu} // 2)]), 0)"
    )
    odd = (
        f"2 / PI() * ({a} + SIN({a}) * COALESCE(list_sum([SQRT(PI()) / 2 * EXP(lgamma(j + 1) - lgamma(j + 1.5)) * "
        f"POWER(COS({a}), 2*j + 1) for j in range(0, ({nu} - 1) // 2)]), 0))"
    )
    both = f"(CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"
    return f"(CASE WHEN {t} < 0 THEN (1 - {both}) / 2 ELSE (1 + {both}) / 2 END)"


def diffs_part(name: str, periods: str) -> None:
    part(
        name,
        f"SELECT p.*, b.rps AS rps_uniform, b.ir_net AS ir_net_bench, p.rps - b.rps AS rps_diff FROM {periods} p "
        f"LEFT JOIN (SELECT * FROM {periods} WHERE model = 'uniform') b USING (phase, k)",
        periods,
    )
    tested = f"(SELECT * FROM {name} WHERE model != 'uniform')"
    part(
        f"fam_{name}",
        f"SELECT 'period1' AS family, 2 AS block, * FROM {tested} WHERE phase = 'period1' UNION ALL "
        f"SELECT 'period2', 4, * FROM {tested} WHERE phase = 'period2' UNION ALL "
        f"SELECT 'period2_late', 4, * FROM {tested} WHERE phase = 'period2' AND origin > DATE '{AFTER}'",
        name,
    )
    src = f"fam_{name}"
    part(
        f"dm_{name}",
        f"""SELECT *, CASE WHEN stat IS NULL THEN 1 ELSE {t_cdf_sql('stat', 'nu')} END AS p FROM (
        SELECT family, model, n, n - 1 AS nu, mean, better, CASE WHEN g > 0 THEN mean / SQRT(g / n) * SQRT((n - 1.0) / n) END AS stat FROM (
          SELECT family, model, COUNT(*) AS n, AVG(rps_diff) AS mean, AVG(CAST(rps_diff < 0 AS INT)) AS better, VAR_POP(rps_diff) AS g
          FROM {src} GROUP BY 1, 2))""",
        src,
    )
    part(
        f"num_{name}",
        f"""SELECT family, model, block, rps_diff, CAST(row_number() OVER (PARTITION BY family, model ORDER BY k) - 1 AS BIGINT) AS pos,
        COUNT(*) OVER (PARTITION BY family, model) AS n, AVG(rps_diff) OVER (PARTITION BY family, model) AS mean FROM {src}""",
        src,
    )
    part(
        f"resample_{name}",
        f"""SELECT x.family, x.model, x.mean, b.boot, ({uniform_int('b.boot', '(x.pos // x.block)', SEED)} % x.n + x.pos % x.block) % x.n AS pick
        FROM num_{name} x CROSS JOIN (SELECT unnest(range({N_BOOT})) AS boot) b""",
        f"num_{name}",
    )
    part(
        f"bootmean_{name}",
        f"""SELECT r.family, r.model, r.boot, MIN(r.mean) AS mean, AVG(y.rps_diff) AS m FROM resample_{name} r
        JOIN num_{name} y ON y.family = r.family AND y.model = r.model AND y.pos = r.pick GROUP BY 1, 2, 3""",
        f"num_{name}",
        f"resample_{name}",
    )
    part(
        f"boot_{name}",
        f"""SELECT family, model, MIN(mean) AS mean, (COUNT(*) FILTER (m - mean <= mean) + 1) / ({N_BOOT} + 1.0) AS p_boot,
        quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bootmean_{name} GROUP BY 1, 2""",
        f"bootmean_{name}",
    )
    part(
        f"tests_{name}",
        f"""SELECT *, LEAST(1, MAX(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm,
        LEAST(1, MIN(p * m / i) OVER (PARTITION BY family ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM (
        SELECT d.*, b.p_boot, b.lo, b.hi, row_number() OVER (PARTITION BY d.family ORDER BY d.p) AS i, COUNT(*) OVER (PARTITION BY d.family) AS m
        FROM dm_{name} d JOIN boot_{name} b USING (family, model))""",
        f"dm_{name}",
        f"boot_{name}",
    )


diffs_part("diffs", "periods")
diffs_part("diffs_d2", "periods_d2")


def _diffs(p, walk=None):
    return sg.loss_differentials((walk or p.walk).periods)


def _families(p, walk=None):
    tested = _diffs(p, walk).where("model != 'uniform'")
    return stage(sg.families(tested, AFTER, BLOCKS), "families")


def _tests(p, walk=None):
    return sg.family_tests(_families(p, walk), block="block", n_boot=N_BOOT, seed=SEED)


@query(with_parts("diffs", "SELECT model, phase, k, ROUND(rps_uniform, 9) AS rps_uniform, ROUND(rps_diff, 9) AS rps_diff, ROUND(ir_net_bench, 6) AS ir_net_bench FROM diffs"))
def loss_differentials(spark, folder):
    out = _diffs(panels(spark, folder)).select(
        "model", "phase", "k", "rps_uniform", "rps_diff", "ir_net_bench"
    )
    return rounded(out, rps_uniform=9, rps_diff=9, ir_net_bench=6)


@query(with_parts("fam_diffs", "SELECT family, model, k, block FROM fam_diffs"))
def test_families(spark, folder):
    return _families(panels(spark, folder)).select("family", "model", "k", "block")


@query(
    with_parts(
        "dm_diffs",
        "SELECT family, model, n, ROUND(mean, 9) AS mean_diff, ROUND(better, 9) AS share_better, ROUND(stat, 6) AS dm_stat, ROUND(p, 7) AS p_value FROM dm_diffs",
    )
)
def diebold_mariano(spark, folder):
    out = sg.diebold_mariano(_families(panels(spark, folder)), ["family", "model"])
    return rounded(out, mean_diff=9, share_better=9, dm_stat=6, p_value=7)


@query(
    with_parts(
        "fam_diffs",
        f"""SELECT family, model, n, ROUND(mean, 9) AS mean_diff, ROUND(better, 9) AS share_better, ROUND(stat, 6) AS dm_stat,
        ROUND(CASE WHEN stat IS NULL THEN 1 ELSE 2 * (1 - {t_cdf_sql('ABS(stat)', '(n - 1)')}) END, 7) AS p_value FROM (
        SELECT family, model, n, mean, better, CASE WHEN g > 0 THEN mean / SQRT(g / n) * SQRT((n - 3 + 2.0 / n) / n) END AS stat FROM (
          SELECT family, model, COUNT(*) AS n, AVG(d) AS mean, AVG(CAST(d < 0 AS INT)) AS better, (SUM(c * c) + 2 * SUM(c * nx)) / COUNT(*) AS g FROM (
            SELECT *, lead(c) OVER (PARTITION BY family, model ORDER BY k) AS nx FROM (
              SELECT family, model, k, rps_diff AS d, rps_diff - AVG(rps_diff) OVER (PARTITION BY family, model) AS c FROM fam_diffs))
          GROUP BY 1, 2))""",
    )
)
def diebold_mariano_two_sided(spark, folder):
    out = sg.diebold_mariano(
        _families(panels(spark, folder)), ["family", "model"], h=2, alternative="two-sided"
    )
    return rounded(out, mean_diff=9, share_better=9, dm_stat=6, p_value=7)


@query(
    with_parts(
        "boot_diffs",
        "SELECT family, model, ROUND(mean, 9) AS mean_diff, ROUND(p_boot, 9) AS p_boot, ROUND(lo, 8) AS ci_low, ROUND(hi, 8) AS ci_high FROM boot_diffs",
    )
)
def block_bootstrap(spark, folder):
    out = sg.block_bootstrap(
        _families(panels(spark, folder)), ["family", "model"], block="block", n_boot=N_BOOT, seed=SEED
    ).drop("n")
    return rounded(out, mean_diff=9, p_boot=9, ci_low=8, ci_high=8)


@query(
    with_parts(
        "tests_diffs",
        "SELECT family, model, ROUND(p, 7) AS p_value, ROUND(p_holm, 7) AS p_holm, ROUND(p_bh, 7) AS p_bh FROM tests_diffs",
    )
)
def adjusted_pvalues(spark, folder):
    dm = stage(sg.diebold_mariano(_families(panels(spark, folder)), ["family", "model"]), "dm")
    out = sg.adjust_pvalues(dm, ["family"]).select("family", "model", "p_value", "p_holm", "p_bh")
    return rounded(out, p_value=7, p_holm=7, p_bh=7)


_TEST = (
    "SELECT family, model, n AS n_periods, ROUND(mean, 9) AS mean_rps_diff, ROUND(better, 9) AS share_periods_better, "
    "ROUND(stat, 6) AS dm_stat, ROUND(p, 7) AS p_dm, ROUND(p_boot, 9) AS p_boot, ROUND(lo, 8) AS boot_ci_low, "
    "ROUND(hi, 8) AS boot_ci_high, ROUND(p_holm, 7) AS p_holm, ROUND(p_bh, 7) AS p_bh FROM {0}"
)


@query(with_parts("tests_diffs", _TEST.format("tests_diffs")))
def family_tests(spark, folder):
    out = _tests(panels(spark, folder))
    return rounded(
        out, mean_rps_diff=9, share_periods_better=9, dm_stat=6, p_dm=7, p_boot=9,
        boot_ci_low=8, boot_ci_high=8, p_holm=7, p_bh=7,
    )


@query(
    with_parts(
        "tests_diffs",
        """SELECT family, COUNT(*) AS comparisons, COUNT(*) FILTER (mean < 0) AS mean_diff_below_zero,
        COUNT(*) FILTER (p < 0.05) AS significant_raw, COUNT(*) FILTER (p_holm < 0.05) AS significant_holm,
        COUNT(*) FILTER (p_bh < 0.05) AS significant_bh, COUNT(*) FILTER (p_boot < 0.05) AS significant_boot_raw FROM tests_diffs GROUP BY 1""",
    )
)
def family_summary(spark, folder):
    return sg.family_summary(_tests(panels(spark, folder)))


@query(
    with_parts(
        "tests_diffs",
        f"""SELECT a.model, ROUND(a.mean, 9) AS rps_diff_period1, ROUND(a.p, 7) AS p_dm_period1, ROUND(b.mean, 9) AS rps_diff_period2,
        ROUND(b.p, 7) AS p_dm_period2, ROUND(b.p_holm, 7) AS p_holm_period2, ROUND(b.lo, 8) AS ci_low_period2, ROUND(b.hi, 8) AS ci_high_period2,
        CASE WHEN b.p_holm < 0.05 THEN '{sg.PERSISTS}' WHEN b.lo > 0 THEN '{sg.WORSE}' ELSE '{sg.SAME}' END AS verdict
        FROM tests_diffs a JOIN tests_diffs b ON a.model = b.model AND a.family = 'period1' AND b.family = 'period2'""",
    )
)
def persistence(spark, folder):
    out = sg.persistence(stage(_tests(panels(spark, folder)), "tests"))
    return rounded(
        out, rps_diff_period1=9, p_dm_period1=7, rps_diff_period2=9, p_dm_period2=7,
        p_holm_period2=7, ci_low_period2=8, ci_high_period2=8,
    )


@query(
    with_parts(
        "diffs net cal",
        "SELECT a.model, a.phase, a.n_periods, ROUND(a.rps, 9) AS rps, ROUND(b.ir, 6) AS ir, ROUND(b.ir_net, 6) AS ir_net, "
        "ROUND(a.u, 9) AS rps_uniform, ROUND(a.rps - a.u, 9) AS rps_diff FROM "
        "(SELECT model, phase, COUNT(*) AS n_periods, AVG(rps) AS rps, AVG(rps_uniform) AS u FROM diffs GROUP BY 1, 2) a JOIN "
        "(SELECT model, phase, SUM(ret) / STDDEV_SAMP(ret) AS ir, SUM(ret_net) / STDDEV_SAMP(ret_net) AS ir_net FROM net JOIN cal USING (k) GROUP BY 1, 2) b USING (model, phase)",
    )
)
def model_scores(spark, folder):
    p = panels(spark, folder)
    out = sg.model_scores(p.walk.summary().drop("sharpe", "sharpe_net"), _diffs(p))
    return rounded(out, rps=9, ir=6, ir_net=6, rps_uniform=9, rps_diff=9)


@query(
    with_parts(
        "tests_diffs tests_diffs_d2",
        """SELECT COUNT(*) AS n, COUNT(*) FILTER (b.p_holm < 0.05) AS significant, ROUND(MAX(ABS(b.mean - a.mean)), 9) AS max_change,
        bool_and((a.p_holm < 0.05) = (b.p_holm < 0.05)) AS same_set FROM tests_diffs a JOIN tests_diffs_d2 b USING (family, model) WHERE a.family = 'period2'""",
    )
)
def policy_sensitivity(spark, folder):
    p = panels(spark, folder)
    official = _tests(p).where("family = 'period2'")
    other = _tests(p, p.walk_d2).where("family = 'period2'")
    return rounded(sg.policy_sensitivity(official, other), max_change=9)


def _team_pairs(p):
    table = lb.leaderboard(p.team_scores, zero_variance=1.0, ranked=False)
    return stage(asc.complete_pairs(table, ["level", "period"], "rps", "ir", "team"), "team_pairs")


def _draws_sql(ranked: bool) -> str:
    """Bootstrap interval and permutation p of the team pairs, from the same integer draws."""
    x, y = ("rx", "ry") if ranked else ("x", "y")
    boot_src = (
        "SELECT level, period, boot, " + average_rank_sql("x", "level, period, boot") + " AS x, "
        + average_rank_sql("y", "level, period, boot") + " AS y FROM drawn"
        if ranked
        else "SELECT * FROM drawn"
    )
    h = "CAST('0x' || substr(md5(team), 1, 15) AS BIGINT)"
    order = f"{uniform_int('d.draw', 'a.pos', SEED + 1)} * 2147483648 + a.pos"
    return f"""pairs AS MATERIALIZED (SELECT level, period, team, rps AS x, ir AS y FROM summary1),
    num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY level, period ORDER BY {h}) - 1 AS pos, COUNT(*) OVER (PARTITION BY level, period) AS n,
      {average_rank_sql('x', 'level, period')} AS rx, {average_rank_sql('y', 'level, period')} AS ry FROM pairs),
    est AS MATERIALIZED (SELECT level, period, COUNT(*) AS n, CORR({x}, {y}) AS estimate FROM num GROUP BY 1, 2),
    draw AS MATERIALIZED (SELECT unnest(range({N_DRAWS})) AS draw),
    drawn AS MATERIALIZED (SELECT a.level, a.period, d.draw AS boot, b.x, b.y FROM num a CROSS JOIN draw d
      JOIN num b ON b.level = a.level AND b.period = a.period AND b.pos = {uniform_int('d.draw', 'a.pos', SEED)} % a.n),
    ci AS MATERIALIZED (SELECT level, period, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM (
      SELECT level, period, boot, CASE WHEN MAX(x) > MIN(x) AND MAX(y) > MIN(y) THEN CORR(x, y) END AS r FROM ({boot_src}) GROUP BY 1, 2, 3) WHERE r IS NOT NULL GROUP BY 1, 2),
    moved AS MATERIALIZED (SELECT a.level, a.period, d.draw, a.{x} AS x, row_number() OVER (PARTITION BY a.level, a.period, d.draw ORDER BY {order}) - 1 AS take FROM num a CROSS JOIN draw d),
    perm AS MATERIALIZED (SELECT level, period, (COUNT(*) FILTER (ROUND(ABS(r), 12) >= ROUND(ABS(estimate), 12)) + 1) / ({N_DRAWS} + 1.0) AS p FROM (
      SELECT m.level, m.period, m.draw, CORR(m.x, b.{y}) AS r FROM moved m JOIN num b ON b.level = m.level AND b.period = m.period AND b.pos = m.take GROUP BY 1, 2, 3) JOIN est USING (level, period) GROUP BY 1, 2)"""


def _association_sql(ranked: bool, method: str, holm: bool = False) -> str:
    head = with_parts("summary1", "").rstrip()
    extra = ""
    if holm:
        extra = (
            ", CASE WHEN level = 'month' THEN ROUND(LEAST(1, MAX(p * (m - i + 1)) OVER (PARTITION BY level ORDER BY p "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 7) END AS p_holm_monthly"
        )
    return (
        f"{head}, {_draws_sql(ranked)} SELECT level, period, '{method}' AS method, n, ROUND(estimate, 9) AS estimate, "
        f"ROUND(lo, 8) AS ci_low, ROUND(hi, 8) AS ci_high, ROUND(p, 9) AS p_perm{extra} FROM ("
        "SELECT *, row_number() OVER (PARTITION BY level ORDER BY p) AS i, COUNT(*) OVER (PARTITION BY level) AS m "
        "FROM est JOIN ci USING (level, period) JOIN perm USING (level, period))"
    )


_A = {"estimate": 9, "ci_low": 8, "ci_high": 8, "p_perm": 9}


@query(_association_sql(True, "spearman"))
def rank_correlation(spark, folder):
    out = asc.correlation(
        _team_pairs(panels(spark, folder)), ["level", "period"], "spearman", N_DRAWS, N_DRAWS, seed=SEED
    )
    return rounded(out, **_A)


@query(_association_sql(False, "pearson"))
def linear_correlation(spark, folder):
    out = asc.correlation(
        _team_pairs(panels(spark, folder)), ["level", "period"], "pearson", N_DRAWS, N_DRAWS, seed=SEED
    )
    return rounded(out, **_A)


@query(_association_sql(True, "spearman", holm=True))
def monthly_correlations(spark, folder):
    out = mc.correlations_by_level(
        _team_pairs(panels(spark, folder)), n_boot=N_DRAWS, n_perm=N_DRAWS, seed=SEED
    )
    return rounded(out, p_holm_monthly=7, **_A)


@query(
    with_parts(
        "diffs net cal",
        "SELECT phase, COUNT(*) AS n, ROUND(CORR(rx, ry), 9) AS estimate, 'spearman' AS method FROM (SELECT phase, "
        + average_rank_sql("x", "phase") + " AS rx, " + average_rank_sql("y", "phase") + " AS ry FROM "
        "(SELECT model, phase, ROUND(AVG(rps), 9) AS x FROM diffs GROUP BY 1, 2) JOIN "
        "(SELECT model, phase, ROUND(SUM(ret_net) / STDDEV_SAMP(ret_net), 6) AS y FROM net JOIN cal USING (k) GROUP BY 1, 2) USING (model, phase)) GROUP BY 1",
    )
)
def model_level_correlation(spark, folder):
    p = panels(spark, folder)
    table = rounded(p.walk.summary(), rps=9, ir_net=6)
    pairs = asc.complete_pairs(table, ["phase"], "rps", "ir_net", "model")
    return rounded(asc.correlation(pairs, ["phase"], n_boot=0, n_perm=0), estimate=9)


_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(
    with_parts(
        "summary1",
        f"""SELECT level, period, n00, n01, n10, n11, ROUND(CASE WHEN n01 * n10 > 0 THEN n00 * n11 / CAST(n01 * n10 AS DOUBLE) END, 9) AS odds_ratio,
        ROUND((SELECT SUM(EXP(m)) FROM (SELECT {_LC.format('(n00 + n01)', 'i')} + {_LC.format('(n10 + n11)', '(n00 + n10 - i)')} - {_LC.format('(n00 + n01 + n10 + n11)', '(n00 + n10)')} AS m
          FROM (SELECT unnest(range(GREATEST(0, n00 - n11), LEAST(n00 + n01, n00 + n10) + 1)) AS i))
          WHERE EXP(m) <= EXP({_LC.format('(n00 + n01)', 'n00')} + {_LC.format('(n10 + n11)', 'n10')} - {_LC.format('(n00 + n01 + n10 + n11)', '(n00 + n10)')}) * (1 + 1e-7)), 7) AS p_value
        FROM (SELECT t.level, t.period, COUNT(*) FILTER (NOT a AND NOT b) AS n00, COUNT(*) FILTER (NOT a AND b) AS n01,
          COUNT(*) FILTER (a AND NOT b) AS n10, COUNT(*) FILTER (a AND b) AS n11 FROM (
          SELECT s.level, s.period, s.rps < r.rps AS a, s.ir > r.ir AS b FROM summary1 s JOIN summary1 r
            ON r.level = s.level AND r.period = s.period AND r.team = '{BENCHMARK_TEAM}') t GROUP BY 1, 2)""",
    )
)
def fisher_exact(spark, folder):
    p = panels(spark, folder)
    table = lb.leaderboard(p.team_scores, ranked=False)
    ref = table.where(F.col("team") == BENCHMARK_TEAM).selectExpr("level", "period", "rps AS r", "ir AS i")
    flags = table.join(F.broadcast(ref), ["level", "period"]).selectExpr(
        "level", "period", "rps < r AS by_rps", "ir > i AS by_ir"
    )
    out = asc.fisher_table(flags, ["level", "period"], "by_rps", "by_ir")
    return rounded(out, odds_ratio=9, p_value=7)


_OFF = ", ".join(f"ABS(Rank{q} - 0.2)" for q in range(1, 6))


@query(
    with_parts(
        "subs",
        f"SELECT Team, bool_and(GREATEST({_OFF}) < 1e-9) AS uniform_forecast, bool_and(GREATEST({_OFF}) < 1e-9 AND ABS(Decision - 0.01) < 1e-9) AS benchmark_copy "
        "FROM subs WHERE k BETWEEN 1 AND 12 GROUP BY 1",
    )
)
def forecast_profiles(spark, folder):
    p = panels(spark, folder)
    return asc.forecast_profiles(p.submissions, p.submissions.select("Team").distinct())


@query(
    with_parts(
        "subs",
        f"SELECT Team, Evaluation, ROUND(AVG(list_sum([{_OFF}]) / 5), 9) AS mean_abs_dev_uniform, ROUND(MAX(GREATEST({_OFF})), 9) AS max_abs_dev_uniform, "
        "ROUND(SUM(ABS(Decision)), 9) AS gross_exposure, FIRST(Symbol ORDER BY -ABS(Decision), Symbol) AS largest_position, "
        "ROUND(FIRST(Decision ORDER BY -ABS(Decision), Symbol), 9) AS largest_weight FROM subs GROUP BY 1, 2",
    )
)
def team_months(spark, folder):
    out = asc.team_months(panels(spark, folder).submissions)
    return rounded(
        out, mean_abs_dev_uniform=9, max_abs_dev_uniform=9, gross_exposure=9, largest_weight=9
    )


_CELLS = " UNION ALL ".join(
    f"SELECT s.Team AS team, s.k, s.symbol, h.Rank{q} - 0.2 AS x, s.Rank{q} - 0.2 AS y FROM subs s JOIN hist h ON h.k = s.k AND h.symbol = s.Symbol"
    for q in range(1, 6)
)


@query(
    with_parts(
        "subs hist targets",
        f"""SELECT a.team, a.k, ROUND(a.corr, 8) AS corr, ROUND(a.shrink, 8) AS shrink, ROUND(mad, 9) AS mean_abs_diff, ROUND(mxd, 9) AS max_abs_diff,
        ROUND(mar, 9) AS mean_abs_resid, ROUND(mxr, 9) AS max_abs_resid, ROUND(s.rps, 9) AS rps_submission, ROUND(h.rps, 9) AS rps_reproduction FROM (
          SELECT c.team, c.k, ANY_VALUE(f.corr) AS corr, ANY_VALUE(f.shrink) AS shrink, AVG(ABS(x - y)) AS mad, MAX(ABS(x - y)) AS mxd,
          AVG(ABS(y - f.shrink * x)) AS mar, MAX(ABS(y - f.shrink * x)) AS mxr
          FROM ({_CELLS}) c JOIN (SELECT team, k, CORR(x, y) AS corr, SUM(x*y) / SUM(x*x) AS shrink FROM ({_CELLS}) GROUP BY 1, 2) f USING (team, k) GROUP BY 1, 2) a
        JOIN (SELECT f.Team AS team, f.k, AVG({rps_sql()}) AS rps FROM subs f JOIN targets t USING (k, symbol) GROUP BY 1, 2) s USING (team, k)
        JOIN (SELECT f.k, AVG({rps_sql()}) AS rps FROM hist f JOIN targets t USING (k, symbol) GROUP BY 1) h USING (k)""",
    )
)
def fidelity(spark, folder):
    p = panels(spark, folder)
    submitted = p.team_forecasts.withColumnRenamed("model", "team")
    targets = tg.quintile_targets(p.returns, ["k"], bounded=True)
    out = asc.fidelity(p.history_forecast.select("k", "symbol", *RANKS), submitted, targets, ["team"])
    return rounded(
        out, corr=8, shrink=8, mean_abs_diff=9, max_abs_diff=9, mean_abs_resid=9, max_abs_resid=9,
        rps_submission=9, rps_reproduction=9,
    )


_SPREAD = " UNION ALL ".join(
    f"SELECT k, Symbol, {q} AS q, MAX(Rank{q}) - MIN(Rank{q}) AS s FROM subs GROUP BY 1, 2" for q in range(1, 6)
)


@query(with_parts("subs", f"SELECT k, ROUND(MAX(s), 9) AS max_abs_diff_across_seeds, ROUND(AVG(s), 9) AS mean_abs_diff_across_seeds FROM ({_SPREAD}) GROUP BY 1"))
def seed_spread(spark, folder):
    out = asc.seed_spread(panels(spark, folder).team_forecasts)
    return rounded(out, max_abs_diff_across_seeds=9, mean_abs_diff_across_seeds=9)


@query(
    with_parts(
        "tests_diffs diffs net cal board",
        """SELECT t.model, ROUND(a.mean, 9) AS rps_diff_p1, ROUND(a.p_holm, 7) AS p_holm_p1, ROUND(t.mean, 9) AS rps_diff_p2,
        ROUND(t.p_holm, 7) AS p_holm_p2, ROUND(t.better, 9) AS share_better_p2, ROUND(-t.mean / u.rps, 9) AS relative_gain_p2,
        ROUND(l.mean, 9) AS rps_diff_late, ROUND(l.p_holm, 7) AS p_holm_late FROM tests_diffs t
        JOIN tests_diffs a ON a.model = t.model AND a.family = 'period1' JOIN tests_diffs l ON l.model = t.model AND l.family = 'period2_late'
        CROSS JOIN (SELECT AVG(rps) AS rps FROM diffs WHERE model = 'uniform' AND phase = 'period2') u WHERE t.family = 'period2'""",
    )
)
def headline_significance(spark, folder):
    p = panels(spark, folder)
    out = mc.headline_table(stage(_tests(p), "tests"), p.walk.periods)
    return rounded(
        out, rps_diff_p1=9, p_holm_p1=7, rps_diff_p2=9, p_holm_p2=7, share_better_p2=9,
        relative_gain_p2=9, rps_diff_late=9, p_holm_late=7,
    )


_SCORE = " + ".join(f"{q} * Rank{q}" for q in range(1, 6))
part(
    "fc_weightings",
    "SELECT model || '|equal' AS model, k, symbol, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY model, k) AS weight FROM fc UNION ALL "
    "SELECT model || '|expected_rank', k, symbol, CASE WHEN SUM(ABS(s)) OVER (PARTITION BY model, k) = 0 THEN 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY model, k) "
    f"ELSE s / SUM(ABS(s)) OVER (PARTITION BY model, k) END FROM (SELECT *, ROUND({_SCORE} - 3, 12) AS s FROM fc)",
    "fc",
)
part("daily_weightings", daily_sql("fc_weightings"), "fc_weightings", "dayk", "spell")


@query(
    with_parts(
        "daily_weightings cal",
        "SELECT split_part(model, '|', 1) AS model, phase, ROUND(SUM(ret) FILTER (model LIKE '%|equal') / STDDEV_SAMP(ret) FILTER (model LIKE '%|equal'), 6) AS ir_equal, "
        "ROUND(SUM(ret) FILTER (model LIKE '%rank') / STDDEV_SAMP(ret) FILTER (model LIKE '%rank'), 6) AS ir_expected_rank "
        "FROM daily_weightings JOIN cal USING (k) GROUP BY 1, 2",
    )
)
def headline_weightings(spark, folder):
    """Pooled IR of every model's stored probabilities under both weightings, per phase."""
    p = panels(spark, folder)
    return rounded(mc.weighting_table(p.forecasts, p.prices, p.calendar, p.days), ir_equal=6, ir_expected_rank=6)


assert "tests_diffs" in PARTS
