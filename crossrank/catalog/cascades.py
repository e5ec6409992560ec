"""Queries of the learners: candidates, search, forecasts and the bias cascade."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.evaluation import rounded
from crossrank.catalog.fragments import (
    FEATURES, daily_sql, net_sql, part, periods_sql, rps_sql, targets_sql, turnover_sql, uniform_sql, variant, with_parts,
)
from crossrank.catalog.learning import _base_features, _base_signals, _samples
from crossrank.catalog.statistics import N_BOOT, SEED, t_cdf_sql
from crossrank.functions.draws import uniform_int
from crossrank.operators import bin_tables as bt
from crossrank.operators import boosting as bo
from crossrank.operators import calendar as cal
from crossrank.operators import features as ft
from crossrank.operators import samples as sm
from crossrank.operators import universe as un
from crossrank.plans import cascade as cs
from crossrank.plans import walk_forward as wf
from crossrank.schema import RANKS
from crossrank.sources.star_schema import COST_BPS, panels
from crossrank.staging import placed_joins, stage

SEARCH = cs.Search(seed=SEED)
GRID = SEARCH.grid
_Q = range(1, 6)
_R9 = dict.fromkeys(RANKS, 9)

# ---- SQL of the learner --------------------------------------------------------------------

part(
    "survivors",
    "SELECT DISTINCT CASE WHEN sk % 25 = 7 THEN 'S' || (sk + 1) || CASE WHEN (sk + 1) % 5 = 0 THEN '.L' ELSE '' END "
    "ELSE symbol END AS symbol FROM syms WHERE NOT (sk % 25 = 7 AND sk % 50 = 7)",
    "syms",
)
part(
    "nwsamples",
    "SELECT t.wb AS base_date, t.we AS end_date, t.symbol, " + ", ".join(f"f.{c}" for c in FEATURES)
    + ", Target1, Target2, Target3, Target4, Target5 FROM wtargets t LEFT JOIN naive f ON f.symbol = t.symbol AND f.date = t.wb WHERE t.n >= 5",
    "wtargets",
    "naive",
)
variant(
    "_sv",
    {"prices": ("SELECT p.* FROM prices p WHERE symbol IN (SELECT symbol FROM survivors)", "survivors")},
    "samples nwsamples wksamples basefeat naive",
    "days labels0 grid cal dayk win lastwin weekly syms survivors",
)
part("late", "SELECT k, base_date FROM cal WHERE phase = 'period2'", "cal")
part("members_sv", "SELECT m.k, m.symbol FROM members m JOIN late USING (k) JOIN survivors USING (symbol)", "members", "late", "survivors")
part("members_pit", "SELECT m.k, m.symbol FROM members_d2 m JOIN late USING (k)", "members_d2", "late")
part("winsplit", "SELECT w.k, wb AS base_date, we AS end_date, row_number() OVER (PARTITION BY w.k ORDER BY wb DESC) AS b FROM win w JOIN late USING (k)", "win", "late")


def coded_sql(source: str, keep: str, kind: str) -> str:
    low, high = bt.RANGES[kind]
    bins = ", ".join(
        f"CASE WHEN {f} IS NULL THEN {b} ELSE CAST(GREATEST(0, LEAST({b - 1}, FLOOR(({f} - {low}::DOUBLE) / {high - low}::DOUBLE * {b}))) AS INTEGER) END AS b{b}_{i}"
        for b in GRID.bins for i, f in enumerate(FEATURES)
    )
    cells = ", ".join(
        f"struct_pack(round := {t}, bins := {b}, cell := {f' * {b + 1} + '.join(f'b{b}_{i}' for i in table)})"
        for b in GRID.bins for t, table in enumerate(bt.TABLES, 1)
    )
    return (
        f"SELECT {keep}, u.round AS round, u.bins AS bins, u.cell AS cell FROM (SELECT {keep}, unnest([{cells}]) AS u "
        f"FROM (SELECT {keep}, {bins} FROM {source}))"
    )


_T = ", ".join(f"Target{q}" for q in _Q)
_SUMS = ", ".join(f"SUM(Target{q}) AS c{q}" for q in _Q)
_MORE = "SUM(n) AS n, " + ", ".join(f"SUM(c{q}) AS c{q}" for q in _Q)


def cells_sql(source: str, by: str, kind: str) -> str:
    return f"SELECT {by}, round, bins, cell, COUNT(*) AS n, {_SUMS} FROM ({coded_sql(source, f'{by}, {_T}', kind)}) GROUP BY ALL"


def fitted_sql(cells: str, uses: str, on: str, model: str) -> str:
    return f"SELECT {model}, round, bins, cell, {_MORE} FROM {cells} JOIN {uses} USING ({on}) GROUP BY ALL"


def predicted_sql(rows: str, ids: str, model: str, tables: str, kind: str) -> str:
    configs = ", ".join(f"({i}, {b}, {a}::DOUBLE)" for i, b, a in GRID.configs())
    shares = ", ".join(f"(COALESCE(t.c{q}, 0) + 0.2::DOUBLE * g.a) / (COALESCE(t.n, 0) + g.a) AS c{q}" for q in _Q)
    means = ", ".join(f"SUM(c{q}) OVER w / round AS Rank{q}" for q in _Q)
    kept = ", ".join(f"r.{c.strip()}" for c in ids.split(","))
    return (
        f"SELECT {ids}, config, round AS rounds, {means} FROM (SELECT {kept}, g.config, r.round, {shares} "
        f"FROM ({coded_sql(rows, ids, kind)}) r JOIN (VALUES {configs}) g(config, bins, a) ON g.bins = r.bins "
        f"LEFT JOIN {tables} t ON t.{model} = r.{model} AND t.round = r.round AND t.bins = r.bins AND t.cell = r.cell) "
        f"WINDOW w AS (PARTITION BY {ids}, config ORDER BY round ROWS UNBOUNDED PRECEDING)"
    )


def best_sql(candidates: str) -> str:
    """Scores of the candidates on the evaluated periods, and the chosen one."""
    return (
        "SELECT *, row_number() OVER (ORDER BY rps, config, rounds) = 1 AS chosen FROM (SELECT config, rounds, AVG(rps) AS rps FROM ("
        f"SELECT config, rounds, f.k, ROUND(AVG({rps_sql()}), 12) AS rps FROM {candidates} f JOIN mtargets_steps t USING (k, symbol) "
        "GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    )


_ASKED = f"rounds IN ({', '.join(map(str, GRID.rounds))})"
_FOLD = "CAST(CAST('0x' || substr(md5(concat(symbol, '|', CAST(base_date AS VARCHAR), '|2026')), 1, 8) AS BIGINT) % 5 AS INTEGER)"
part("mtargets_steps", targets_sql("(SELECT r.k, r.symbol, r.ret FROM rets r JOIN members_sv m USING (k, symbol))", "k"), "rets", "members_sv")

# s0: folds
part("folded", f"SELECT *, {_FOLD} AS fold FROM wksamples_sv", "wksamples_sv")
part("cells_s0", cells_sql("folded", "fold", "scores"), "folded")
part("others", "SELECT a AS fold0, b AS fold FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE a <> b")
part("tables_s0", fitted_sql("cells_s0", "others", "fold", "fold0"), "cells_s0", "others")
part("tests_s0", "SELECT c.k, f.fold AS fold0, f.* FROM folded f JOIN late c ON c.base_date = f.base_date", "folded", "late")
part("cand_s0", f"SELECT * FROM ({predicted_sql('tests_s0', 'k, symbol, fold0', 'fold0', 'tables_s0', 'scores')}) WHERE {_ASKED}", "tests_s0", "tables_s0")
# s1: past bases; s2, s3: purged windows
part("past", "SELECT c.k, s.base_date, s.end_date FROM (SELECT DISTINCT base_date, end_date FROM wksamples_sv) s JOIN late c ON s.base_date < c.base_date", "wksamples_sv", "late")
part("rows_naive", "SELECT m.k, m.symbol, " + ", ".join(f"f.{c}" for c in FEATURES) + " FROM members_sv m JOIN late USING (k) LEFT JOIN naive_sv f ON f.symbol = m.symbol AND f.date = late.base_date", "members_sv", "late", "naive_sv")
part("rows_clean", "SELECT m.k, m.symbol, " + ", ".join(f"f.{c}" for c in FEATURES) + " FROM members_sv m JOIN late USING (k) LEFT JOIN basefeat_sv f ON f.symbol = m.symbol AND f.date = late.base_date", "members_sv", "late", "basefeat_sv")
for _step, _source, _uses, _rows, _kind in (
    ("s1", "wksamples_sv", "past", "tests_s0", "scores"),
    ("s2", "nwsamples_sv", "winsplit", "rows_naive", "scores"),
    ("s3", "samples_sv", "winsplit", "rows_clean", "ranks"),
):
    part(f"cells_{_step}", cells_sql(_source, "base_date, end_date", _kind), _source)
    part(f"tables_{_step}", fitted_sql(f"cells_{_step}", _uses, "base_date, end_date", "k"), f"cells_{_step}", _uses)
    part(f"cand_{_step}", f"SELECT * FROM ({predicted_sql(_rows, 'k, symbol', 'k', f'tables_{_step}', _kind)}) WHERE {_ASKED}", _rows, f"tables_{_step}")
for _step in ("s0", "s1", "s2", "s3"):
    part(f"best_{_step}", best_sql(f"cand_{_step}"), f"cand_{_step}", "mtargets_steps")

# s4, s5: the search inside each origin's past
part("rows_pit", "SELECT m.k, m.symbol, " + ", ".join(f"f.{c}" for c in FEATURES) + " FROM members_pit m JOIN late USING (k) LEFT JOIN basefeat f ON f.symbol = m.symbol AND f.date = late.base_date", "members_pit", "late", "basefeat")
for _step, _source, _rows in (("s4", "samples_sv", "rows_clean"), ("s5", "samples", "rows_pit")):
    if _step == "s5":
        part("cells_s5", cells_sql("samples", "base_date, end_date", "ranks"), "samples")
    else:
        part("cells_s4", "SELECT * FROM cells_s3", "cells_s3")
    part(f"enough_{_step}", f"SELECT * FROM (SELECT *, COUNT(*) FILTER (b > {SEARCH.n_val + SEARCH.embargo}) OVER (PARTITION BY k) AS trained FROM winsplit) WHERE trained >= {SEARCH.min_train_windows}", "winsplit")
    part(f"strain_{_step}", f"SELECT k, round, bins, cell, {_MORE} FROM cells_{_step} JOIN enough_{_step} USING (base_date, end_date) WHERE b > {SEARCH.n_val + SEARCH.embargo} GROUP BY ALL", f"cells_{_step}", f"enough_{_step}")
    part(f"sval_{_step}", f"SELECT e.k, s.* FROM {_source} s JOIN enough_{_step} e USING (base_date, end_date) WHERE e.b <= {SEARCH.n_val}", _source, f"enough_{_step}")
    part(
        f"srps_{_step}",
        f"SELECT k, config, rounds, ROUND(AVG(rps), 12) AS rps FROM (SELECT k, base_date, config, rounds, AVG({rps_sql()}) AS rps FROM "
        f"({predicted_sql(f'sval_{_step}', 'k, base_date, end_date, symbol', 'k', f'strain_{_step}', 'ranks')}) f "
        f"JOIN {_source} t USING (base_date, end_date, symbol) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
        f"sval_{_step}", f"strain_{_step}", _source,
    )
    part(
        f"search_{_step}",
        "SELECT *, row_number() OVER (PARTITION BY k ORDER BY val_rps, config) = 1 AS chosen FROM ("
        "SELECT k, config, arg_min(rounds, (rps, rounds)) AS rounds, MAX(rounds) AS stopped_at, MIN(rps) AS val_rps FROM ("
        f"SELECT *, MIN(CASE WHEN age >= {SEARCH.patience} THEN rounds END) OVER (PARTITION BY k, config) AS stop FROM ("
        "SELECT *, rounds - MAX(CASE WHEN better THEN rounds END) OVER (PARTITION BY k, config ORDER BY rounds) AS age FROM ("
        "SELECT *, COALESCE(rps < lag(low) OVER (PARTITION BY k, config ORDER BY rounds), true) AS better FROM ("
        f"SELECT *, MIN(rps) OVER (PARTITION BY k, config ORDER BY rounds) AS low FROM srps_{_step})))) "
        "WHERE rounds <= COALESCE(stop, rounds) GROUP BY 1, 2)",
        f"srps_{_step}",
    )
    if _step == "s5":
        part("tables_s5", fitted_sql("cells_s5", "winsplit", "base_date, end_date", "k"), "cells_s5", "winsplit")
    else:
        part("tables_s4", "SELECT * FROM tables_s3", "tables_s3")
    part(
        f"honest_{_step}",
        "SELECT r.k, r.symbol, " + ", ".join(f"COALESCE(f.Rank{q}, 0.2::DOUBLE) AS Rank{q}" for q in _Q)
        + f" FROM {_rows} r LEFT JOIN (SELECT * FROM ({predicted_sql(_rows, 'k, symbol', 'k', f'tables_{_step}', 'ranks')}) "
        f"JOIN (SELECT k, config, rounds FROM search_{_step} WHERE chosen) USING (k, config, rounds)) f ON f.k = r.k AND f.symbol = r.symbol",
        _rows, f"tables_{_step}", f"search_{_step}",
    )


def _tilted_sql(step: str, probs: str) -> str:
    score = " + ".join(f"{q} * Rank{q}" for q in _Q)
    ranks = ", ".join(f"Rank{q}" for q in _Q)
    return (
        f"SELECT '{step}' AS model, k, symbol, {ranks}, CASE WHEN SUM(ABS(s)) OVER (PARTITION BY k) = 0 THEN 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY k) "
        f"ELSE s / SUM(ABS(s)) OVER (PARTITION BY k) END AS weight FROM (SELECT *, {score} - 3 AS s FROM ({probs}))"
    )


_CHOSEN = [f"SELECT c.k, c.symbol, " + ", ".join(f"c.Rank{q}" for q in _Q) + f" FROM cand_{s} c JOIN best_{s} b USING (config, rounds) WHERE b.chosen" for s in ("s0", "s1", "s2", "s3")]
part(
    "fc_steps",
    " UNION ALL ".join([uniform_sql("members_sv"), *[_tilted_sql(f"s{i}", q) for i, q in enumerate([*_CHOSEN, "SELECT * FROM honest_s4"])]]),
    "members_sv", *[f"{a}_{s}" for s in ("s0", "s1", "s2", "s3") for a in ("cand", "best")], "honest_s4",
)
part("fc_pit", f"{uniform_sql('members_pit')} UNION ALL {_tilted_sql('s5', 'SELECT * FROM honest_s5')}", "members_pit", "honest_s5")
part("mtargets_pit", targets_sql("(SELECT r.k, r.symbol, r.ret FROM rets r JOIN members_pit m USING (k, symbol))", "k"), "rets", "members_pit")
for _suffix in ("_steps", "_pit"):
    part(f"turn{_suffix}", turnover_sql(f"fc{_suffix}"), f"fc{_suffix}")
    part(f"gross{_suffix}", daily_sql(f"fc{_suffix}"), f"fc{_suffix}", "dayk", "spell")
    part(f"net{_suffix}", net_sql(f"gross{_suffix}", f"turn{_suffix}"), f"gross{_suffix}", f"turn{_suffix}")
    part(
        f"periods{_suffix}", periods_sql(f"fc{_suffix}", f"mtargets{_suffix}", f"net{_suffix}", f"turn{_suffix}"),
        f"fc{_suffix}", f"mtargets{_suffix}", f"net{_suffix}", f"turn{_suffix}", "cal",
    )

# ---- the report ----------------------------------------------------------------------------


def _both(table: str) -> str:
    """The steps' rows of ``table``: s0 to s4 among the survivors, s5 and s6 point in time."""
    return (
        f"(SELECT model AS step, * FROM {table}_steps WHERE model <> 'uniform' UNION ALL SELECT 's5', * FROM {table}_pit WHERE model = 's5' "
        f"UNION ALL SELECT 's6', * FROM {table}_pit WHERE model = 's5')"
    )


_BENCH = "(SELECT false AS pit, * FROM {0}_steps WHERE model = 'uniform' UNION ALL SELECT true, * FROM {0}_pit WHERE model = 'uniform')"
part(
    "steprows",
    f"""SELECT p.step, p.k, p.rps, b.rps AS rps_uniform, p.rps - b.rps AS d, p.turnover,
    CAST(row_number() OVER (PARTITION BY p.step ORDER BY p.k) - 1 AS BIGINT) AS pos, COUNT(*) OVER (PARTITION BY p.step) AS n,
    AVG(p.rps - b.rps) OVER (PARTITION BY p.step) AS mean
    FROM {_both('periods')} p JOIN {_BENCH.format('periods')} b ON b.k = p.k AND b.pit = (p.step IN ('s5', 's6'))""",
    "periods_steps", "periods_pit",
)
part(
    "stepdraws",
    f"""SELECT x.step, b.boot, ({uniform_int('b.boot', '(x.pos // 4)', SEED)} % x.n + x.pos % 4) % x.n AS pick
    FROM steprows x CROSS JOIN (SELECT unnest(range({N_BOOT})) AS boot) b""",
    "steprows",
)
part(
    "stepboot",
    """SELECT step, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
    SELECT r.step, r.boot, AVG(y.d) AS m FROM stepdraws r JOIN steprows y ON y.step = r.step AND y.pos = r.pick GROUP BY 1, 2) GROUP BY 1""",
    "steprows", "stepdraws",
)
part(
    "stepdaily",
    f"""SELECT o.step, CASE WHEN o.step = 's6' THEN o.ret_net ELSE o.ret END AS r, CASE WHEN o.step = 's6' THEN b.ret_net ELSE b.ret END AS rb
    FROM {_both('net')} o JOIN {_BENCH.format('net')} b ON b.k = o.k AND b.date = o.date AND b.pit = (o.step IN ('s5', 's6'))""",
    "net_steps", "net_pit",
)
part(
    "report",
    f"""SELECT m.step, m.rps, m.rps_uniform, m.rps_diff, {t_cdf_sql('m.stat', '(m.n - 1)')} AS p_dm, b.lo AS ci_low, b.hi AS ci_high,
    i.ir, i.irb AS ir_benchmark, i.sh AS sharpe, i.shb AS sharpe_benchmark, m.turnover, m.step = 's6' AS net_of_costs
    FROM (SELECT step, COUNT(*) AS n, AVG(rps) AS rps, AVG(rps_uniform) AS rps_uniform, AVG(d) AS rps_diff, AVG(turnover) AS turnover,
      AVG(d) / SQRT(VAR_POP(d) / COUNT(*)) * SQRT((COUNT(*) - 1.0) / COUNT(*)) AS stat FROM steprows GROUP BY 1) m
    JOIN stepboot b USING (step) JOIN (SELECT step, SUM(r) / STDDEV_SAMP(r) AS ir, SUM(rb) / STDDEV_SAMP(rb) AS irb,
      AVG(r) / STDDEV_SAMP(r) * SQRT(252) AS sh, AVG(rb) / STDDEV_SAMP(rb) * SQRT(252) AS shb FROM stepdaily GROUP BY 1) i USING (step)""",
    "steprows", "stepboot", "stepdaily",
)
_DIGITS = {
    "rps": 9, "rps_uniform": 9, "rps_diff": 9, "p_dm": 7, "ci_low": 8, "ci_high": 8, "ir": 6,
    "ir_benchmark": 6, "sharpe": 6, "sharpe_benchmark": 6, "turnover": 9,
}

# ---- the same on Spark ---------------------------------------------------------------------


class Steps:
    """Inputs of the cascade on one panel, all of its second phase; each is made when first asked for."""

    def __init__(self, p):
        self.p = p
        self.late = F.broadcast(p.calendar.where("phase = 'period2'").select("k"))  # one row per period

    @cached_property
    def origins(self) -> DataFrame:
        return stage(self.p.origins.join(self.late, "k"), "late_origins")

    @cached_property
    def survivors(self) -> DataFrame:
        return stage(un.survivors_universe(self.p.symbols, self.p.successors), "survivors")

    @cached_property
    def prices(self) -> DataFrame:
        """Not stored: the panel's prices stay where they are, in as many buckets."""
        return self.p.prices.join(self.survivors, "symbol", "left_semi")

    @cached_property
    def past(self) -> DataFrame:
        """Windows of all origins, each also of the first phase."""
        return stage(cal.past_windows(self.p.origins, self.p.days).select("k", "origin", "base_date", "end_date"), "all_windows")

    @cached_property
    def windows(self) -> DataFrame:
        return stage(self.past.join(self.late, "k", "left_semi"), "late_windows")

    @cached_property
    def bases(self) -> DataFrame:
        return stage(sm.weekly_bases(self.p.days, self.p.origins), "weekly_bases")

    @cached_property
    def dates(self) -> DataFrame:
        return stage(self.past.selectExpr("base_date AS date").union(self.p.origins.selectExpr("origin AS date")).distinct(), "asked_dates")

    @cached_property
    def naive(self) -> DataFrame:
        """Scaled over every day of a symbol, kept on the dates some step asks for, as bins."""
        dates = self.dates.union(self.bases.selectExpr("base_date AS date")).distinct()
        every = ft.naive_features(ft.price_signals(self.prices, self.p.days))
        kept = every.join(F.broadcast(dates), "date", "left_semi")
        return stage(bt.coded(kept, GRID, "scores"), "survivor_naive", "symbol", self.p.buckets, placed=True)

    @cached_property
    def clean(self) -> DataFrame:
        """A symbol's signals depend on its own prices only, so those of all symbols are taken."""
        signals = _base_signals(self.p).join(self.survivors, "symbol", "left_semi")
        return ft.cross_sectional(signals)

    @cached_property
    def clean_bins(self) -> DataFrame:
        return stage(bt.coded(self.clean, GRID, "ranks"), "survivor_ranks")

    @cached_property
    def members(self) -> DataFrame:
        inside = self.p.members.join(self.late, "k", "left_semi").join(self.survivors, "symbol", "left_semi")
        return stage(inside.select("k", "symbol"), "survivor_members")

    def _with_naive(self, labelled: DataFrame, label: str) -> DataFrame:
        """Both sides are placed by symbol, so nothing is shuffled."""
        rows = sm.with_features(labelled, self.naive)
        with placed_joins(self.p.spark):
            return stage(rows, label)

    @cached_property
    def weekly(self) -> DataFrame:
        return self._with_naive(sm.window_targets(self.prices, self.bases, self.p.days, self.p.buckets), "weekly_samples")

    @cached_property
    def labelled(self) -> DataFrame:
        rows = sm.window_targets(self.prices, self.past, self.p.days, self.p.buckets)
        return stage(rows, "window_targets", "symbol", self.p.buckets, placed=True)

    @cached_property
    def naive_samples(self) -> DataFrame:
        return self._with_naive(self.labelled, "naive_samples")

    @cached_property
    def samples(self) -> DataFrame:
        return stage(sm.with_features(self.labelled, self.clean_bins), "clean_samples")

    @cached_property
    def naive_rows(self) -> DataFrame:
        return stage(sm.origin_rows(self.naive, self.origins, self.members), "naive_rows")

    @cached_property
    def clean_rows(self) -> DataFrame:
        return stage(sm.origin_rows(self.clean_bins, self.origins, self.members), "clean_rows")

    @cached_property
    def targets(self) -> DataFrame:
        return stage(wf.member_targets(self.p.returns, self.members), "survivor_targets")


_STEPS: dict = {}


def _steps(p) -> Steps:
    if p not in _STEPS:
        _STEPS[p] = Steps(p)
    return _STEPS[p]


def _point_in_time(p, s: Steps):
    samples, _ = _samples(p)
    members = stage(p.members_d2.join(F.broadcast(s.origins.select("k")), "k", "left_semi").select("k", "symbol"), "late_members")
    rows = stage(sm.origin_rows(_base_features(p), s.origins, members), "late_rows")
    return *cs.honest(samples, s.windows, rows, SEARCH), members


def _evaluated(p, s: Steps, probs: dict[str, DataFrame], members: DataFrame) -> wf.WalkForward:
    late = p.calendar.where("phase = 'period2'")
    uniform = un.uniform_forecast(members)
    forecasts = uniform.unionByName(cs.tilted(probs).select(*uniform.columns))
    returns = p.returns.join(F.broadcast(s.origins.select("k")), "k", "left_semi")
    return wf.run(forecasts, p.prices, late, p.days, cost_bps=COST_BPS, members=members, returns=returns)


def _inside(p, s: Steps):
    """Steps s0 to s4 among the survivors: the models, and their results."""
    chosen, _ = cs.naive_steps(
        s.weekly, s.naive_samples, s.samples, s.windows, s.naive_rows, s.clean_rows, s.origins, s.targets, SEARCH
    )
    chosen["s4"], _ = cs.honest(s.samples, s.windows, s.clean_rows, SEARCH)
    return list(chosen), _evaluated(p, s, chosen, s.members)


def _outside(p, s: Steps):
    """Step s5 in the point-in-time universe."""
    probs, _, members = _point_in_time(p, s)
    return _evaluated(p, s, {"s5": probs}, members)


def _report(p):
    s = _steps(p)
    _ = s.origins, s.windows, p.returns, _base_features(p)  # both universes read these
    # Neither universe waits for the other: tasks of the second fill the cores that the first leaves idle.
    with ThreadPoolExecutor(1) as pool:
        late = pool.submit(inheritable_thread_target(_outside), p, s)
        models, inside = _inside(p, s)
        outside = late.result()
    steps = {step: (inside, step) for step in models} | {step: (outside, "s5") for step in ("s5", "s6")}
    benches = {step: (result, "uniform") for step, (result, _) in steps.items()}
    return cs.report(steps, benches, block=4, n_boot=N_BOOT, seed=SEED)


_REPORTS: dict = {}


def _table(p):
    if p not in _REPORTS:
        _REPORTS[p] = stage(_report(p), "cascade_report")
    return _REPORTS[p]


@query(with_parts("report", "SELECT step, " + ", ".join(f"ROUND({c}, {d}) AS {c}" for c, d in _DIGITS.items()) + ", net_of_costs FROM report"))
def cascade_report(spark, folder):
    return rounded(_table(panels(spark, folder)), **_DIGITS)


@query(
    with_parts(
        "report",
        """SELECT ROUND(l.rps_diff - f.rps_diff, 9) AS rps_fall, ROUND(f.sharpe - l.sharpe, 6) AS sharpe_fall, ROUND(l.sharpe_benchmark, 6) AS sharpe_bench,
        ROUND(f.sharpe / f.sharpe_benchmark, 6) AS times_bench_first FROM report f, report l WHERE f.step = 's0' AND l.step = 's6'""",
    )
)
def cascade_deltas(spark, folder):
    out = cs.deltas(_table(panels(spark, folder)))
    return rounded(out, rps_fall=9, sharpe_fall=6, sharpe_bench=6, times_bench_first=6)


_RANKS9 = ", ".join(f"ROUND(Rank{q}, 9) AS Rank{q}" for q in _Q)


@query(with_parts("cand_s0", f"SELECT config, rounds, k, symbol, {_RANKS9} FROM cand_s0"))
def kfold_forecast(spark, folder):
    """Out-of-fold forecasts of every candidate at every origin of the second phase."""
    s = _steps(panels(spark, folder))
    return rounded(cs.kfold_candidates(s.weekly, s.origins, SEARCH), **_R9)


@query(with_parts("cand_s3", f"SELECT config, rounds, k, symbol, {_RANKS9} FROM cand_s3"))
def walk_forward_candidates(spark, folder):
    """Forecasts of every candidate at every origin, each from the windows that end by it."""
    s = _steps(panels(spark, folder))
    return rounded(cs.walk_candidates(s.samples, s.windows, s.clean_rows, SEARCH, "ranks"), **_R9)


@query(with_parts("search_s5", "SELECT k, config, rounds, stopped_at, ROUND(val_rps, 9) AS val_rps, chosen FROM search_s5"))
def honest_search(spark, folder):
    """Every candidate each origin tried on its own validation windows, with early stopping over the rounds."""
    p = panels(spark, folder)
    _, table, _ = _point_in_time(p, _steps(p))
    return rounded(table, val_rps=9)


@query(with_parts("honest_s5", f"SELECT k, symbol, {_RANKS9} FROM honest_s5"))
def honest_forecast(spark, folder):
    """Point-in-time forecasts of the candidate each origin chose by itself."""
    p = panels(spark, folder)
    probs, _, _ = _point_in_time(p, _steps(p))
    return rounded(probs, **_R9)


@query(
    with_parts(
        "cand_s0 cand_s1 cand_s2 cand_s3 best_s0 best_s1 best_s2 best_s3",
        " UNION ALL ".join(f"SELECT '{s}' AS step, config, rounds, ROUND(rps, 9) AS rps, chosen FROM best_{s}" for s in ("s0", "s1", "s2", "s3")),
    )
)
def cascade_search(spark, folder):
    """The candidates of the leaky steps, chosen on the very periods they are reported on."""
    s = _steps(panels(spark, folder))
    _, table = cs.naive_steps(
        s.weekly, s.naive_samples, s.samples, s.windows, s.naive_rows, s.clean_rows, s.origins, s.targets, SEARCH
    )
    return rounded(table, rps=9)


_BOOSTED: dict = {}


def _boosted(p):
    """Forecasts and search log of all origins, fitted once per panel."""
    if p not in _BOOSTED:
        samples, windows = _samples(p)
        rows = stage(sm.origin_rows(_base_features(p), p.origins, p.members), "boosted_rows")
        probs, log = bo.forecast(samples, windows, rows)
        _BOOSTED[p] = stage(probs, "boosted_forecast"), log
    return _BOOSTED[p]


@query()
def boosted_forecast(spark, folder):
    """Boosted quintile forecasts of every origin, each with the configuration it chose by itself."""
    return rounded(_boosted(panels(spark, folder))[0], **_R9)


@query()
def boosted_search(spark, folder):
    """Every configuration tried at every origin: up to 1,000 rounds, ended after 50 without a gain."""
    log = _boosted(panels(spark, folder))[1]
    return rounded(log.drop("origin"), val_rps=9)


@query(
    with_parts(
        "members win",
        "SELECT m.k, m.n AS assets, m.n * 1.0::DOUBLE AS total, COALESCE(w.n, 0) - 13 < 24 AS fallback, "
        "CASE WHEN COALESCE(w.n, 0) - 13 < 24 THEN m.n ELSE 0 END AS flat, CASE WHEN COALESCE(w.n, 0) - 13 < 24 THEN 0 ELSE 4 END::BIGINT AS tries, "
        "CASE WHEN COALESCE(w.n, 0) - 13 < 24 THEN 0 ELSE 1 END::BIGINT AS chosen FROM (SELECT k, COUNT(*) AS n FROM members GROUP BY 1) m "
        "LEFT JOIN (SELECT k, COUNT(*) AS n FROM win GROUP BY 1) w USING (k)",
    )
)
def boosted_checks(spark, folder):
    """What is certain of the boosted forecasts: rows, sums, uniform rows of the fallback, tries and choices."""
    probs, log = _boosted(panels(spark, folder))
    per = probs.groupBy("k").agg(
        F.count(F.lit(1)).alias("assets"), F.round(F.sum(F.expr(" + ".join(RANKS))), 6).alias("total"),
        F.count_if(F.expr(" AND ".join(f"{c} = 0.2D" for c in RANKS))).alias("same"),
        F.count_if(F.expr(" OR ".join(f"{c} < 0" for c in RANKS))).alias("negative"),
    )
    tried = log.groupBy("k").agg(
        F.first("fallback").alias("fallback"), F.count("config").alias("tries"), F.count_if("chosen").alias("chosen")
    )
    return per.join(tried, "k").selectExpr(
        "k", "assets + negative AS assets", "total", "fallback", "CASE WHEN fallback THEN same ELSE 0 END AS flat", "tries", "chosen"
    )
