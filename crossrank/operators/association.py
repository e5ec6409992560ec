"""Correlations with bootstrap intervals and permutation p-values; 2 x 2 tables; fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.draws import hash_order, uniform_int
from crossrank.functions.scores import TARGETS, rps_expr
from crossrank.functions.special import fisher_p
from crossrank.operators.ordering import place, with_rank
from crossrank.schema import RANKS
from crossrank.staging import stage

METHODS = ("spearman", "pearson")
MIN_PAIRS = 4
_TASK_ROWS = 2_000_000  # positions of draws one task unfolds
_PIECE = 1 << 16


def complete_pairs(pairs: DataFrame, by: list[str], x: str, y: str, id_col: str) -> DataFrame:
    """(by, id, x, y) with both values finite."""
    def finite(c: str) -> str:
        return f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')"

    return pairs.where(f"{finite(x)} AND {finite(y)}").selectExpr(
        *by, f"{id_col} AS id", f"double({x}) AS x", f"double({y}) AS y"
    )


def _coefficients(pairs: DataFrame, by: list[str], out: str) -> DataFrame:
    """Pearson correlation of x and y per group, NULL for a constant column."""
    return pairs.groupBy(*by).agg(
        F.expr(
            "CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(x, y) END"
        ).alias(out),
        F.count(F.lit(1)).alias("n"),
    )


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The pairs with their average ranks ``sx`` and ``sy``."""
    return stage(with_rank(with_rank(pairs, by, "x", average="sx"), by, "y", average="sy"), "ranked")


def correlation(
    pairs: DataFrame, by: list[str], method: str = "spearman",
    n_boot: int = 10_000, n_perm: int = 10_000, level: float = 0.95, seed: int = 0,
) -> DataFrame:
    """One row per group of ``complete_pairs``: estimate, interval and permutation p-value.

    Resamples and permutations are rows keyed by (group, draw, position) whose indices are
    arithmetic on the key; the pairs themselves are ranked and numbered once.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    base = pairs.select(*by, "id", "x", "y")
    scored = _ranked(base, by) if method == "spearman" else base.selectExpr("*", "x AS sx", "y AS sy")
    estimate = _coefficients(scored.selectExpr(*by, "sx AS x", "sy AS y"), by, "estimate").selectExpr(
        *by,
        f"CASE WHEN n < {MIN_PAIRS} THEN bigint(raise_error('need at least 4 complete pairs')) ELSE n END AS n",
        "estimate",
    )
    out = estimate
    if n_boot or n_perm:
        # Positions 0..n-1 in a fixed arbitrary order of the ids.
        keyed = scored.withColumn("_h", F.expr(hash_order("id")))
        numbered = stage(
            place(keyed, by, "_h").selectExpr(*by, "id", "x", "y", "sx", "sy", "_less AS pos", "_n AS n"), "pairs"
        )
    if n_boot:
        out = out.join(_bootstrap(numbered, by, method, n_boot, level, seed), by, "left")
    if n_perm:
        out = out.join(_permutation(numbered, estimate, by, n_perm, seed), by, "left")
    return out.withColumn("method", F.lit(method))


def _draws(numbered: DataFrame, by: list[str], n: int, draw: str) -> DataFrame:
    """(by, n, draw, slot): every position of every draw, the draws dealt out before they unfold.

    What follows is per draw, so it needs no further shuffle: a draw is as many rows as its group
    has pairs, and a group's draws lie in all tasks.
    """
    groups = numbered.where("pos = 0").select(*by, "n")
    rows = groups.agg(F.sum("n")).first()[0] or 0
    tasks = max(numbered.sparkSession.sparkContext.defaultParallelism, rows * n // _TASK_ROWS + 1)
    dealt = groups.selectExpr("*", f"explode(sequence(0, {n - 1})) AS {draw}").repartition(tasks, *by, draw)
    pieces = dealt.selectExpr("*", f"explode(sequence(0L, (n - 1) div {_PIECE})) AS _piece")
    return pieces.selectExpr(
        *by, "n", draw, f"explode(sequence(_piece * {_PIECE}, least(n, (_piece + 1) * {_PIECE}) - 1)) AS slot"
    )


def _bootstrap(numbered, by, method, n_boot, level, seed) -> DataFrame:
    """Multiplicity tables: a draw only says how often each pair counts.

    The order of the pairs by x and by y is fixed, so the ranks inside a draw are running sums of
    multiplicities along it, and nothing is ranked anew.
    """
    draw = ", ".join([*by, "boot"])
    times = (
        _draws(numbered, by, n_boot, "boot")
        .selectExpr(*by, "n", "boot", f"{uniform_int('boot', 'slot', seed)} % n AS pos")
        .groupBy(*by, "n", "boot", "pos").agg(F.count(F.lit(1)).alias("m"))
    )
    drawn = times.join(numbered.drop("n"), [*by, "pos"])
    if method == "spearman":
        # Twice the mean position of a tie, less the mean of all: whole numbers, so sums are exact.
        def centred(c: str) -> str:
            upto = f"sum(m) OVER (PARTITION BY {draw} ORDER BY {c})"
            return f"2 * {upto} - sum(m) OVER (PARTITION BY {draw}, {c}) - n"

        drawn = drawn.selectExpr(*by, "n", "boot", "m", f"double({centred('sx')}) AS u", f"double({centred('sy')}) AS v")
    else:
        middle = numbered.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
        drawn = drawn.join(middle, by).selectExpr(*by, "n", "boot", "m", "x - _mx AS u", "y - _my AS v")
    sums = drawn.groupBy(*by, "n", "boot").agg(
        *[F.expr(f"sum(m * {e}) AS {c}") for c, e in
          {"su": "u", "sv": "v", "suu": "u * u", "svv": "v * v", "suv": "u * v"}.items()],
        F.expr("max(u) > min(u) AND max(v) > min(v) AS varied"),
    )
    boots = sums.where("varied").selectExpr(
        *by, "(n * suv - su * sv) / (sqrt(n * suu - su * su) * sqrt(n * svv - sv * sv)) AS r"
    )
    alpha = (1 - level) / 2
    return boots.groupBy(*by).agg(  # n_boot values per group
        F.expr(f"percentile(r, {alpha}D) AS ci_low"), F.expr(f"percentile(r, {1 - alpha}D) AS ci_high")
    )


def _permutation(numbered, estimate, by, n_perm, seed) -> DataFrame:
    """Ranks, means and spreads do not change when y is permuted: only the sum of products does."""
    draw = ", ".join([*by, "perm"])
    order = f"{uniform_int('perm', 'slot', seed + 1)} * 2147483648 + slot"
    moments = numbered.groupBy(*by).agg(
        F.avg("sx").alias("_mx"), F.avg("sy").alias("_my"),
        F.expr("sqrt(regr_sxx(sx, sx)) * sqrt(regr_sxx(sy, sy)) AS _spread"),
    )
    taken = _draws(numbered, by, n_perm, "perm").selectExpr(
        *by, "perm", "slot AS pos", f"row_number() OVER (PARTITION BY {draw} ORDER BY {order}) - 1L AS _take"
    )
    centred = stage(numbered.join(moments, by).selectExpr(*by, "pos", "sx - _mx AS u", "sy - _my AS v"), "centred")
    shuffled = taken.join(centred.select(*by, "pos", "u"), [*by, "pos"]).join(
        centred.selectExpr(*by, "pos AS _take", "v"), [*by, "_take"]
    )
    perms = (
        shuffled.groupBy(*by, "perm").agg(F.expr("sum(u * v) AS s"))
        .join(moments.where("_spread > 0").select(*by, "_spread"), by)
        .join(estimate.select(*by, "estimate"), by)
    )
    hits = "count_if(round(abs(s / _spread), 12) >= round(abs(estimate), 12))"
    counted = perms.groupBy(*by).agg(F.expr(f"({hits} + 1) / ({n_perm} + 1D) AS p_perm"))
    # A constant column has no correlation to reach.
    return estimate.select(*by).join(counted, by, "left").selectExpr(*by, f"coalesce(p_perm, 1 / ({n_perm} + 1D)) AS p_perm")


def fisher_table(flags: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """2 x 2 counts of two flags with odds ratio and two-sided exact p."""
    cells = flags.groupBy(*by).agg(
        F.expr(f"count_if(NOT {x} AND NOT {y}) AS n00"),
        F.expr(f"count_if(NOT {x} AND {y}) AS n01"),
        F.expr(f"count_if({x} AND NOT {y}) AS n10"),
        F.expr(f"count_if({x} AND {y}) AS n11"),
    )
    return cells.withColumn("odds_ratio", F.expr("try_divide(double(n00 * n11), n01 * n10)")).withColumn(
        "p_value", fisher_p()("n00", "n01", "n10", "n11")
    )


def forecast_profiles(submissions: DataFrame, teams: DataFrame) -> DataFrame:
    """Per team: all forecasts uniform, and an exact copy of the benchmark (weights 0.01)."""
    flat = " AND ".join(f"abs({c} - 0.2D) < 1e-9D" for c in RANKS)
    return (
        submissions.where("k BETWEEN 1 AND 12")
        .join(teams.select("Team"), "Team", "left_semi")
        .groupBy("Team")
        .agg(
            F.expr(f"bool_and({flat}) AS uniform_forecast"),
            F.expr(f"bool_and({flat} AND abs(Decision - 0.01D) < 1e-9D) AS benchmark_copy"),
        )
    )


def team_months(submissions: DataFrame) -> DataFrame:
    """Per team and evaluation: distance from uniform, gross exposure, largest position.

    Numbers are summed first; a text in an aggregate would sort every row.  Only the rows whose
    position is as large as the largest one are then compared by symbol.
    """
    off = [f"abs({c} - 0.2D)" for c in RANKS]
    key = ["Team", "Evaluation"]
    sums = stage(
        submissions.groupBy(*key).agg(
            F.expr(f"avg(({' + '.join(off)}) / 5) AS mean_abs_dev_uniform"),
            F.expr(f"max(greatest({', '.join(off)})) AS max_abs_dev_uniform"),
            F.expr("sum(abs(Decision)) AS gross_exposure"),
            F.expr("max(CASE WHEN NOT isnan(Decision) THEN abs(Decision) END) AS _top"),
        ),
        "team_sums",
    )
    # A position that is not known is the largest one only where none is known.
    top = submissions.select(*key, "Symbol", "Decision").join(F.broadcast(sums.select(*key, "_top")), key)
    largest = top.where("abs(Decision) <=> _top").groupBy(*key).agg(
        F.min(F.struct("Symbol", "Decision")).alias("_first")
    )
    return sums.join(F.broadcast(largest), key, "left").select(
        *key, "mean_abs_dev_uniform", "max_abs_dev_uniform", "gross_exposure",
        F.col("_first.Symbol").alias("largest_position"), F.col("_first.Decision").alias("largest_weight"),
    )


def _cells(table: DataFrame, key: list[str], name: str) -> DataFrame:
    cells = ", ".join(f"{q}, {c} - 0.2D" for q, c in enumerate(RANKS, 1))
    return table.selectExpr(*key, f"stack(5, {cells}) AS (q, {name})")


def fidelity(
    rerun: DataFrame, submitted: DataFrame, targets: DataFrame, by: list[str]
) -> DataFrame:
    """Per (by, k): correlation, shrinkage fit, differences, and the RPS of both.

    ``submitted`` has one row per (by, k, symbol) with Rank1..5.  So has ``rerun``, or it leaves out columns of ``by``:
    then one re-run is held against all their values.  The residual is submission - shrink x re-run.

    The re-run and the targets meet first; the many submitted rows are joined once, as they are,
    and unfold into their five cells only inside an aggregate.
    """
    group = [*by, "k"]
    shared = [c for c in group if c in rerun.columns]
    on = [*shared, "symbol"]
    realised = targets.select("k", "symbol", *TARGETS, F.lit(True).alias("_real"))
    ours = [f"_x{q}" for q in range(1, 6)]
    known = rerun.select(*on, *[F.col(c).alias(x) for c, x in zip(RANKS, ours)], F.lit(True).alias("_run"))
    if len(shared) == 1:  # the re-run has a row per asset and period, as the targets have
        both = submitted.select(*group, "symbol", *RANKS).join(
            known.join(realised, ["k", "symbol"], "full_outer").hint("shuffle_hash"), ["k", "symbol"], "left"
        )
    else:
        both = (
            submitted.select(*group, "symbol", *RANKS).join(known, on, "left")
            .join(realised.hint("shuffle_hash"), ["k", "symbol"], "left")
        )
    both = stage(both.where("_run OR _real").drop("symbol"), "fidelity_rows")
    cells = ", ".join(f"{x} - 0.2D, {c} - 0.2D" for x, c in zip(ours, RANKS))
    pairs = both.where("_run").selectExpr(*group, f"stack(5, {cells}) AS (x, y)")
    fit = stage(
        pairs.groupBy(*group).agg(
            F.expr("CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(x, y) END AS corr"),
            F.expr("try_divide(sum(x * y), sum(x * x)) AS shrink"),
            F.expr("avg(abs(x - y)) AS mean_abs_diff"),
            F.expr("max(abs(x - y)) AS max_abs_diff"),
        ),
        "fidelity_fit",
    )
    residuals = (
        pairs.join(F.broadcast(fit.select(*group, "shrink")), group)  # one row per group
        .groupBy(*group)
        .agg(
            F.expr("avg(abs(y - shrink * x)) AS mean_abs_resid"),
            F.expr("max(abs(y - shrink * x)) AS max_abs_resid"),
        )
    )
    submission = both.where("_real").groupBy(*group).agg(F.avg(F.expr(rps_expr())).alias("rps_submission"))
    reproduction = (
        rerun.select(*on, *RANKS).join(realised, ["k", "symbol"]).groupBy(*shared)
        .agg(F.avg(F.expr(rps_expr())).alias("rps_reproduction"))
    )
    return fit.join(residuals, group).join(submission, group).join(reproduction, shared)


def seed_spread(reruns: DataFrame) -> DataFrame:
    """Per period: largest and mean range of each probability across seeds."""
    ranges = (
        _cells(reruns, ["k", "symbol"], "p")
        .groupBy("k", "symbol", "q")
        .agg((F.max("p") - F.min("p")).alias("spread"))
    )
    return ranges.groupBy("k").agg(
        F.max("spread").alias("max_abs_diff_across_seeds"),
        F.avg("spread").alias("mean_abs_diff_across_seeds"),
    )
