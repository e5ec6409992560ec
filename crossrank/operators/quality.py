"""Data-quality checks on raw OHLCV tables; every check returns findings (none = clean)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.scores import TARGETS, hard_quintile
from crossrank.operators.calendar import exchange, trading_days
from crossrank.operators.panel import period_returns
from crossrank.operators.targets import quintile_targets
from crossrank.staging import stage

# Ratios that look like a split, and how close a move must be.
SPLIT_FACTORS = ["2", "3", "4", "5", "8", "10", "20", "1/2", "1/3", "1/4", "1/5", "1/8", "1/10", "1/20"]
SPLIT_TOLERANCE = 0.03
_TOL = 1e-9


def coverage(
    raw: DataFrame,
    expected: DataFrame,
    start: str,
    cutoff: str,
    delistings: DataFrame,
    tolerance_days: int = 7,
) -> DataFrame:
    """Range and flags of every expected symbol."""
    stats = raw.groupBy("symbol").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("rows")
    )
    tol = tolerance_days
    flags = (
        f"concat_ws(';', CASE WHEN first > date_add(DATE '{start}', {tol}) THEN 'starts_late' END,"
        f" CASE WHEN delisted IS NOT NULL AND abs(datediff(last, delisted)) > {tol}"
        " THEN 'last_date_differs_from_delisting'"
        f" WHEN delisted IS NULL AND last < date_sub(DATE '{cutoff}', {tol})"
        " THEN 'ends_before_cutoff' END)"
    )
    return (
        expected.select("symbol")
        .join(stats, "symbol", "left")
        .join(delistings.select("symbol", "delisted"), "symbol", "left")
        .selectExpr(
            "symbol", "first", "last", "coalesce(rows, 0L) AS rows",
            f"CASE WHEN rows IS NULL THEN 'missing' ELSE {flags} END AS flag",
        )
    )


def gaps(raw: DataFrame, calendars: DataFrame, min_days: int = 1) -> DataFrame:
    """Runs of exchange days without a price inside each symbol's own range.

    Works on calendar positions: a run is a jump between neighbouring observed positions, so
    no (symbol, day) grid is built.  ``calendars`` has (exchange, day).
    """
    numbered = calendars.selectExpr(
        "exchange", "day", "row_number() OVER (PARTITION BY exchange ORDER BY day) AS pos"
    )
    rows = raw.select(exchange(F.col("symbol")).alias("exchange"), "symbol", "date")
    # Position of every raw date: exchange days up to it.  One row per (exchange, date).
    marks = rows.select("exchange", "date").distinct().selectExpr(
        "exchange", "date", "CAST(NULL AS INT) AS pos"
    ).unionByName(numbered.selectExpr("exchange", "day AS date", "pos"))
    where = (
        marks.groupBy("exchange", "date")
        .agg(F.max("pos").alias("pos"))
        .selectExpr(
            "exchange", "date", "pos",
            "coalesce(max(pos) OVER (PARTITION BY exchange ORDER BY date), 0) AS upto",
        )
    )
    placed = rows.join(F.broadcast(where), ["exchange", "date"])  # calendar-sized
    ends = placed.groupBy("exchange", "symbol").agg(
        F.expr("min_by(CASE WHEN pos IS NULL THEN upto ELSE upto - 1 END, date) AS before"),
        F.expr("max_by(upto, date) + 1 AS after"),
    )
    seen = (
        placed.where("pos IS NOT NULL")
        .select("exchange", "symbol", "pos")
        .unionByName(ends.selectExpr("exchange", "symbol", "before AS pos"))
        .unionByName(ends.selectExpr("exchange", "symbol", "after AS pos"))
        .distinct()
    )
    runs = seen.selectExpr(
        "exchange", "symbol", "pos",
        "lead(pos) OVER (PARTITION BY exchange, symbol ORDER BY pos) AS next",
    ).where(f"next - pos - 1 >= {max(min_days, 1)}")
    day = {
        n: F.broadcast(numbered.selectExpr("exchange", f"pos AS _{n}", f"day AS `{n}`"))
        for n in ("from", "to")
    }
    return (
        runs.selectExpr("exchange", "symbol", "pos + 1 AS _from", "next - 1 AS _to")
        .join(day["from"], ["exchange", "_from"])
        .join(day["to"], ["exchange", "_to"])
        .selectExpr("symbol", "`from`", "`to`", "bigint(_to - _from + 1) AS days")
    )


def ohlc_problems(raw: DataFrame) -> DataFrame:
    """(symbol, date, problem) for every broken price identity."""
    columns = ["open", "high", "low", "close", "adjusted_close"]
    checks = {
        "nonpositive_price": " OR ".join(f"{c} <= 0" for c in columns),
        "missing_value": "close IS NULL OR adjusted_close IS NULL",
        "high_below_low": f"high < low - {_TOL}D",
        "close_outside_range": f"close > high + {_TOL}D OR close < low - {_TOL}D",
        "negative_volume": "volume < 0",
    }
    found = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in checks.items())
    broken = raw.selectExpr(
        "symbol", "date", f"explode(filter(array({found}), p -> p IS NOT NULL)) AS problem"
    )
    repeated = (
        raw.groupBy("symbol", "date")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .selectExpr("symbol", "date", "explode(array_repeat('duplicated_date', int(_n))) AS problem")
    )
    return broken.unionByName(repeated)


def daily_ratios(raw: DataFrame) -> DataFrame:
    """Close and adjusted close over the previous row of the symbol; first rows dropped."""
    return raw.selectExpr(
        "symbol", "date",
        *[
            f"try_divide({c}, lag({c}) OVER (PARTITION BY symbol ORDER BY date)) AS {name}"
            for c, name in (("close", "close_ratio"), ("adjusted_close", "adjusted_ratio"))
        ],
    ).where("close_ratio IS NOT NULL")


def nearest_factor(ratio: str) -> str:
    """SQL struct (distance, i, factor) of the split factor closest to ``ratio``."""
    factors = ", ".join(f"double({f})" for f in SPLIT_FACTORS)
    return (
        f"array_min(transform(array({factors}), (f, i) ->"
        f" named_struct('distance', abs({ratio} / f - 1), 'i', i, 'factor', f)))"
    )


def splits(raw: DataFrame) -> DataFrame:
    """Split-like moves of the close; ``adjusted`` tells whether the adjusted price absorbed it."""
    return (
        daily_ratios(raw)
        .selectExpr(
            "*",
            f"{nearest_factor('close_ratio')} AS _n",
            f"CASE WHEN adjusted_ratio IS NOT NULL THEN {nearest_factor('adjusted_ratio')} END AS _a",
        )
        .where(f"_n.distance < {SPLIT_TOLERANCE}D")
        .selectExpr(
            "symbol", "date", "close_ratio", "adjusted_ratio", "_n.factor AS factor",
            f"coalesce(_a.distance >= {SPLIT_TOLERANCE}D, false) AS adjusted",
        )
    )


def jumps(raw: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Days on which the adjusted price moves by more than ``threshold`` in logs."""
    return (
        daily_ratios(raw)
        .selectExpr(
            "symbol", "date", "adjusted_ratio", "close_ratio",
            "CASE WHEN adjusted_ratio > 0 THEN ln(adjusted_ratio) END AS log_return",
        )
        .where(f"abs(log_return) > {threshold}D")
    )


def stale_runs(raw: DataFrame, min_run: int = 5) -> DataFrame:
    """Runs of consecutive rows with the same adjusted price."""
    order = "OVER (PARTITION BY symbol ORDER BY date)"
    marked = raw.selectExpr(
        "symbol", "date", "adjusted_close AS price",
        f"int(coalesce(adjusted_close != lag(adjusted_close) {order}, true)) AS _change",
    )
    return (
        marked.withColumn("_run", F.expr(f"sum(_change) {order}"))
        .groupBy("symbol", "_run")
        .agg(
            F.min("date").alias("from"), F.max("date").alias("to"),
            F.count(F.lit(1)).alias("rows"), F.first("price").alias("price"),
        )
        .where(F.col("rows") >= min_run)
        .drop("_run")
    )


def _common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    symbols = a.select("symbol").distinct().join(b.select("symbol").distinct(), "symbol", "left_semi")
    dates = a.select("date").distinct().join(b.select("date").distinct(), "date", "left_semi")

    def cut(df):
        return df.join(F.broadcast(dates), "date", "left_semi").join(symbols, "symbol", "left_semi")

    return symbols, dates, cut(a), cut(b)


def compare_daily(a: DataFrame, b: DataFrame, bp: float = 10.0) -> DataFrame:
    """Per symbol: differences of daily returns in basis points on the common dates.

    A return counts only when the previous common date has the symbol in both sources.
    """
    symbols, dates, a, b = _common(a, b)
    numbered = F.broadcast(dates.selectExpr("date", "row_number() OVER (ORDER BY date) AS idx"))
    both = (
        a.selectExpr("symbol", "date", "price AS pa")
        .join(b.selectExpr("symbol", "date", "price AS pb"), ["symbol", "date"])
        .join(numbered, "date")
    )
    order = "OVER (PARTITION BY symbol ORDER BY idx)"
    diffs = both.selectExpr(
        "symbol",
        f"CASE WHEN lag(idx) {order} = idx - 1 THEN"
        f" abs((pa / lag(pa) {order} - 1) - (pb / lag(pb) {order} - 1)) * 10000 END AS d",
    )
    stats = diffs.where("d IS NOT NULL").groupBy("symbol").agg(
        F.count("d").alias("days"),
        F.median("d").alias("median_abs_diff_bp"),  # one symbol: at most its days
        F.max("d").alias("max_abs_diff_bp"),
        F.expr(f"avg(double(d > {bp}D)) AS share_days_over_bp"),
    )
    return symbols.join(stats, "symbol", "left").withColumn("days", F.coalesce("days", F.lit(0)))


def compare_periods(a: DataFrame, b: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period: largest difference of returns and share of assets in another quintile.

    Periods whose edges are not common dates are left out.
    """
    known = stage(
        a.select("symbol").distinct().join(b.select("symbol").distinct(), "symbol", "left_semi"), "common_symbols"
    )
    a, b = (df.join(known, "symbol", "left_semi") for df in (a, b))
    days = stage(
        a.selectExpr("date AS day").distinct().join(b.selectExpr("date AS day").distinct(), "day", "left_semi"),
        "common_days",
    )
    kept = periods
    for edge in ("base_date", "end_date"):
        kept = kept.join(F.broadcast(days.select(F.col("day").alias(edge))), edge, "left_semi")
    kept = stage(kept, "common_periods")

    def probed(df: DataFrame, out: str) -> DataFrame:
        """Returns from as-of prices at the edges only: one aggregate over the panel as it lies."""
        common = df.join(F.broadcast(days.withColumnRenamed("day", "date")), "date", "left_semi")
        return period_returns(common, kept, days).where("ret IS NOT NULL").selectExpr("k", "symbol", f"ret AS {out}")

    both = stage(probed(a, "ra").join(probed(b, "rb"), ["k", "symbol"]), "both_returns")
    sides = both.selectExpr("k", "symbol", "stack(2, 'a', ra, 'b', rb) AS (side, ret)")
    quintiles = quintile_targets(sides, ["k", "side"], "ret", bounded=True).selectExpr(
        "k", "symbol", "side", "ret", f"{hard_quintile(TARGETS)} AS q"
    )
    picks = [f"max(CASE WHEN side = '{side}' THEN {c} END) AS {n}{side}" for side in "ab" for c, n in (("ret", "r"), ("q", "q"))]
    placed = quintiles.groupBy("k", "symbol").agg(*map(F.expr, picks))
    labels = F.broadcast(kept.select("k", "label"))
    return (
        placed.groupBy("k")
        .agg(
            F.count(F.lit(1)).alias("assets"),
            F.expr("max(abs(ra - rb)) AS max_abs_return_diff"),
            F.expr("avg(double(qa != qb)) AS share_different_quintile"),
        )
        .join(labels, "k")
    )
