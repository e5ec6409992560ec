"""Exact ranks and order statistics of groups too large for one task.

A plain ranking window sorts a whole group in one task, and a cross-section (all assets on
one date) may be as large as the data.  Both operators here start from an approximate
percentile sketch per group, which merges map-side and has a fixed size, and then make the
result exact: order statistics count the rows around a narrow bracket and sort only the rows
inside it; ranks sort value ranges apart, on the rows themselves, and add the totals of the
ranges below.  Order statistics count equal values before they shuffle them; for ranks a common
value is a range of its own that needs no order, so its rows are spread over many tasks.

``bounded`` says that the groups are keyed by the calendar (dates, periods, windows), whose
number is limited by the days covered and not by the data; then the sketches (a few doubles
per group) are broadcast.  Otherwise they are staged first, so that Spark knows their size
when it plans: small ones are broadcast and hot groups are never shuffled by their key, large
ones mean many groups and are joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossrank.staging import stage

BUCKETS = 32
_SALTS = 64  # parts a range of one value is spread over
_ACCURACY = 2000
_SLACK = 1.5 / _ACCURACY


@dataclass(frozen=True)
class Place:
    """A wanted position: its share of the group and the exact position as SQL over ``n``."""

    level: float
    position: str


def _hint(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else stage(df, "sketch")


def _clip(level: float) -> float:
    return min(max(level, 0.0), 1.0)


def order_statistics(
    df: DataFrame, by: list[str], value: str, places: list[Place], bounded: bool = False
) -> DataFrame:
    """Values at given 1-based positions of every group, in ascending order.

    Returns ``by``, ``slot`` (index in ``places``), ``value``, ``less`` (rows below the
    value), ``ties`` (rows equal to it) and ``n``.  Positions are moved into 1..n.
    """
    rows = df.select(*by, F.col(value).alias("_v")).where("_v IS NOT NULL")
    levels = [_clip(p.level + side) for p in places for side in (-_SLACK, _SLACK)]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_v", levels, _ACCURACY).alias("_e"))
    sums = ["count(1) AS n", "first(_e) AS _e"]
    for i in range(len(places)):
        sums.append(f"count_if(_v < _e[{2 * i}]) AS _less{i}")
        sums.append(f"count_if(_v <= _e[{2 * i + 1}]) AS _upto{i}")
    counted = rows.join(_hint(sketch, bounded), by).groupBy(*by).agg(*map(F.expr, sums))
    # One struct per place.  The sketch may miss: then everything on that side is searched.
    brackets = []
    for i, p in enumerate(places):
        at = f"bigint(least(greatest({p.position}, 1), n))"
        low, high = f"_e[{2 * i}]", f"_e[{2 * i + 1}]"
        brackets.append(
            f"CASE WHEN {at} <= _less{i} THEN named_struct('at', {at}, 'before', 0L,"
            f" 'low', -double('inf'), 'high', {low})"
            f" WHEN {at} > _upto{i} THEN named_struct('at', {at}, 'before', _upto{i},"
            f" 'low', {high}, 'high', double('inf'))"
            f" ELSE named_struct('at', {at}, 'before', _less{i}, 'low', {low}, 'high', {high}) END"
            f" AS _p{i}"
        )
    brackets = counted.selectExpr(*by, "n", *brackets)
    inside = [_within(f"_p{i}", "_v") for i in range(len(places))]
    options = ", ".join(
        f"CASE WHEN {test} THEN named_struct('slot', {i}, 'p', _p{i}) END"
        for i, test in enumerate(inside)
    )
    distinct = (
        rows.join(_hint(brackets, bounded), by)
        .where(" OR ".join(inside))
        .selectExpr(*by, "_v", "n", f"explode(filter(array({options}), o -> o IS NOT NULL)) AS o")
        .selectExpr(*by, "o.slot AS slot", "_v", "n", "o.p.at AS _at", "o.p.before AS _before")
        .groupBy(*by, "slot", "_v")
        .agg(
            F.count("n").alias("ties"),
            F.max("n").alias("n"),
            F.max("_at").alias("_at"),
            F.max("_before").alias("_before"),
        )
    )
    keys = ", ".join([*by, "slot"])
    return (
        distinct.selectExpr(
            *by,
            "slot",
            "_v AS value",
            f"_before + sum(ties) OVER (PARTITION BY {keys} ORDER BY _v) - ties AS less",
            "ties",
            "n",
            "_at",
        )
        .where("_at > less AND _at <= less + ties")
        .drop("_at")
    )


def _within(bracket: str, value: str) -> str:
    """Inside the closed bracket, or strictly beyond an edge the sketch placed wrongly."""
    low = f"({value} > {bracket}.low OR ({value} = {bracket}.low AND {bracket}.high < double('inf')))"
    high = f"({value} < {bracket}.high OR ({value} = {bracket}.high AND {bracket}.low > -double('inf')))"
    return f"({low} AND {high})"


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, levels: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Quantiles with linear interpolation between order statistics, one column per level."""
    names = list(levels)
    places = []
    for c in names:
        q = levels[c]
        places.append(Place(q, f"floor((n - 1) * {q}D) + 1"))
        places.append(Place(q, f"ceil((n - 1) * {q}D) + 1"))
    found = order_statistics(df, by, value, places, bounded)
    exprs = []
    for i, c in enumerate(names):
        low, high = (f"max(CASE WHEN slot = {2 * i + j} THEN value END)" for j in (0, 1))
        at = f"(max(n) - 1) * {levels[c]}D"
        exprs.append(f"{low} + ({high} - {low}) * ({at} - floor({at})) AS {c}")
    return found.groupBy(*by).agg(*map(F.expr, exprs))


def place(
    df: DataFrame, by: list[str], value: str, bounded: bool = False, buckets: int = BUCKETS
) -> DataFrame:
    """Add to every row ``_less`` (rows of its group below it), ``_ties`` (rows equal to it) and
    ``_n`` (rows with a value), computed where the row is: nothing is joined back on a value.

    Quantiles of the sketch cut a group into open ranges, and each cut is a range of its own.
    A common value is always a cut (it covers a whole step between two quantiles), and a range
    of one value needs no order: its rows take their place from the counts of the ranges, so
    they are spread by a hash of their columns.  What is left in an open range is a small share
    of its group.  Rows without a value, or of a group whose key is NULL, get NULL.

    ``_bucket`` and ``_salt`` stay, so that ``running_extreme`` needs no shuffle of its own.
    """
    rows = df.select(*by, value).where(F.col(value).isNotNull())
    cuts = [i / buckets for i in range(1, buckets)]
    sketch = rows.groupBy(*by).agg(F.percentile_approx(value, cuts, _ACCURACY).alias("_cuts"))
    is_cut = f"exists(_cuts, c -> c = {value})"
    spread = f"pmod(xxhash64({', '.join(f'`{c}`' for c in df.columns)}), {_SALTS})"
    marked = df.join(_hint(sketch, bounded), by, "left").selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"CASE WHEN {value} IS NOT NULL THEN 2 * size(filter(_cuts, c -> c < {value})) + int({is_cut}) END AS _bucket",
        f"CASE WHEN {value} IS NULL OR {is_cut} THEN {spread} ELSE 0L END AS _salt",
    )
    group = ", ".join(by)  # at most 2 * `buckets` rows per group from here
    counts = (
        marked.where("_bucket IS NOT NULL")
        .groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .selectExpr(
            *by,
            "_bucket",
            "_rows",
            f"sum(_rows) OVER (PARTITION BY {group} ORDER BY _bucket) - _rows AS _before",
            f"sum(_rows) OVER (PARTITION BY {group}) AS _n",
        )
    )
    inside = f"PARTITION BY {group}, _bucket, _salt"
    columns = [*(f"`{c}`" for c in df.columns), "_bucket", "_salt"]
    return (
        marked.join(_hint(counts, bounded), [*by, "_bucket"], "left")
        .selectExpr(
            *columns, "_n", "_before", "_rows",
            f"rank() OVER ({inside} ORDER BY {value}) AS _at",
            f"count(1) OVER ({inside}, {value}) AS _same",
        )
        .selectExpr(
            *columns, "_n",
            "CASE WHEN _bucket % 2 = 1 THEN _before ELSE _before + _at - 1 END AS _less",
            "CASE WHEN _bucket % 2 = 1 THEN _rows WHEN _bucket IS NOT NULL THEN _same END AS _ties",
        )
    )


def with_rank(
    df: DataFrame,
    by: list[str],
    value: str,
    low: str | None = None,
    average: str | None = None,
    percentile: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Ascending ranks of ``value`` inside ``by``; rows with a NULL value get NULL.

    ``low``: ties share the lowest position; ``average``: the mean position; ``percentile``:
    the mean position divided by the number of values.
    """
    mean_rank = "(_less + (_ties + 1) / 2D)"
    picks = []
    if low:
        picks.append(f"_less + 1 AS {low}")
    if average:
        picks.append(f"{mean_rank} AS {average}")
    if percentile:
        picks.append(f"{mean_rank} / _n AS {percentile}")
    return place(df, by, value, bounded).selectExpr(*[f"`{c}`" for c in df.columns], *picks)


def running_extreme(
    placed: DataFrame, by: list[str], value: str, term: Column, out: str, rising: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """Running extreme of ``term``, a function of the value and its place, over ``place`` rows.

    ``rising``: maximum over values up to this one; otherwise minimum over values from this
    one upwards.  Extremes of the ranges are carried over, so no task sees a whole group.
    """
    pick = F.max if rising else F.min
    join = F.greatest if rising else F.least
    key = (lambda c: F.col(c).asc()) if rising else (lambda c: F.col(c).desc())
    rows = placed.withColumn("_term", term)
    before = Window.partitionBy(*by).orderBy(key("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.where("_bucket IS NOT NULL")
        .groupBy(*by, "_bucket")
        .agg(pick("_term").alias("_all"))
        .withColumn("_carry", pick("_all").over(before))
        .drop("_all")
    )
    inside = Window.partitionBy(*by, "_bucket", "_salt").orderBy(key(value))
    return (
        rows.join(_hint(carry, bounded), [*by, "_bucket"], "left")
        .withColumn("_run", pick("_term").over(inside))
        .withColumn(out, join(F.col("_run"), F.col("_carry")))
        .drop("_term", "_run", "_carry")
    )
