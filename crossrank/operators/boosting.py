"""Quintile probabilities by componentwise boosting on sufficient statistics.

A base learner is a tree on one feature: ``num_leaves`` bins (and one for missing values), each
leaf the mean residual of its rows; leaves of fewer than ``min_data_in_leaf`` rows stay at zero.  A
round adds ``step_size`` times the learner that lowers the squared error most, for all five shares
at once, so forecasts sum to one.

Residuals of binned rows depend on the data only through how often two leaves occur together and
through the target sums of each leaf.  Spark counts both once per window, in one pass over the
samples; the counts of an origin are sums over its windows.  Fitting then needs no rows: every
round of every origin is arithmetic on tables of leaves, as are the ranked scores of the
validation windows after each round, being quadratic in the forecasts.  So all origins are fitted
for a thousand rounds in one job.  The tasks hold one configuration each: windows x leaves squared
numbers, whatever the number of assets.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.scores import TARGETS
from crossrank.operators import samples as sm
from crossrank.operators.features import FEATURES
from crossrank.schema import RANKS
from crossrank.staging import stage

# Workers need no copy of this package: tasks carry these functions with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The largest number of rounds and the rounds without a gain that end a search.
MAX_ROUNDS, PATIENCE = 1000, 50
SPREAD = 4  # tasks that count the rows of one window
_SHARES = ", ".join(f"b{q}" for q in range(1, 6))
WINDOW = ["base_date", "end_date"]


@dataclass(frozen=True)
class Boosting:
    grid: dict = field(default_factory=lambda: dict(sm.DEFAULT_GRID))
    n_val: int = 12
    embargo: int = 1
    min_train_windows: int = 24
    max_rounds: int = MAX_ROUNDS
    patience: int = PATIENCE
    step_size: float = 0.05
    name: str = "gbm"

    def configs(self) -> list[dict]:
        return sm.grid_configs(self.grid)

    def leaves(self) -> list[int]:
        return sorted(set(self.grid["num_leaves"]))


def leaf_columns(leaves: list[int]) -> list[str]:
    """SQL of the columns ``_cells{n}``: the leaf of every feature (numbered over all features) for each number."""
    def cell(i: int, f: str, n: int) -> str:
        own = f"CASE WHEN {f} IS NULL THEN {n} ELSE int(greatest(0, least({n - 1}, floor({f} * {n})))) END"
        return f"{i * (n + 1)} + {own}"

    return [f"array({', '.join(cell(i, f, n) for i, f in enumerate(FEATURES))}) AS _cells{n}" for n in leaves]


def statistics(samples: DataFrame, leaves: list[int]) -> DataFrame:
    """(window, num_leaves, a, b, v): what fitting needs of the samples, counted once per window.

    ``b`` >= 0: rows in leaf a and leaf b (a <= b).  ``b`` = -1..-5: target sums of leaf a.  With a = -1,
    ``b`` = -1 holds the rows of the window and -2 the sum of their squared centred running targets.

    Each window is dealt to ``SPREAD`` tasks, which read its rows in batches and keep the counts of one
    window: a row is never unfolded into its pairs of leaves, and what the tasks pass on has the size
    of the tables.
    """
    running = " + ".join(f"pow({' + '.join(TARGETS[: q + 1])} - {0.2 * (q + 1)}D, 2)" for q in range(5))
    dealt = (
        samples.selectExpr(
            *WINDOW, *TARGETS, f"{running} AS _square", *leaf_columns(leaves), f"pmod(xxhash64(symbol), {SPREAD}) AS _part"
        )
        .repartition(*WINDOW, "_part")
        .sortWithinPartitions(*WINDOW)
        .drop("_part")
    )
    width = {n: len(FEATURES) * (n + 1) for n in leaves}
    pairs = np.triu_indices(len(FEATURES))

    def table(key: tuple, types: list, state: dict) -> pa.RecordBatch:
        parts = []
        for n, (gram, sums, whole) in state.items():
            at, seen = np.flatnonzero(gram), np.flatnonzero(np.diag(gram.reshape(width[n], width[n])))
            parts.append((n, at // width[n], at % width[n], gram[at]))
            parts.extend((n, seen, np.full(len(seen), -1 - q), sums[q][seen]) for q in range(5))
            parts.append((n, np.full(2, -1), np.array([-1, -2]), whole))
        size = sum(len(v) for *_, v in parts)
        marks = [pa.array([k] * size, type=t) for k, t in zip(key, types)]
        ints = [np.concatenate([np.full(len(v), n) for n, _, _, v in parts]), *[np.concatenate([p[i] for p in parts]) for i in (1, 2)]]
        values = np.concatenate([v for *_, v in parts])
        return pa.RecordBatch.from_arrays(
            [*marks, *[pa.array(c.astype(np.int32)) for c in ints], pa.array(values)], names=[*WINDOW, "num_leaves", "a", "b", "v"]
        )

    def counted(batches):
        now, state, types = None, {}, []
        for batch in batches:
            types = [batch.schema.field(c).type for c in WINDOW]
            found = batch.select(WINDOW).to_pandas(date_as_object=True).groupby(WINDOW, sort=False, dropna=False).indices
            cells = {n: batch.column(f"_cells{n}").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.int64) for n in leaves}
            targets = [batch.column(t).to_numpy(zero_copy_only=False) for t in TARGETS]
            square = batch.column("_square").to_numpy(zero_copy_only=False)
            for key, where in found.items():  # in the order of the rows, which are sorted
                if key != now:
                    if now is not None:
                        yield table(now, types, state)
                    now = key
                    state = {n: (np.zeros(w * w), np.zeros((5, w)), np.zeros(2)) for n, w in width.items()}
                for n, (gram, sums, whole) in state.items():
                    own = cells[n][where]
                    gram += np.bincount((own[:, pairs[0]] * width[n] + own[:, pairs[1]]).ravel(), minlength=len(gram))
                    for q, target in enumerate(targets):
                        sums[q] += np.bincount(own.ravel(), np.repeat(target[where], own.shape[1]), width[n])
                    whole += (len(where), square[where].sum())
        if now is not None:
            yield table(now, types, state)

    schema = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in WINDOW) + ", num_leaves int, a int, b int, v double"
    return dealt.mapInArrow(counted, schema).groupBy(*WINDOW, "num_leaves", "a", "b").agg(F.sum("v").alias("v"))


class Tables:
    """Dense statistics of one number of leaves, added up window by window."""

    def __init__(self, frame: pd.DataFrame, n_leaves: int):
        self.size = len(FEATURES) * (n_leaves + 1)
        self.groups = np.arange(self.size).reshape(len(FEATURES), n_leaves + 1)
        self.frames = {w: f for w, f in frame.groupby(WINDOW)}

    def add(self, windows: list, even: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """Joint counts, centred target sums and squared running targets over ``windows``;
        ``even`` weighs every window alike."""
        gram, sums, square = np.zeros((self.size, self.size)), np.zeros((self.size, 5)), 0.0
        for w in windows:
            if w not in self.frames:
                continue
            f = self.frames[w]
            a, b, v = f["a"].to_numpy(), f["b"].to_numpy(), f["v"].to_numpy()
            rows = v[(a == -1) & (b == -1)][0]
            scale = 1.0 / rows / len(windows) if even else 1.0
            pair, target = (a >= 0) & (b >= 0), (a >= 0) & (b < 0)
            np.add.at(gram, (a[pair], b[pair]), v[pair] * scale)
            np.add.at(sums, (a[target], -b[target] - 1), v[target] * scale)
            square += v[(a == -1) & (b == -2)][0] * scale
        gram = gram + np.triu(gram, 1).T
        return gram, sums - 0.2 * np.diag(gram)[:, None], square


def boost(gram: np.ndarray, sums: np.ndarray, groups: np.ndarray, rounds: int, min_data: float, step: float):
    """Yield (cells, change) of every round: the leaves of the chosen feature and what they add."""
    counts = np.diag(gram)
    usable = counts >= max(min_data, 1)
    weight = np.where(usable, 1.0 / np.maximum(counts, 1.0), 0.0)
    left = sums.copy()  # sums of residuals by leaf
    for _ in range(rounds):
        mean = left * weight[:, None]
        gain = (left * mean).sum(1)[groups].sum(1)
        cells = groups[int(np.argmax(gain.round(12)))]
        change = step * mean[cells]
        if not change.any():
            return
        left -= gram[:, cells] @ change
        yield cells, change


def searched(train, val, groups, rounds: int, patience: int, min_data: float, step: float) -> tuple[int, float, int]:
    """(best rounds, its RPS on the validation windows, round the search ended at)."""
    gram, sums, square = val
    cumulate = np.triu(np.ones((5, 5)))
    target, applied = sums @ cumulate, np.zeros_like(sums)
    score, best, at, r = square, np.inf, 0, 0
    for r, (cells, change) in enumerate(boost(train[0], train[1], groups, rounds, min_data, step), 1):
        change = change @ cumulate
        score += 2 * (change * (applied[cells] - target[cells])).sum()
        moved = gram[:, cells] @ change
        score += (change * moved[cells]).sum()
        applied += moved
        if round(score / 5, 12) < best:
            best, at = round(score / 5, 12), r
        elif r - at >= patience:
            break
    return (at, best, r) if at else (0, round(square / 5, 12), r)


OUTPUT = "k int, config int, rounds int, stopped_at int, val_rps double, cell int, " + ", ".join(f"b{q} double" for q in range(1, 6))


def fitted(samples: DataFrame, parts: DataFrame, model: Boosting) -> DataFrame:
    """(k, config, rounds, stopped_at, val_rps, cell, b1..b5): every configuration of every origin with
    enough windows, searched on its validation windows and fitted on all of them.

    ``parts`` holds (k, base_date, end_date, part).
    """
    uses: dict[int, dict[str, list]] = {}
    for r in parts.select("k", *WINDOW, "part").orderBy("k", "base_date").collect():  # calendar-sized
        uses.setdefault(r["k"], {"train": [], "gap": [], "val": []})[r["part"]].append((r["base_date"], r["end_date"]))
    uses = {k: u for k, u in uses.items() if len(u["train"]) >= model.min_train_windows}
    configs = [(i, c["num_leaves"], c["min_data_in_leaf"]) for i, c in enumerate(model.configs())]
    table = samples.sparkSession.createDataFrame(configs, "config int, leaves int, min_data int")
    stats = stage(statistics(samples, model.leaves()), "leaf_statistics")
    rows = stats.join(F.broadcast(table), F.col("num_leaves") == F.col("leaves")).drop("leaves")
    limit, patience, step = model.max_rounds, model.patience, model.step_size

    def fit(key, frame):
        config, min_data, n_leaves = int(key[0]), int(frame["min_data"].iloc[0]), int(frame["num_leaves"].iloc[0])
        tables, out = Tables(frame, n_leaves), []
        for k, u in sorted(uses.items()):
            train, val = tables.add(u["train"], False), tables.add(u["val"], True)
            rounds, rps, ended = searched(train, val, tables.groups, limit, patience, min_data, step)
            whole = tables.add(u["train"] + u["gap"] + u["val"], False)
            beta = np.zeros((tables.size, 5))
            for cells, change in boost(whole[0], whole[1], tables.groups, rounds, min_data, step):
                beta[cells] += change
            out.append(pd.DataFrame({
                "k": k, "config": config, "rounds": rounds, "stopped_at": ended, "val_rps": rps, "cell": range(tables.size),
                **{f"b{q + 1}": beta[:, q] for q in range(5)},
            }))
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return rows.groupBy("config").applyInPandas(fit, OUTPUT)


def forecast(
    samples: DataFrame, windows: DataFrame, origin_rows: DataFrame, model: Boosting | None = None
) -> tuple[DataFrame, DataFrame]:
    """Forecasts (model, k, symbol, Rank1..5) of every origin in ``windows`` and the search log.

    ``samples`` are clean window samples, ``windows`` the past windows per (k, origin).  An origin
    with too few training windows gets the uniform forecast.  Negative shares become 0 before
    a row is normalised.
    """
    model = model or Boosting()
    parts = stage(sm.split_windows(windows.select("k", "origin", *WINDOW), model.n_val, model.embargo), "parts")
    models = stage(fitted(samples, parts, model), "boosted")
    tries = models.where("cell = 0").select("k", "config", "rounds", "stopped_at", "val_rps")
    best = tries.groupBy("k").agg(F.min(F.struct("val_rps", "config"))["config"].alias("_best"))
    configs = samples.sparkSession.createDataFrame(
        [(i, c["num_leaves"], c["min_data_in_leaf"]) for i, c in enumerate(model.configs())],
        "config int, num_leaves int, min_data_in_leaf int",
    )
    marked = tries.join(best, "k").join(F.broadcast(configs), "config").selectExpr(
        "k", "config", "num_leaves", "min_data_in_leaf", "rounds", "stopped_at", "val_rps", "config = _best AS chosen"
    )
    counts = parts.groupBy("k", "origin").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("part") == "train").alias("_train")
    ).selectExpr("k", "origin", "n_windows", f"_train < {model.min_train_windows} AS fallback")
    log = stage(counts.join(marked, "k", "left"), "boosted_search")
    chosen = models.join(best.withColumnRenamed("_best", "config"), ["k", "config"]).join(
        F.broadcast(configs.select("config", "num_leaves")), "config"
    ).select("k", "num_leaves", "cell", *[f"b{q}" for q in range(1, 6)])
    # One row per origin: the leaves of its model as an array, so a row is forecast where it is.
    leaves = stage(
        chosen.groupBy("k", "num_leaves").agg(F.expr(f"array_sort(collect_list(struct(cell, {_SHARES}))) AS _leaves")),
        "boosted_leaves",
    )
    own = "CASE num_leaves " + " ".join(f"WHEN {n} THEN _cells{n}" for n in model.leaves()) + " END"
    shares = (
        origin_rows.join(F.broadcast(counts.select("k")), "k", "left_semi")
        .selectExpr("k", "symbol", *leaf_columns(model.leaves()))
        .join(F.broadcast(leaves), "k", "left")
        .selectExpr("k", "symbol", "_leaves", f"{own} AS _own")
        .selectExpr(
            "k", "symbol",
            *[
                "greatest(0D, round(" + " + ".join(f"_leaves[_own[{i}]].b{q}" for i in range(len(FEATURES))) + f" + 0.2D, 12)) AS p{q}"
                for q in range(1, 6)
            ],
            "_leaves IS NOT NULL AS _fitted",
        )
    )
    total = " + ".join(f"p{q}" for q in range(1, 6))
    out = shares.selectExpr(
        f"'{model.name}' AS model", "k", "symbol",
        *[f"CASE WHEN _fitted THEN coalesce(p{q} / ({total}), 0.2D) ELSE 0.2D END AS {c}" for q, c in enumerate(RANKS, 1)],
    )
    return out, log
