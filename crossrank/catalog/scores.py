"""Quintile targets and RPS queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.fragments import rps_sql, targets_sql, with_parts
from crossrank.functions.scores import TARGETS
from crossrank.operators import targets as tg
from crossrank.sources.star_schema import panels

_T = ", ".join(f"ROUND(Target{q}, 9) AS Target{q}" for q in range(1, 6))


@query(with_parts("targets", f"SELECT k, symbol, n, {_T} FROM targets"))
def quintile_targets(spark, folder):
    p = panels(spark, folder)
    return tg.quintile_targets(p.returns, ["k"], bounded=True).select(
        "k", "symbol", "n", *[F.round(t, 9).alias(t) for t in TARGETS]
    )


@query(
    with_parts(
        "rets",
        f"SELECT k, symbol, n, {_T} FROM ("
        + targets_sql("(SELECT k, symbol, ROUND(ret, 2) AS ret FROM rets)", "k")
        + ")",
    )
)
def quintile_targets_ties(spark, folder):
    p = panels(spark, folder)
    coarse = p.returns.select("k", "symbol", F.round("ret", 2).alias("ret"))
    return tg.quintile_targets(coarse, ["k"], bounded=True).select(
        "k", "symbol", "n", *[F.round(t, 9).alias(t) for t in TARGETS]
    )


@query(
    with_parts(
        "rets",
        "SELECT k, symbol, CAST(list_position([Target1, Target2, Target3, Target4, Target5], GREATEST(Target1, Target2, Target3, Target4, Target5)) AS INTEGER) AS quintile FROM ("
        + targets_sql("(SELECT k, symbol, ROUND(ret, 2) AS ret FROM rets)", "k")
        + ")",
    )
)
def hard_quintiles(spark, folder):
    from crossrank.functions.scores import hard_quintile

    p = panels(spark, folder)
    coarse = p.returns.select("k", "symbol", F.round("ret", 2).alias("ret"))
    return tg.quintile_targets(coarse, ["k"], bounded=True).selectExpr(
        "k", "symbol", f"{hard_quintile(TARGETS)} AS quintile"
    )


@query(
    with_parts(
        "rets",
        "SELECT k, n, CASE WHEN n = 100 THEN 'official' ELSE 'proportional' END AS rule FROM (SELECT k, COUNT(*) AS n FROM rets GROUP BY 1)",
    )
)
def thresholds_rule(spark, folder):
    sizes = panels(spark, folder).returns.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("rule", tg.thresholds_rule(F.col("n")))


@query(
    with_parts(
        "subs targets",
        f"SELECT f.Team AS model, f.k, f.Symbol AS symbol, ROUND({rps_sql()}, 9) AS rps FROM subs f JOIN targets t USING (k, symbol)",
    )
)
def rps_per_asset(spark, folder):
    p = panels(spark, folder)
    scored = tg.rps_per_asset(
        p.team_forecasts, tg.quintile_targets(p.returns, ["k"], bounded=True), ["k", "symbol"]
    )
    return scored.select("model", "k", "symbol", F.round("rps", 9).alias("rps"))
