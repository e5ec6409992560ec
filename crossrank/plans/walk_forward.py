"""Walk-forward evaluation of forecast tables, all periods and models in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.scores import TARGETS
from crossrank.operators import forecasts as fc
from crossrank.operators import portfolio as pf
from crossrank.operators import targets as tg
from crossrank.operators.calendar import period_days
from crossrank.operators.panel import period_returns, require_empty
from crossrank.operators.universe import universe
from crossrank.schema import RANKS
from crossrank.staging import stage


@dataclass(frozen=True)
class WalkForward:
    forecasts: DataFrame  # model, k, symbol, Rank1..5, weight
    daily: DataFrame  # model, k, date, is_first, ret, ret_net
    periods: DataFrame  # one row per model and period

    def summary(self, zero_variance: float | None = None) -> DataFrame:
        """Mean RPS and pooled IR, gross and net, per model and phase."""
        scores = self.periods.groupBy("model", "phase").agg(
            F.count(F.lit(1)).alias("n_periods"), F.avg("rps").alias("rps")
        )
        phases = F.broadcast(self.periods.select("k", "phase").distinct())
        pooled = (
            self.daily.join(phases, "k")
            .groupBy("model", "phase")
            .agg(
                F.expr(pf.ratio_sql("ret", zero_variance)).alias("ir"),
                F.expr(pf.ratio_sql("ret_net", zero_variance)).alias("ir_net"),
                F.expr(pf.sharpe_sql("ret")).alias("sharpe"),
                F.expr(pf.sharpe_sql("ret_net")).alias("sharpe_net"),
            )
        )
        return scores.join(pooled, ["model", "phase"])


def member_targets(returns: DataFrame, members: DataFrame) -> DataFrame:
    """Targets among the members of each period; the quintile limits follow their number.

    A table of members is stored in about a byte a row, so its files do not tell that it is too large for a
    broadcast: joins with a row per asset and period say so themselves.
    """
    scored = returns.select("k", "symbol", "ret").join(members.hint("merge"), ["k", "symbol"], "left_semi")
    return tg.quintile_targets(stage(scored, "member_returns"), ["k"], bounded=True)


def run(
    forecasts: DataFrame,
    prices: DataFrame,
    periods: DataFrame,
    days: DataFrame,
    policy: str = "official",
    cost_bps: float = 0.0,
    zero_variance: float | None = None,
    assets: DataFrame | None = None,
    delistings: DataFrame | None = None,
    members: DataFrame | None = None,
    returns: DataFrame | None = None,
    validate: bool = True,
) -> WalkForward:
    """Validate and score ``forecasts`` on every period; costs are charged on the turnover."""
    if members is None:
        origins = periods.select("k", F.col("base_date").alias("origin"))
        members = universe(prices, origins, days, policy, assets, delistings)
    if returns is None:
        returns = period_returns(prices, periods, days)
    targets = members.join(
        member_targets(returns, members).select("k", "symbol", *TARGETS).hint("merge"), ["k", "symbol"], "left"
    )
    inside = period_days(periods, days)
    broken = " OR ".join(f"coalesce({sql}, false)" for sql in fc.row_problems().values())
    rows = forecasts.selectExpr("model", "k", "symbol", *RANKS, "weight", f"{broken} AS _broken")
    sums = {
        "_unknown": "count_if(date IS NULL AND NOT _member)",
        "_bad": "count_if(date IS NULL AND _broken)",
        "_gross": "sum(CASE WHEN date IS NULL THEN abs(weight) END)",
    }
    totals = stage(pf.period_totals(rows, targets, prices, inside, ["model"], sums), "totals")
    turned = stage(pf.turnover(forecasts, periods, ["model"]), "turnover")
    heads, moved = totals.where("date IS NULL"), totals.where("date IS NOT NULL")
    if validate:
        sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("_wanted"))
        doubtful = heads.join(F.broadcast(sizes), "k", "left").where(  # one row per period
            f"_unknown > 0 OR _bad > 0 OR _held < coalesce(_wanted, 0) OR NOT {fc.gross_within()}"
        )
        # Sums cannot tell a repeated symbol from a missing one, so then the rows are read once more.
        if turned.where("repeated > 0").limit(1).count() or doubtful.limit(1).count():
            require_empty(fc.forecast_violations(forecasts, members), "invalid forecasts")
    turned = turned.drop("repeated")
    scores = heads.where("_scored > 0").selectExpr("model", "k", "_sum / _scored AS rps", "_scored AS n_assets")
    gross = pf.log_of_sums(moved, heads.select("model", "k"), inside, ["model"])
    daily = stage(pf.net_returns(gross, turned, ["model"], cost_bps), "daily")
    ratios = daily.groupBy("model", "k").agg(
        F.expr(pf.ratio_sql("ret", zero_variance)).alias("ir"),
        F.expr(pf.ratio_sql("ret_net", zero_variance)).alias("ir_net"),
    )
    facts = periods.select(
        "k", "label", "phase", F.col("base_date").alias("origin"), "end_date"
    )
    table = (
        scores.join(ratios, ["model", "k"])
        .join(turned, ["model", "k"])
        .join(F.broadcast(facts), "k")  # one row per period
        .select(
            "model", "k", "label", "phase", "origin", "end_date", "n_assets",
            "rps", "ir", "ir_net", "turnover",
        )
    )
    return WalkForward(forecasts, daily, stage(table, "periods"))
