"""Price panel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.fragments import with_parts
from crossrank.operators import panel
from crossrank.sources.star_schema import panels


@query(with_parts("prices", "SELECT symbol, date, price FROM prices"))
def price_panel(spark, folder):
    return panels(spark, folder).prices.select("symbol", "date", "price")


@query(
    with_parts(
        "rets",
        "SELECT k, symbol, base_price, end_price, ROUND(ret, 9) AS ret FROM rets",
    )
)
def period_returns(spark, folder):
    return panels(spark, folder).returns.withColumn("ret", F.round("ret", 9))


@query(
    with_parts(
        "keyed",
        "SELECT symbol, date, COUNT(*) AS rows FROM (SELECT symbol, date FROM keyed UNION ALL "
        "SELECT symbol, date FROM keyed WHERE sk % 9 = 4) GROUP BY 1, 2 HAVING COUNT(*) > 1",
    )
)
def duplicate_keys(spark, folder):
    from crossrank.sources.star_schema import asset_key

    prices = panels(spark, folder).prices.select("symbol", "date")
    planted = prices.where(asset_key(F.col("symbol")) % 9 == 4)
    return panel.duplicate_keys(prices.unionByName(planted))


@query(
    with_parts(
        "fill cal",
        "SELECT c.k, f.symbol, f.date, f.price FROM cal c JOIN fill f ON f.date BETWEEN c.base_date AND c.end_date",
    )
)
def period_prices(spark, folder):
    p = panels(spark, folder)
    return panel.period_prices(p.prices, p.calendar, p.days)


@query(with_parts("spell", "SELECT symbol, date, price, ROUND(r, 9) AS ret FROM spell"))
def daily_returns(spark, folder):
    return panel.daily_returns(panels(spark, folder).prices).withColumn("ret", F.round("ret", 9))


@query(
    with_parts(
        "prices",
        "SELECT symbol, date, ROUND(LN(price), 9) AS log_price, ROUND(LN(price) - lag(LN(price)) OVER (PARTITION BY symbol ORDER BY date), 9) AS log_ret FROM prices",
    )
)
def log_returns(spark, folder):
    out = panel.log_returns(panels(spark, folder).prices)
    return out.select("symbol", "date", F.round("log_price", 9).alias("log_price"), F.round("log_ret", 9).alias("log_ret"))


@query(with_parts("fill syms", "SELECT symbol, date, price FROM fill WHERE symbol NOT IN (SELECT symbol FROM syms WHERE sk % 25 = 7)"))
def dense_panel(spark, folder):
    p = panels(spark, folder)
    kept = p.symbols.join(p.delistings, "symbol", "left_anti")
    return panel.dense_grid(p.prices, p.days, kept).select("symbol", "date", "price")


@query(
    with_parts(
        "prices cal",
        "SELECT c.base_date AS date, p.symbol, arg_max(p.price, p.date) AS price, MAX(p.date) AS last_date, MIN(p.date) AS first_date, COUNT(*) AS n_rows "
        "FROM cal c JOIN prices p ON p.date <= c.base_date GROUP BY 1, 2",
    )
)
def history_cut(spark, folder):
    p = panels(spark, folder)
    return panel.history_at(p.prices, p.origins.selectExpr("origin AS date"), p.days)
