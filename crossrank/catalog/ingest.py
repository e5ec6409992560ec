"""Source and sink queries: data written by Spark in the stored form and loaded back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossrank.catalog import query
from crossrank.catalog.evaluation import _R, _TILT, rounded
from crossrank.catalog.fragments import with_parts
from crossrank.operators import calendar as cal
from crossrank.operators import forecasts as fc
from crossrank.operators import universe as un
from crossrank.schema import RANKS
from crossrank.sinks import tables as sink
from crossrank.sources import official, runs, vendor
from crossrank.sources import splice as sp
from crossrank.sources.star_schema import GRID_ORIGIN, asset_key, panels
from crossrank.staging import shared_folder, stage


def _new(spark, name):
    return f"{shared_folder(spark)}/crossrank/{name}_{uuid.uuid4().hex[:12]}"


@query(with_parts("prices", "SELECT symbol, date, price FROM prices"))
def official_assets(spark, folder):
    p = panels(spark, folder)
    path = _new(spark, "assets_text")
    p.prices.selectExpr(
        "symbol", "date_format(date, 'yyyy/MM/dd') AS date", "string(price) AS price"
    ).write.option("compression", "zstd").parquet(path)
    return official.load_assets(spark, path)


@query(
    with_parts(
        "subs",
        f"SELECT Team, Submission, Evaluation, Symbol, ROUND(Decision, 12) AS Decision, {_R}, IsActive, "
        "CASE WHEN k % 2 = 0 THEN k::BIGINT END AS RpsHashCode, NULL::BIGINT AS IrHashCode FROM subs",
    )
)
def official_submissions(spark, folder):
    p = panels(spark, folder)
    path = _new(spark, "submissions_text")
    p.submissions.selectExpr(
        *[f"string({c}) AS {c}" for c in p.submissions.columns if c != "k"],
        "CASE WHEN k % 2 = 0 THEN string(k) ELSE '' END AS RpsHashCode",
        "'' AS IrHashCode",
    ).write.option("compression", "zstd").parquet(path)
    return rounded(official.load_submissions(spark, path), Decision=12, **dict.fromkeys(RANKS, 9))


@query(
    with_parts(
        "syms",
        "SELECT symbol AS ID, 0.2::DOUBLE AS Rank1, 0.2::DOUBLE AS Rank2, 0.2::DOUBLE AS Rank3, 0.2::DOUBLE AS Rank4, 0.2::DOUBLE AS Rank5, "
        "0.01::DOUBLE AS Decision FROM syms UNION ALL SELECT 'META', 0.2, 0.2, 0.2, 0.2, 0.2, 0.01",
    )
)
def official_template(spark, folder):
    p = panels(spark, folder)
    path = _new(spark, "template_text")
    names = p.symbols.union(spark.createDataFrame([("FB",)], "symbol string"))
    names.selectExpr("symbol AS ID", *[f"'0.2' AS {c}" for c in RANKS], "'0.01' AS Decision").write.parquet(path)
    return official.load_template(spark, path)


@query(
    with_parts(
        "dayk cal",
        "SELECT label AS evaluation, base_date, end_date, CAST(n AS INTEGER) AS n_days FROM cal JOIN (SELECT k, COUNT(*) AS n FROM dayk GROUP BY 1) USING (k)",
    )
)
def calendar_from_days(spark, folder):
    p = panels(spark, folder)
    inside = cal.period_days(p.calendar, p.days).select("k", F.col("date").alias("day"))
    table = inside.union(p.calendar.select("k", "base_date")).join(
        F.broadcast(p.calendar.selectExpr("k", "label AS evaluation")), "k"
    )
    return official.calendar_from_days(table.select("evaluation", "day"))


@query(
    with_parts(
        "board",
        "SELECT 'month' AS level, CAST(period AS INTEGER) AS period, team, 'Team ' || team AS team_name, ROUND(rps, 5) AS rps, ROUND(ir, 5) AS ir, "
        "rps_rank, ir_rank, overall_rank, position FROM board WHERE level = 'month'",
    )
)
def official_leaderboard(spark, folder):
    from crossrank.operators import leaderboard as lb

    p = panels(spark, folder)
    board = lb.leaderboard(p.team_scores, ("month",))
    text = board.selectExpr(
        f"concat(team, '{official.NBSP}', 'Team ', team) AS team", "string(period) AS period",
        "string(round(rps, 5)) AS rps", "string(round(ir, 5)) AS ir",
        *[f"string({c}) AS {c}" for c in ("rps_rank", "ir_rank", "overall_rank", "position")],
    )
    return official.load_leaderboard(text, "month")


@query(with_parts("raw grid", 'SELECT symbol, date, adjusted_close AS price FROM raw WHERE date <= (SELECT MAX("end") FROM grid)'))
def vendor_prices(spark, folder):
    p = panels(spark, folder)
    return vendor.load_prices(p.ohlcv, str(p.calendar.select(F.max("end")).first()[0]))


@query(with_parts("second", "SELECT symbol, date, price FROM second"))
def second_source(spark, folder):
    raw = panels(spark, folder).second_source.withColumnRenamed("price", "adjusted_close")
    return vendor.load_prices(raw)


@query(
    with_parts(
        "syms",
        "SELECT symbol, CASE WHEN symbol LIKE '%.L' THEN replace(symbol, '.L', '.LSE') ELSE symbol || '.US' END AS ticker, symbol AS second_ticker FROM syms",
    )
)
def vendor_tickers(spark, folder):
    return panels(spark, folder).symbols.selectExpr(
        "symbol", f"{vendor.ticker()} AS ticker", f"{vendor.ticker('symbol', vendor.SECOND)} AS second_ticker"
    )


@query(
    with_parts(
        "prices",
        """SELECT symbol, COUNT(*) AS rows, CASE WHEN sk % 17 = 3 THEN MAX(date) ELSE MIN(date) END AS first,
        CASE WHEN sk % 17 = 3 THEN MIN(date) ELSE MAX(date) END AS last,
        concat_ws(';', CASE WHEN sk % 17 = 3 THEN 'dates not sorted' END, CASE WHEN sk % 19 = 2 THEN 'non-positive adjusted_close' END) AS problems,
        CASE WHEN sk % 10 = 1 THEN 'limited' ELSE '' END AS warnings FROM prices GROUP BY symbol, sk
        UNION ALL SELECT 'ABSENT', 0, NULL, NULL, 'no rows', ''""",
    )
)
def download_report(spark, folder):
    p = panels(spark, folder)
    sk = asset_key(F.col("symbol"))
    order = F.unix_date("date")
    rows = p.prices.select(
        "symbol",
        "date",
        F.when(sk % 17 == 3, -order).otherwise(order).alias("entry_no"),
        F.when((sk % 19 == 2), -F.col("price")).otherwise(F.col("price")).alias("adjusted_close"),
    )
    warnings = p.symbols.where(sk % 10 == 1).select("symbol", F.lit("limited").alias("warning"))
    wanted = p.symbols.union(spark.createDataFrame([("ABSENT",)], "symbol string"))
    return vendor.download_report(wanted, rows, warnings).selectExpr(
        "symbol", "rows", "first", "last", "concat_ws(';', problems) AS problems",
        "concat_ws(';', warnings) AS warnings",
    )


_SPLICE = """SELECT symbol, date, price FROM prices WHERE date >= DATE '1998-01-05' AND sk % 10 != 9
UNION ALL SELECT h.symbol, h.date, h.price * (f.level / a.anchor) FROM hist3 h JOIN (
  SELECT symbol, MIN(date) AS first, arg_min(price, date) AS level FROM prices WHERE date >= DATE '1998-01-05' AND sk % 10 != 9 GROUP BY 1) f USING (symbol)
JOIN (SELECT h.symbol, arg_max(h.price, h.date) AS anchor FROM hist3 h JOIN (SELECT symbol, MIN(date) AS first FROM prices WHERE date >= DATE '1998-01-05' AND sk % 10 != 9 GROUP BY 1) g
  ON g.symbol = h.symbol AND h.date <= g.first GROUP BY 1) a USING (symbol) WHERE h.date < f.first
UNION ALL SELECT symbol, date, price FROM hist3 WHERE sk % 10 = 9 AND (date < DATE '1998-01-05' OR date IN
  (SELECT date FROM prices WHERE date >= DATE '1998-01-05' AND sk % 10 != 9))"""


def _hist3() -> str:
    return (
        with_parts("prices", "").rstrip()
        + ", hist3 AS MATERIALIZED (SELECT symbol, date, sk, CASE WHEN date < DATE '1998-01-05' THEN price * 3 ELSE price END AS price FROM prices) "
    )


@query(f"{_hist3()} SELECT symbol, date, ROUND(price, 6) AS price FROM ({_SPLICE})")
def spliced_prices(spark, folder):
    history, given = panels(spark, folder).history_and_official
    return rounded(sp.splice(history, given), price=6)


@query(
    f"{_hist3()} SELECT phase, symbol, COUNT(*) AS rows, ROUND(SUM(price), 4) AS total FROM (SELECT 'period1' AS phase, symbol, price FROM ({_SPLICE}) "
    "UNION ALL SELECT 'period2', symbol, price FROM hist3) GROUP BY 1, 2"
)
def phase_prices(spark, folder):
    history, given = panels(spark, folder).history_and_official
    return sp.phase_prices(history, given).groupBy("phase", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 4).alias("total")
    )


@query(
    with_parts(
        "cal",
        "SELECT phase AS experiment, MAX(strftime(base_date, '%Y-%m-%d') || '_abc1234') AS run FROM cal WHERE k % 3 != 0 GROUP BY 1",
    )
)
def latest_runs(spark, folder):
    p = panels(spark, folder)
    registry = p.calendar.selectExpr(
        "phase AS experiment",
        "concat(string(base_date), '_abc1234', CASE WHEN k % 3 = 0 THEN '-dirty' ELSE '' END) AS run",
    )
    return runs.latest_runs(registry)


@query(with_parts("fc cal", f"SELECT model, phase, label, k, symbol, {_R}, ROUND(weight, 9) AS weight FROM fc JOIN cal USING (k)"))
def stored_forecasts(spark, folder):
    p = panels(spark, folder)
    path = _new(spark, "forecast_sink")
    sink.write_forecasts(p.forecasts, p.calendar, path)
    schema = (
        "symbol STRING, " + ", ".join(f"{c} DOUBLE" for c in RANKS)
        + ", weight DOUBLE, label STRING, k INT, model STRING, phase STRING"
    )
    return rounded(spark.read.schema(schema).parquet(path), weight=9, **dict.fromkeys(RANKS, 9))


@query(
    with_parts(
        "fill",
        "SELECT date, symbol, price FROM fill WHERE symbol != 'S1' UNION ALL SELECT date, 'S1', price FROM fill WHERE symbol = 'S2'",
    )
)
def exported_prices(spark, folder):
    p = panels(spark, folder)
    return sink.export_long(p.prices, p.symbols, p.days, {"S1": "S2"})


def _cut(column: str) -> str:
    """Five decimals, as an outside method would write them."""
    return f"FLOOR(ROUND({column}, 9) * 100000) / CAST(100000 AS DOUBLE)"


_LAND = (
    "SELECT h.k, h.symbol AS ID, "
    + ", ".join(f"{_cut(f'h.Rank{q}')} AS Rank{q}" for q in range(1, 6))
    + f", {_cut('t.weight')} AS Decision FROM hist h JOIN tilt t ON t.k = h.k AND t.symbol = h.symbol"
)
_TOTAL = "(Rank1 + Rank2 + Rank3 + Rank4 + Rank5)"


@query(
    with_parts("hist", "").rstrip()
    + f""", tilt AS MATERIALIZED ({_TILT.format('hist')}), land AS MATERIALIZED ({_LAND})
    SELECT 'outside' AS model, k, ID AS symbol, {', '.join(f'ROUND(Rank{q} / {_TOTAL}, 9) AS Rank{q}' for q in range(1, 6))},
    ROUND(CASE WHEN g > 1 AND g <= 1.001 THEN Decision / g ELSE Decision END, 9) AS weight
    FROM land JOIN (SELECT k, SUM(ABS(Decision)) AS g FROM land GROUP BY 1) USING (k)"""
)
def external_forecast(spark, folder):
    p = panels(spark, folder)
    tilt = un.with_weights(p.history_forecast, ["model", "k"], "expected_rank")
    path = _new(spark, "landed")
    tilt.selectExpr(
        "k", "symbol AS ID", *[f"{_cut(c)} AS {c}" for c in RANKS], f"{_cut('weight')} AS Decision"
    ).write.option("header", True).csv(path)
    schema = "k INT, ID STRING, " + ", ".join(f"{c} DOUBLE" for c in RANKS) + ", Decision DOUBLE"
    landed = spark.read.csv(path, header=True, schema=schema)
    out = fc.external_forecast(landed, p.members, "outside", decisions=True)
    return rounded(out, weight=9, **dict.fromkeys(RANKS, 9))


@query(with_parts("grid", 'SELECT k, label, phase, base, start, "end" FROM grid WHERE "end" = (SELECT MAX("end") FROM grid WHERE "end" < (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem))'))
def last_complete_period(spark, folder):
    p = panels(spark, folder)
    return cal.last_complete_period(spark, GRID_ORIGIN, str(p.last_day)).drop("deadline")
