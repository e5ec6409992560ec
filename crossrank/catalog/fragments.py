"""SQL fragments the statements share, and the WITH clause that assembles them."""

from __future__ import annotations

import re

# name -> (names it needs, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (needs, body)


def with_parts(names: str, select: str) -> str:
    """``WITH`` clause of the named fragments and everything they need, then ``select``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in PARTS[name][0]:
            visit(need)
        ordered.append(name)

    for name in names.split():
        visit(name)
    clause = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in ordered)
    return f"WITH {clause}\n{select}"


part(
    "day0",
    """SELECT l_suppkey AS sk, CAST(l_shipdate AS DATE) AS date,
    CAST(FLOOR(SUM(CAST(ROUND(l_discount*100) AS BIGINT))*100.0/COUNT(*)) AS BIGINT) - 500 AS step,
    SUM(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""",
)
part(
    "keyed",
    """SELECT sk, date, volume, 'S' || sk || CASE WHEN sk % 5 = 0 THEN '.L' ELSE '' END AS symbol,
    ROUND(100*EXP(SUM(step) OVER (PARTITION BY sk ORDER BY date)/50000.0), 4) AS price FROM day0""",
    "day0",
)
part("prices", "SELECT symbol, date, price, sk FROM keyed", "keyed")
part(
    "days",
    "SELECT date AS day, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx "
    "FROM (SELECT DISTINCT date FROM prices)",
    "prices",
)
part(
    "labels0",
    """SELECT CAST(k AS INTEGER) AS k,
    CASE WHEN k = 0 THEN 'Trial run'
         WHEN k <= 12 THEN k || CASE k WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || ' Submission'
         ELSE 'P2-' || lpad(CAST(k - 12 AS VARCHAR), 2, '0') END AS label,
    CASE WHEN k = 0 THEN 'trial' WHEN k <= 12 THEN 'period1' ELSE 'period2' END AS phase
    FROM (SELECT unnest(range(-1, n)) AS k FROM (
        SELECT CAST(FLOOR((MAX(CAST(l_shipdate AS DATE)) - DATE '1996-01-05') / 28.0) AS BIGINT) AS n FROM lineitem))""",
)
part(
    "grid",
    """SELECT k, label, phase, DATE '1996-01-05' + CAST(28*k AS INTEGER) AS base,
    DATE '1996-01-08' + CAST(28*k AS INTEGER) AS start, DATE '1996-02-02' + CAST(28*k AS INTEGER) AS "end"
    FROM labels0 WHERE k >= 0""",
    "labels0",
)
part(
    "cal",
    """SELECT g.*, (SELECT MAX(day) FROM days WHERE day <= g.base) AS base_date,
    (SELECT MAX(day) FROM days WHERE day <= g."end") AS end_date FROM grid g""",
    "grid",
    "days",
)
part(
    "spell",
    """SELECT symbol, date, price,
    lead(date, 1, DATE '2999-01-01') OVER (PARTITION BY symbol ORDER BY date) AS next_date,
    MIN(date) OVER (PARTITION BY symbol) AS first_date,
    price / lag(price) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r
    FROM prices""",
    "prices",
)
part(
    "rets",
    """SELECT c.k, e.symbol, b.price AS base_price, e.price AS end_price,
    (e.price - b.price) / b.price AS ret
    FROM cal c JOIN spell e ON e.date <= c.end_date AND e.next_date > c.end_date
    LEFT JOIN spell b ON b.symbol = e.symbol AND b.date <= c.base_date AND b.next_date > c.base_date""",
    "cal",
    "spell",
)


def targets_sql(source: str, by: str, value: str = "ret") -> str:
    """Quintile shares from plain window ranks; ``by`` is a comma-separated key."""
    shares = ", ".join(
        f"GREATEST(LEAST(p + c - 1, {q}*n//5) - GREATEST(p - 1, {q - 1}*n//5), 0) / CAST(c AS DOUBLE) AS Target{q}"
        for q in range(1, 6)
    )
    return (
        f"SELECT * EXCLUDE (p, c), {shares} FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {value}) AS p, "
        f"COUNT(*) OVER (PARTITION BY {by}, {value}) AS c, COUNT(*) OVER (PARTITION BY {by}) AS n FROM {source})"
    )


def rps_sql(f: str = "f.Rank", t: str = "t.Target") -> str:
    terms = []
    for q in range(1, 6):
        gap = " + ".join(f"({t}{i} - {f}{i})" for i in range(1, q + 1))
        terms.append(f"POWER({gap}, 2)")
    return "((" + " + ".join(terms) + ") / 5)"


part("targets", targets_sql("(SELECT k, symbol, ret FROM rets)", "k"), "rets")
part(
    "subs",
    """SELECT 'T' || lpad(CAST(team AS VARCHAR), 2, '0') AS Team, c.k,
    CASE WHEN (team + c.k) % 3 = 0 THEN p.label ELSE l.label END AS Submission, l.label AS Evaluation,
    'S' || c.sk || CASE WHEN c.sk % 5 = 0 THEN '.L' ELSE '' END AS Symbol,
    CASE WHEN SUM(ABS(raw)) OVER w = 0 THEN 1.0 / COUNT(*) OVER w ELSE raw / CAST(SUM(ABS(raw)) OVER w AS DOUBLE) END AS Decision,
    (c1 + 1.0) / (n + 5) AS Rank1, (c2 + 1.0) / (n + 5) AS Rank2, (c3 + 1.0) / (n + 5) AS Rank3,
    (c4 + 1.0) / (n + 5) AS Rank4, (c5 + 1.0) / (n + 5) AS Rank5,
    CASE WHEN team = 11 THEN 0 ELSE 1 END AS IsActive
    FROM (
      SELECT t.team, g.k, s.sk, COUNT(l_orderkey) AS n,
      COUNT(l_orderkey) FILTER (band = 0) AS c1, COUNT(l_orderkey) FILTER (band = 1) AS c2,
      COUNT(l_orderkey) FILTER (band = 2) AS c3, COUNT(l_orderkey) FILTER (band = 3) AS c4,
      COUNT(l_orderkey) FILTER (band = 4) AS c5,
      CAST(COALESCE(SUM(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END), 0) AS BIGINT) AS raw
      FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS team) t CROSS JOIN grid g
      CROSS JOIN (SELECT DISTINCT sk FROM prices) s
      LEFT JOIN (SELECT *, CAST(l_partkey % 12 AS INTEGER) AS team, CAST(FLOOR((l_quantity - 1)/10) AS INTEGER) AS band,
                 CAST(l_shipdate AS DATE) AS d FROM lineitem) x
        ON x.team = t.team AND x.l_suppkey = s.sk AND x.d > g.base - 112 AND x.d <= g.base
      GROUP BY 1, 2, 3) c
    JOIN labels0 l ON l.k = c.k LEFT JOIN labels0 p ON p.k = c.k - 1
    WINDOW w AS (PARTITION BY team, c.k)""",
    "grid",
    "labels0",
    "prices",
)
part(
    "dayk",
    "SELECT c.k, d.day AS date FROM cal c JOIN days d ON d.day > c.base_date AND d.day <= c.end_date",
    "cal",
    "days",
)
part("syms", "SELECT symbol, any_value(sk) AS sk, MIN(date) AS first_date FROM prices GROUP BY 1", "prices")
part("delist", "SELECT symbol, DATE '1999-01-15' AS delisted FROM syms WHERE sk % 25 = 7", "syms")
part("members", "SELECT c.k, s.symbol FROM cal c JOIN syms s ON s.first_date <= c.base_date", "cal", "syms")
part(
    "members_d2",
    "SELECT m.k, m.symbol FROM members m JOIN cal c USING (k) LEFT JOIN delist d USING (symbol) "
    "WHERE d.delisted IS NULL OR d.delisted > c.base_date",
    "members",
    "delist",
    "cal",
)
part(
    "win",
    """SELECT k, origin, j, wb, we FROM (
    SELECT *, MIN(CASE WHEN wb IS NULL OR we <= wb THEN j END) OVER (PARTITION BY k) AS stop FROM (
      SELECT c.k, c.base_date AS origin, CAST(j AS INTEGER) AS j,
      (SELECT MAX(day) FROM days WHERE day <= c.base_date - CAST(28*(j+1) AS INTEGER)) AS wb,
      (SELECT MAX(day) FROM days WHERE day <= c.base_date - CAST(28*j AS INTEGER)) AS we
      FROM cal c CROSS JOIN (SELECT unnest(range(0, 100)) AS j) r)
    ) WHERE stop IS NULL OR j < stop""",
    "cal",
    "days",
)
part(
    "wlevel",
    """SELECT d.date, s.symbol, s.price FROM (SELECT wb AS date FROM win UNION SELECT we FROM win) d
    JOIN spell s ON s.date <= d.date AND s.next_date > d.date""",
    "win",
    "spell",
)
part(
    "wret",
    """SELECT w.wb, w.we, e.symbol, (e.price - b.price) / b.price AS ret
    FROM (SELECT DISTINCT wb, we FROM win) w JOIN wlevel e ON e.date = w.we
    JOIN wlevel b ON b.date = w.wb AND b.symbol = e.symbol""",
    "win",
    "wlevel",
)


def history_sql(members: str) -> str:
    counts = ", ".join(f"SUM(Target{q}) AS c{q}" for q in range(1, 6))
    ranks = ", ".join(
        f"(COALESCE(c{q}, 0) + 1.0) / (COALESCE(c1 + c2 + c3 + c4 + c5, 0) + 5.0) AS Rank{q}"
        for q in range(1, 6)
    )
    source = (
        f"(SELECT w.k, w.j, r.symbol, r.ret FROM win w JOIN wret r USING (wb, we) "
        f"JOIN {members} m ON m.k = w.k AND m.symbol = r.symbol)"
    )
    return (
        f"SELECT 'historical_frequency' AS model, m.k, m.symbol, {ranks}, "
        f"1.0 / COUNT(*) OVER (PARTITION BY m.k) AS weight FROM {members} m LEFT JOIN "
        f"(SELECT k, symbol, {counts} FROM ({targets_sql(source, 'k, j')}) WHERE n >= 5 GROUP BY 1, 2) c "
        "ON c.k = m.k AND c.symbol = m.symbol"
    )


part("hist", history_sql("members"), "win", "wret", "members")
part("hist_d2", history_sql("members_d2"), "win", "wret", "members_d2")


def uniform_sql(members: str) -> str:
    return (
        "SELECT 'uniform' AS model, k, symbol, 0.2::DOUBLE AS Rank1, 0.2::DOUBLE AS Rank2, 0.2::DOUBLE AS Rank3, "
        f"0.2::DOUBLE AS Rank4, 0.2::DOUBLE AS Rank5, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY k) AS weight FROM {members}"
    )


part(
    "fc",
    f"{uniform_sql('members')} UNION ALL SELECT * FROM hist UNION ALL SELECT Team AS model, k, "
    "Symbol AS symbol, Rank1, Rank2, Rank3, Rank4, Rank5, Decision AS weight FROM subs",
    "members",
    "hist",
    "subs",
)
part("fc_d2", f"{uniform_sql('members_d2')} UNION ALL SELECT * FROM hist_d2", "members_d2", "hist_d2")


def turnover_sql(fc: str) -> str:
    return (
        f"SELECT COALESCE(a.model, b.model) AS model, COALESCE(a.k, b.k + 1) AS k, "
        "SUM(ABS(COALESCE(a.weight, 0) - COALESCE(b.weight, 0))) AS turnover "
        f"FROM {fc} a FULL OUTER JOIN (SELECT * FROM {fc} WHERE k < (SELECT MAX(k) FROM {fc})) b "
        "ON a.model = b.model AND a.symbol = b.symbol AND a.k = b.k + 1 GROUP BY 1, 2"
    )


def daily_sql(fc: str, ids: str = "model") -> str:
    return (
        f"SELECT g.{ids}, d.k, d.date, LN(1 + COALESCE(s.x, 0)) AS ret, "
        f"row_number() OVER (PARTITION BY g.{ids}, d.k ORDER BY d.date) = 1 AS is_first "
        f"FROM (SELECT DISTINCT {ids}, k FROM {fc}) g JOIN dayk d ON d.k = g.k LEFT JOIN "
        f"(SELECT f.{ids}, f.k, p.date, SUM(f.weight * p.r) AS x FROM {fc} f JOIN dayk d ON d.k = f.k "
        "JOIN spell p ON p.symbol = f.symbol AND p.date = d.date GROUP BY 1, 2, 3) s "
        f"ON s.{ids} = g.{ids} AND s.k = d.k AND s.date = d.date"
    )


def net_sql(daily: str, turn: str) -> str:
    return (
        "SELECT d.*, CASE WHEN is_first THEN LN(1 + (EXP(ret) - 1 - 0.001 * turnover)) ELSE ret END AS ret_net "
        f"FROM {daily} d JOIN {turn} t USING (model, k)"
    )


def ratio_sql(col: str, zero: str = "NULL") -> str:
    return f"CASE WHEN STDDEV_SAMP({col}) = 0 THEN {zero} ELSE SUM({col}) / STDDEV_SAMP({col}) END"


def periods_sql(fc: str, targets: str, net: str, turn: str) -> str:
    return (
        "SELECT s.model, s.k, c.label, c.phase, c.base_date AS origin, c.end_date, s.n_assets, s.rps, i.ir, i.ir_net, t.turnover "
        f"FROM (SELECT f.model, f.k, AVG({rps_sql()}) AS rps, COUNT(*) AS n_assets FROM {fc} f JOIN {targets} t USING (k, symbol) GROUP BY 1, 2) s "
        f"JOIN (SELECT model, k, {ratio_sql('ret')} AS ir, {ratio_sql('ret_net')} AS ir_net FROM {net} GROUP BY 1, 2) i USING (model, k) "
        f"JOIN {turn} t USING (model, k) JOIN cal c ON c.k = s.k"
    )


for _suffix, _members in (("", "members"), ("_d2", "members_d2")):
    part(f"turn{_suffix}", turnover_sql(f"fc{_suffix}"), f"fc{_suffix}")
    part(f"gross{_suffix}", daily_sql(f"fc{_suffix}"), f"fc{_suffix}", "dayk", "spell")
    part(f"net{_suffix}", net_sql(f"gross{_suffix}", f"turn{_suffix}"), f"gross{_suffix}", f"turn{_suffix}")
    part(
        f"mtargets{_suffix}",
        targets_sql(f"(SELECT r.k, r.symbol, r.ret FROM rets r JOIN {_members} m USING (k, symbol))", "k"),
        "rets",
        _members,
    )
    part(
        f"periods{_suffix}",
        periods_sql(f"fc{_suffix}", f"mtargets{_suffix}", f"net{_suffix}", f"turn{_suffix}"),
        f"fc{_suffix}",
        f"mtargets{_suffix}",
        f"net{_suffix}",
        f"turn{_suffix}",
        "cal",
    )

part(
    "tscores",
    f"""SELECT Team AS team, k, AVG({rps_sql('f.Rank', 't.Target')}) AS rps,
    bool_and(Submission = Evaluation) AS fresh
    FROM (SELECT * FROM subs WHERE IsActive = 1 AND k BETWEEN 1 AND 12) f
    JOIN targets t USING (k, symbol) GROUP BY 1, 2""",
    "subs",
    "targets",
)
part(
    "teamw",
    "SELECT Team AS team, k, Symbol AS symbol, Decision AS weight FROM subs WHERE IsActive = 1 AND k BETWEEN 1 AND 12",
    "subs",
)
part("tdaily", daily_sql("teamw", "team"), "teamw", "dayk", "spell")
part(
    "groups",
    """SELECT 'month' AS level, k AS period, k, k AS first_k, 1 AS size FROM labels0 WHERE k BETWEEN 1 AND 12
    UNION ALL SELECT 'quarter', (k-1)//3 + 1, k, (k-1)//3*3 + 1, 3 FROM labels0 WHERE k BETWEEN 1 AND 12
    UNION ALL SELECT 'global', 1, k, 1, 12 FROM labels0 WHERE k BETWEEN 1 AND 12""",
    "labels0",
)


def summary_sql(zero: str) -> str:
    return (
        "SELECT a.level, CAST(a.period AS INTEGER) AS period, a.team, a.rps, b.ir, b.returns, b.risk FROM "
        "(SELECT level, period, team, AVG(rps) AS rps, bool_or(k = first_k) AS f FROM tscores JOIN groups USING (k) GROUP BY 1, 2, 3) a JOIN "
        f"(SELECT level, period, team, {ratio_sql('ret', zero)} AS ir, SUM(ret) AS returns, STDDEV_SAMP(ret) AS risk "
        "FROM tdaily JOIN groups USING (k) GROUP BY 1, 2, 3) b USING (level, period, team) WHERE a.f"
    )


def average_rank_sql(col: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {col}) + (COUNT(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0"


part("summary1", summary_sql("1.0"), "tscores", "tdaily", "groups")
part("summary0", summary_sql("NULL"), "tscores", "tdaily", "groups")
part(
    "board",
    "SELECT *, rank() OVER (PARTITION BY level, period ORDER BY overall_rank) AS position FROM ("
    "SELECT *, (rps_rank + ir_rank) / 2 AS overall_rank FROM (SELECT *, "
    f"{average_rank_sql('ROUND(rps, 6)', 'level, period')} AS rps_rank, "
    f"{average_rank_sql('-ir', 'level, period')} AS ir_rank FROM summary1))",
    "summary1",
)
part(
    "fill",
    """SELECT s.symbol, d.idx, d.day AS date, s.price FROM spell s JOIN days d
    ON d.day >= s.date AND d.day < s.next_date""",
    "spell",
    "days",
)
part(
    "raw",
    """SELECT symbol, date, sk, c AS open, CASE WHEN (sk*31 + dayofyear(date)) % 97 = 0 THEN c*0.99/2 ELSE c*1.01 END AS high,
    c*0.99 AS low, c AS close,
    CASE WHEN sk % 13 = 1 AND date BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' THEN 100.0 ELSE price * u END AS adjusted_close,
    volume FROM (SELECT *, price * a * u AS c FROM (SELECT *,
      CASE WHEN date < DATE '1998-01-05' AND sk % 7 = 3 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS a,
      CASE WHEN date < DATE '1998-01-05' AND sk % 11 = 5 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS u FROM keyed))""",
    "keyed",
)
part(
    "second",
    """SELECT symbol, date, ROUND(price * (1 + ((sk*7 + dn) % 5 - 2)/100000.0), 4) AS price
    FROM (SELECT *, date - DATE '1995-01-01' AS dn FROM prices) WHERE (sk + dn) % 17 != 0""",
    "prices",
)
part(
    "exdays",
    """SELECT exchange, date AS day FROM (
      SELECT exchange, date, COUNT(*) AS present,
      (SELECT COUNT(*) FROM syms s WHERE s.first_date <= r.date AND (CASE WHEN s.symbol LIKE '%.L' THEN 'LSE' ELSE 'US' END) = r.exchange) AS listed
      FROM (SELECT date, CASE WHEN symbol LIKE '%.L' THEN 'LSE' ELSE 'US' END AS exchange FROM raw) r GROUP BY 1, 2)
    WHERE present >= 0.2 * listed""",
    "raw",
    "syms",
)
part(
    "ratios",
    """SELECT * FROM (SELECT symbol, date, close / lag(close) OVER w AS close_ratio,
    adjusted_close / lag(adjusted_close) OVER w AS adjusted_ratio FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY date))
    WHERE close_ratio IS NOT NULL""",
    "raw",
)
part(
    "sig",
    """SELECT symbol, idx, date, lp - lag(lp, 5) OVER w AS ret_5, lp - lag(lp, 20) OVER w AS ret_20,
    lp - lag(lp, 60) OVER w AS ret_60, lp - lag(lp, 120) OVER w AS ret_120,
    lag(lp, 20) OVER w - lag(lp, 250) OVER w AS mom_250_20,
    CASE WHEN COUNT(r) OVER w20 = 20 THEN STDDEV_SAMP(r) OVER w20 END AS vol_20,
    CASE WHEN COUNT(r) OVER w60 = 60 THEN STDDEV_SAMP(r) OVER w60 END AS vol_60,
    CASE WHEN COUNT(lp) OVER w250 >= 60 THEN lp - MAX(lp) OVER w250 END AS dist_high_250
    FROM (SELECT symbol, idx, date, LN(price) AS lp, LN(price) - lag(LN(price)) OVER (PARTITION BY symbol ORDER BY idx) AS r FROM fill)
    WINDOW w AS (PARTITION BY symbol ORDER BY idx), w20 AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    w60 AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
    w250 AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)""",
    "fill",
)
FEATURES = "ret_5 ret_20 ret_60 ret_120 mom_250_20 vol_20 vol_60 vol_ratio dist_high_250".split()
part(
    "signals",
    "SELECT *, CASE WHEN vol_60 = 0 THEN NULL ELSE vol_20 / vol_60 END AS vol_ratio FROM sig",
    "sig",
)


def percent_rank_sql(source: str) -> str:
    cols = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c}) + "
        f"(COUNT(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / COUNT({c}) OVER (PARTITION BY date) END AS {c}"
        for c in FEATURES
    )
    rounds = ", ".join(f"ROUND({c}, 12) AS {c}" for c in FEATURES)
    return f"SELECT symbol, date, {cols} FROM (SELECT symbol, date, {rounds} FROM {source})"


part(
    "lastwin",
    "SELECT DISTINCT wb, we FROM win",
    "win",
)
part(
    "basefeat",
    percent_rank_sql("(SELECT * FROM signals WHERE date IN (SELECT wb FROM win UNION SELECT base_date FROM cal))"),
    "signals",
    "win",
    "cal",
)
part("dayfeat", percent_rank_sql("signals"), "signals")
part("wtargets", targets_sql("wret", "wb, we"), "wret")
part(
    "samples",
    "SELECT t.wb AS base_date, t.we AS end_date, t.symbol, "
    + ", ".join(f"f.{c}" for c in FEATURES)
    + ", Target1, Target2, Target3, Target4, Target5 FROM wtargets t LEFT JOIN basefeat f ON f.symbol = t.symbol AND f.date = t.wb WHERE t.n >= 5",
    "wtargets",
    "basefeat",
)
part(
    "naive",
    "SELECT symbol, date, "
    + ", ".join(
        f"CASE WHEN STDDEV_SAMP({c}) OVER w = 0 THEN NULL ELSE ({c} - AVG({c}) OVER w) / STDDEV_SAMP({c}) OVER w END AS {c}"
        for c in FEATURES
    )
    + " FROM signals WINDOW w AS (PARTITION BY symbol)",
    "signals",
)
part(
    "weekly",
    """SELECT base_date, (SELECT MAX(day) FROM days WHERE day <= base_date + 28) AS end_date FROM (
    SELECT day AS base_date FROM days WHERE idx % 5 = 0 UNION SELECT base_date FROM cal)
    WHERE base_date + 28 <= (SELECT MAX(day) FROM days)""",
    "days",
    "cal",
)
part(
    "wklevel",
    """SELECT d.date, s.symbol, s.price FROM (SELECT base_date AS date FROM weekly UNION SELECT end_date FROM weekly) d
    JOIN spell s ON s.date <= d.date AND s.next_date > d.date""",
    "weekly",
    "spell",
)
part(
    "wkret",
    """SELECT w.base_date, w.end_date, e.symbol, (e.price - b.price) / b.price AS ret
    FROM weekly w JOIN wklevel e ON e.date = w.end_date JOIN wklevel b ON b.date = w.base_date AND b.symbol = e.symbol""",
    "weekly",
    "wklevel",
)
part("wktargets", targets_sql("wkret", "base_date, end_date"), "wkret")
part(
    "wksamples",
    "SELECT t.base_date, t.end_date, t.symbol, "
    + ", ".join(f"f.{c}" for c in FEATURES)
    + ", Target1, Target2, Target3, Target4, Target5 FROM wktargets t LEFT JOIN naive f ON f.symbol = t.symbol AND f.date = t.base_date WHERE t.n >= 5",
    "wktargets",
    "naive",
)


def variant(suffix: str, replaced: dict[str, tuple[str, str]], targets: str, fixed: str = "") -> None:
    """Copies of the fragments ``targets`` rest on; ``replaced`` ones (body, names it needs) read
    their originals, ``fixed`` ones stay."""
    changed: dict[str, bool] = {n: True for n in replaced} | {n: False for n in fixed.split()}

    def differs(name: str) -> bool:
        if name not in changed:
            changed[name] = any([differs(n) for n in PARTS[name][0]])
        return changed[name]

    for name in targets.split():
        differs(name)
    names = [n for n, new in changed.items() if new]
    for name in names:
        needs, body = PARTS[name]
        if name in replaced:
            part(f"{name}{suffix}", replaced[name][0], name, *replaced[name][1].split())
            continue
        for other in names:
            body = re.sub(rf"\b{other}\b", f"{other}{suffix}", body)
        part(f"{name}{suffix}", body, *(f"{n}{suffix}" if n in names else n for n in needs))
