"""Loaders, manifest, payloads, splice and sinks on small files."""

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest

from crossrank.operators import calendar as cal
from crossrank.sinks import tables as sink
from crossrank.sources import official, runs, snapshots, splice, vendor


def frame(spark, symbol, dates, prices):
    rows = [(symbol, dt.date.fromisoformat(str(d)[:10]), float(p)) for d, p in zip(dates, prices)]
    return spark.createDataFrame(rows, "symbol string, date date, price double")


def test_manifest_picks_the_latest_snapshot(spark, tmp_path):
    content = b"hello"
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "assets_2026-09-28.parquet").write_bytes(content)
    files = [{"path": "data/assets_2026-09-28.parquet", "sha256": hashlib.sha256(content).hexdigest(), "bytes": 5},
             {"path": "data/gone_2026-09-28.parquet", "sha256": "00", "bytes": 1}]
    document = {"snapshots": [{"name": "official", "downloaded": "2026-01-01", "files": []}, {"name": "official", "downloaded": "2026-09-28", "files": files}]}
    (tmp_path / "manifest.json").write_text(json.dumps(document, indent=2))
    manifest = snapshots.read_manifest(spark, str(tmp_path / "manifest.json"))
    entry = snapshots.snapshot(manifest, "official")
    assert entry.first()["downloaded"] == "2026-09-28"
    assert snapshots.snapshot(manifest, "official", "2026-01-01").first()["downloaded"] == "2026-01-01"
    with pytest.raises(Exception, match="no snapshot other"):
        snapshots.snapshot(manifest, "other").collect()
    listed = snapshots.snapshot_files(entry)
    assert {r["stored"] for r in listed.collect()} == {"assets", "gone"}
    bad = snapshots.checksum_audit(spark, listed, str(tmp_path)).collect()
    assert [(r["stored"], r["actual"]) for r in bad] == [("gone", None)]


def test_manifest_rows_and_streamed_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "_PIECE", 7)  # many pieces a file
    folder = tmp_path / "root" / "a b%20c"
    folder.mkdir(parents=True)
    contents = {"one_2024.csv": b"x" * 100, "two_2024.csv": b"", "three_2024.csv": b"0123456"}
    lines = [{"name": "official", "downloaded": "2024-01-01"}, {"name": "other", "downloaded": "2027-01-01"}]
    for name, content in contents.items():
        (folder / name).write_bytes(content)
        digest = hashlib.sha256(content).hexdigest() if name != "three_2024.csv" else "0" * 64
        lines.append({"name": "official", "downloaded": "2026-01-01", "path": f"a b%20c/{name}", "sha256": digest, "bytes": len(content)})
    lines.append({"name": "official", "downloaded": "2026-01-01", "path": "gone_1.csv", "sha256": "1", "bytes": 1})
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, lines)))
    rows = snapshots.read_manifest_rows(spark, str(tmp_path / "rows.json"))
    files = snapshots.listed_files(rows, "official")
    assert {r["stored"] for r in files.collect()} == {"one", "two", "three", "gone"}
    assert snapshots.listed_files(rows, "official", "2024-01-01").count() == 0
    with pytest.raises(Exception, match="no snapshot absent"):
        snapshots.listed_files(rows, "absent").collect()
    bad = {r["path"]: r["actual"] for r in snapshots.checksum_audit(spark, files, str(tmp_path / "root")).collect()}
    assert bad == {"gone_1.csv": None, "a b%20c/three_2024.csv": hashlib.sha256(b"0123456").hexdigest()}


def test_git_blob_sha(spark):
    df = spark.createDataFrame([(bytearray(b"hello\n"),)], "content binary")
    assert df.selectExpr(f"{snapshots.git_blob_sha()} AS s").first()["s"] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_payloads_and_report(spark, tmp_path):
    def bar(day, value):
        return {"date": f"2019-08-{day:02d}", "open": 7, "high": 9, "low": 6, "close": 8, "adjusted_close": value, "volume": 3}

    payloads = {
        "VOD.L": [bar(5, 7.5), {"warning": "only a year"}, bar(6, 7.75)],
        "TWICE": [bar(5, 1.0), bar(5, 1.0)],
        "BACK": [bar(7, 1.0), bar(5, 1.0)],
        "ZERO": [bar(5, 1.0), bar(6, 0.0)],
        "EMPTY": [],
        "MESSAGE": {"message": "try again"},
    }
    for name, payload in payloads.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    entries = vendor.read_payloads(spark, str(tmp_path))
    rows, warnings = vendor.payload_rows(entries), vendor.payload_warnings(entries)
    stored = rows.where("symbol = 'VOD.L'").orderBy("date").collect()
    assert [(r["ticker"], r["adjusted_close"]) for r in stored] == [("VOD.LSE", 7.5), ("VOD.LSE", 7.75)]
    notes = {r["symbol"]: r["warning"] for r in warnings.collect()}
    assert notes.pop("MESSAGE").startswith("unexpected payload: ") and notes == {"VOD.L": "only a year"}
    wanted = spark.createDataFrame([(name,) for name in payloads], "symbol string")
    report = vendor.download_report(wanted, rows, warnings)
    problems = {r["symbol"]: list(r["problems"]) for r in report.collect()}
    assert problems == {
        "VOD.L": [], "TWICE": ["duplicated dates"], "BACK": ["dates not sorted"],
        "ZERO": ["non-positive adjusted_close"], "EMPTY": ["no rows"], "MESSAGE": ["no rows"],
    }
    vendor.require_clean(report, strict=False)
    with pytest.raises(ValueError, match="load rejected"):
        vendor.require_clean(report, strict=True)


def test_tickers(spark):
    names = {"QQQ": ("QQQ.US", "QQQ"), "VOD.L": ("VOD.LSE", "VOD.L"), "RE": ("EG.US", "EG")}
    df = spark.createDataFrame([(n,) for n in names], "symbol string")
    got = df.selectExpr("symbol", f"{vendor.ticker()} AS a", f"{vendor.ticker('symbol', vendor.SECOND)} AS b").collect()
    assert {r["symbol"]: (r["a"], r["b"]) for r in got} == names


def test_symbol_groups(spark, tmp_path):
    (tmp_path / "list.csv").write_text("symbol,kind\nAAA,stock\nBBB,etf\n")
    core = spark.createDataFrame([("IVV",)], "symbol string")
    after = spark.createDataFrame([("DRE", "PLD"), ("WRK", None)], "symbol string, successor string")
    path = str(tmp_path / "list.csv")
    assert vendor.group_symbols(spark, "extended", core, path, after).count() == 2
    assert [r[0] for r in vendor.group_symbols(spark, "successors", core, path, after).collect()] == ["PLD"]
    with pytest.raises(ValueError):
        vendor.group_symbols(spark, "other", core, path, after)


def test_leaderboard_text(spark):
    rows = [("32cdcc24\u00a0Some Team", "3", "0.16", "0.5", "2.0", "1.0", "1.5", "1"), ("aaaa", "4", "0.1", "1", "1", "2", "1.5", "1")]
    df = spark.createDataFrame(rows, "team string, period string, rps string, ir string, rps_rank string, ir_rank string, overall_rank string, position string")
    out = official.load_leaderboard(df, "month").orderBy("period").collect()
    assert (out[0]["team"], out[0]["team_name"], out[0]["period"]) == ("32cdcc24", "Some Team", 3)
    assert out[1]["team_name"] == ""
    with pytest.raises(ValueError):
        official.load_leaderboard(df, "year")


def test_splice_of_a_small_panel(spark):
    """P overlaps its given prices, Q ends before them, R has no history, S is given nowhere."""
    before, given_days = pd.bdate_range("2024-03-04", "2024-03-08"), pd.bdate_range("2024-03-11", "2024-03-15")
    history = (
        frame(spark, "P", before.append(given_days), 8 * 1.02 ** np.arange(10))
        .union(frame(spark, "Q", ["2024-03-05", "2024-03-07"], [12, 16]))
        .union(frame(spark, "S", ["2024-03-08", "2024-03-11", "2024-03-15", "2024-03-16", "2024-03-22"], [3] * 5))
    )
    given = frame(spark, "P", given_days, [30, 33, 31, 30, 36]).union(frame(spark, "Q", given_days, [20] * 5))
    given = given.union(frame(spark, "R", given_days[2:], [5, 6, 7]))
    out = splice.splice(history, given).orderBy("symbol", "date").toPandas()
    prices = {s: g["price"].to_numpy() for s, g in out.groupby("symbol")}
    assert prices["P"][5:].tolist() == [30, 33, 31, 30, 36] and prices["R"].tolist() == [5, 6, 7]
    np.testing.assert_allclose(prices["P"][1:6] / prices["P"][:5], 1.02)
    np.testing.assert_allclose(prices["Q"], [15, 20, 20, 20, 20, 20, 20])
    assert [str(d) for d in out.loc[out["symbol"] == "S", "date"]] == ["2024-03-08", "2024-03-11", "2024-03-15"]


def test_runs(spark):
    df = spark.createDataFrame([("gbm", "2026-01-01_a"), ("gbm", "2026-02-01_b-dirty"), ("gbm", "2026-01-15_c")], "experiment string, run string")
    assert runs.latest_runs(df).first()["run"] == "2026-01-15_c"
    a = spark.createDataFrame([("m", "period1"), ("m", "trial")], "model string, evaluation string")
    b = spark.createDataFrame([("n", "period2", 1)], "model string, phase string, k int")
    assert sorted(r["phase"] for r in runs.harmonised([a, b]).collect()) == ["period1", "period2"]


def test_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n001,x\n002,\n001,x\n")
    stored = sink.store_as_text(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert dict(stored.dtypes) == {"a": "string", "b": "string"} and stored.count() == 3
    assert sink.run_id("2026-11-09", "17793ac9999", True) == "2026-11-09_17793ac-dirty"
    sink.write_run(stored, str(tmp_path / "runs"), "r1", "periods")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sink.write_run(stored, str(tmp_path / "runs"), "r1", "periods")
    sink.write_tables({"t": stored}, str(tmp_path / "csv"))
    sink.write_tables({"t": stored}, str(tmp_path / "json"), "json")
    assert spark.read.csv(str(tmp_path / "csv" / "t"), header=True).count() == 3


def test_wide_export_substitutes_a_series(spark):
    prices = frame(spark, "VXX", ["2022-01-03", "2022-01-04"], [1, 2]).union(frame(spark, "VIXY", ["2022-01-03", "2022-01-05"], [7, 9]))
    days = cal.trading_days(prices)
    members = spark.createDataFrame([("VXX",)], "symbol string")
    long = sink.export_long(prices, members, days, {"VXX": "VIXY"}, start="2022-01-01")
    wide = sink.export_wide(long, ["VXX"]).orderBy("date").collect()
    assert [r["VXX"] for r in wide] == [7.0, 7.0, 9.0]
    with pytest.raises(ValueError, match="not in history"):
        sink.export_long(prices, members, days, {"VXX": "NOPE"})
