import glob
import hashlib
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as fn
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import store as W
from barloom.plans import decisions, desk, governance, points, runs  # noqa: F401
from barloom.plans.queries import SQL, Q, bars
from barloom.sources import files
from barloom.sources import tables as S
from barloom.streaming import bars as streams

SF = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{float(v):.5f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from read_parquet('{f}')")
    got, want = plain(Q[name](spark, SF).toPandas()), plain(con.execute(SQL[name]).fetchdf())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["sma", "atr", "breakout_state", "volatility_ratio"])
def test_the_future_does_not_change_the_past(spark, name):
    all_bars = bars(spark, SF)
    cut = all_bars.agg({"bar": "avg"}).first()[0]
    early = plain(X.compute(all_bars.where(f"bar < {cut}"), name, 5).toPandas())
    pd.testing.assert_frame_equal(early, plain(X.compute(all_bars, name, 5).where(f"bar < {cut}").toPandas()))


def test_ema_and_rsi_by_hand(spark):
    df = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate([1, 2, 3, 5, 4])], "symbol string, bar long, close double")
    got = [r.value for r in X.ema(df, 3).orderBy("bar").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([2.0, 3.5, 3.75])
    rsi = [r.value for r in X.rsi(df, 3).orderBy("bar").collect()]
    assert rsi[3] == 100.0 and abs(rsi[4] - (100 - 100 / (1 + (4 / 3 * 2 / 3) / (1 / 3)))) < 1e-5


def test_long_recursions_equal_a_walk(spark):
    """More rows than a block of the scan holds."""
    closes = [100 + (i * 37 % 101) / 7 for i in range(9000)]
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(closes)], "symbol string, bar long, close double")
    got = [r.value for r in X.ema(df, 3).orderBy("bar").collect()]
    now, want = None, []
    for i, c in enumerate(closes):
        now = sum(closes[:3]) / 3 if i == 2 else 0.5 * c + 0.5 * now if i > 2 else None
        want.append(now)
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:], rel=1e-12)


def test_features_of_odd_bars(spark):
    """Zero, null and no rows: nothing fails, and the status says why."""
    schema = "symbol string, bar long, open double, high double, low double, close double, volume double, asset_class string"
    rows = [("a", i, 1.0, 2.0, 0.5, c, v, "equity") for i, (c, v) in enumerate([(1.0, 5.0), (0.0, None), (2.0, 1.0), (2.0, 1.0)])]
    df = spark.createDataFrame(rows, schema)
    got = [(r.value, r.status) for r in X.compute(df, "simple_return").orderBy("bar").collect()]
    assert got == [(None, "warmup"), (-1.0, "value"), (None, "undefined"), (0.0, "value")]
    assert [r.status for r in X.compute(df, "dollar_volume").orderBy("bar").collect()] == ["value", "missing_input", "value", "value"]
    assert X.compute_feature_set(df.limit(0), [("sma", 3)]).count() == 0
    with pytest.raises(ValueError):
        X.compute_feature_set(df, [("sma", 3), ("sma", 3)])


def test_stream_gives_the_batch_bars(spark):
    streamed = {(r.symbol, r.bar): (r.open, r.high, r.low, r.close, r.n) for r in Q["stream_ticks_to_bars"](spark, SF).collect()}
    assert streamed == {(r.symbol, r.bar): (r.open, r.high, r.low, r.close, r.n) for r in B.ticks_to_bars(S.ticks(spark, SF), 3600).collect()}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,askPrice,bidPrice,askVolume,bidVolume\n1,1.2,1.1,,5\n")
    row = S.read_tick_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.timestamp, row.askVolume, row.bidVolume) == ("1", None, "5")
    assert S.preserve_raw_files(spark, str(tmp_path / "a.csv")).first().byte_size == (tmp_path / "a.csv").stat().st_size
    df = spark.sql("select cast(1.50 as decimal(10,2)) as b, 'x' as a")
    S.write_canonical_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"x","b":"1.50"}'
    assert S.read_canonical_jsonl(spark, str(tmp_path / "j"), "a string, b decimal(10,2)").first().a == "x"


def test_csv_readers(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("\ufeffGMTime,Open,High,Low,Close,Volume\n2024-01-01,1.1,1.2,1.0,oops,7\n")
    two.write_text("datetime,open,high,low,close\n2024-01-01T00:00:00Z,1.1,1.2,1.0,1.15\n")
    row = files.read_quote_bar_csv(spark, str(one)).first()
    assert (str(row.bid_open), row.bid_close, str(row.bid_volume), row.ask_open) == ("1.100000000000", None, "7.00000000", None)
    assert (row.row_number, row.us, row.rejects) == (2, 1_704_067_200_000_000, ["bid_close: not_decimal"])
    row = files.read_ohlcv_csv(spark, str(two)).first()
    assert (str(row.close), row.volume) == ("1.150000000000", None)
    assert files.csv_schema_drift(spark, str(tmp_path / "*.csv")) == 1
    two.write_text("datetime,open,high,low\n2024-01-01T00:00:00Z,1.1,1.2,1.0\n")
    assert files.read_ohlcv_csv(spark, str(two)).first().rejects == ["columns_missing"]


def test_manifests_and_experiments(spark, tmp_path):
    good = {n: "x" for n in files.REQUIRED} | {"dataset_id": "d1", "canonical_schema_version": "v1", "source_artifact_hashes": ["h"]}
    for name, doc in {"d1": good, "d2": good, "d3": good | {"dataset_id": "d3", "source": " "}, "d4": good | {"dataset_id": "d4", "canonical_schema_version": "v9"}, "d5": good | {"dataset_id": "d5", "source_artifact_hashes": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "d6.json").write_text("{broken")
    got = {r.file: r.status for r in files.read_dataset_manifests(spark, str(tmp_path / "*.json"), ["v1"]).collect()}
    assert got == {"d1.json": "ok", "d2.json": "identity_mismatch", "d3.json": "missing_fields", "d4.json": "unsupported_schema", "d5.json": "missing_artifacts", "d6.json": "malformed"}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text(json.dumps({"experiment_id": "e1", "strategy_id": "s", "result": "{}", "result_hash": hashlib.sha256(b"{}").hexdigest(), "input_binding": {"dataset_id": "d1"}}))
    (tmp_path / "e" / "2.json").write_text(json.dumps({"experiment_id": "e2", "result": "{}", "result_hash": "no"}))
    experiments, results, bindings = files.read_experiment_records(spark, str(tmp_path / "e"))
    assert experiments.count() == 2 and {r.experiment_id: r.status for r in results.collect()} == {"e1": "verified", "e2": "hash_mismatch"} and bindings.first().dataset_id == "d1"


def test_audit_tables_are_appended_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, "open"), ("r2", 1, "open")], "run string, t int, state string")
    W.append_rows(df, f"{tmp_path}/audit")
    W.append_rows(spark.createDataFrame([("r1", 2, "done")], df.schema), f"{tmp_path}/audit")
    assert {r.run: r.state for r in W.latest_by_id(spark.read.parquet(f"{tmp_path}/audit"), "run", ["t"]).collect()} == {"r1": "done", "r2": "open"}


def test_the_entry_works_without_the_corpus_folders(tmp_path):
    """In a copy from which the corpus folders and the pipeline are really gone, and in one whose corpus operators lack a module."""
    root = Path(__file__).resolve().parent.parent
    for name, lacks in (("gone", True), ("broken", False)):
        copy = tmp_path / name
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        if lacks:
            shutil.rmtree(copy / "barloom" / "llm")
            shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        elif (copy / "barloom" / "llm").exists():
            (copy / "barloom" / "llm" / "common.py").write_text("import a_module_that_is_not_there\n")
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 150 and not any(n.startswith('op') and n[2].isdigit() for n in q), sorted(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("name", ["distance_to_previous_low", "distance_to_previous_high", "rolling_return", "moving_average_distance"])
def test_a_level_of_zero_gives_an_infinity_or_nan(spark, name):
    """As close / level - 1 of doubles does in SQL; null stands for warm-up and missing bars alone."""
    df = spark.createDataFrame([("a", i, 0.0, 0.0, c) for i, c in enumerate([0.0, 0.0, 0.0, 5.0])], "symbol string, bar long, low double, high double, close double")
    if name == "moving_average_distance":
        df = df.withColumn("close", df.low)
    got = [(str(r.value), r.status) for r in X.compute(df, name, 2).orderBy("bar").collect()]
    warm = 1 if name == "moving_average_distance" else 2
    last = "nan" if name == "moving_average_distance" else "inf"
    assert got == [("None", "warmup")] * warm + [("nan", "value")] * (3 - warm) + [(last, "value")]


def test_slippage_keeps_a_price_of_zero(spark):
    rows = spark.createDataFrame([(1, "buy", 0.0), (2, "sell", 0.0), (3, "sell", 2.0), (4, "buy", None)], "id long, side string, price double")
    at = lambda slip: [r[0] for r in rows.orderBy("id").select(fn.adverse_price(rows.price, rows.side, slip)).collect()]
    assert at(0.5) == [0.0, 0.0, 1.0, None] and at(1.0) == [0.0, 0.0, None, None]


def agrees(spark, name, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from read_parquet('{f}/*.parquet')")
    pd.testing.assert_frame_equal(plain(Q[name](spark, str(folder)).toPandas()), plain(con.execute(SQL[name]).fetchdf()), check_dtype=False)


@pytest.fixture
def dense(spark, tmp_path):
    """a: a tick each 10 minutes but for one hour, b: without a gap, c: three ticks without a finding."""
    sent = [("a", k + 1, k * 10) for k in range(60) if k // 6 != 5] + [("b", 1000 + k, k * 5) for k in range(200)] + [("c", 2000 + 3 * k, k * 5) for k in range(3)]
    rows = [(i, f"2024-01-03 {m // 60:02d}:{m % 60:02d}:00", t, float(i % 50 + 10), "k5") for t, i, m in sent]
    spark.createDataFrame(rows, "event_id long, at string, event_type string, value double, props string").selectExpr("event_id", "cast(at as timestamp_ntz) as ts", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(60).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    return tmp_path


def test_tick_report_of_series_without_gaps_or_findings(spark, dense):
    agrees(spark, "tick_quality_report", dense)
    got = {r.symbol: (r.missing_intervals, r.unexpected_gaps, r.invalid_tick_count) for r in Q["tick_quality_report"](spark, str(dense)).collect()}
    assert got["a"][0] > 0 and got["b"][:2] == (None, None) and got["c"] == (None, None, None)


def test_preflight_of_series_without_gaps_or_findings(spark, dense):
    agrees(spark, "admission_preflight", dense)
    assert Q["admission_preflight"](spark, str(dense)).where("blockers like '%QUALITY_FIELD_INVALID_UNEXPECTED_GAPS%'").count() > 0


def test_equity_of_neighbouring_accounts_over_batches(spark):
    """Accounts of one group, far and negative ones and ones that pause a batch keep their own equity and peak."""
    accounts = [*range(1020, 1030), -1, 5_000_000_000]
    rows = [(a, 10 * k + a % 3, 100 * k + a % 7, float((a * 31 + k * 17) % 23 - 11)) for a in accounts for k in range(12) if a % 4 or k < 3 or k > 8]
    df = spark.createDataFrame(rows, "account long, t long, seq long, delta double")
    stream = streams.batched(df, (F.col("t") / 40).cast("int"), 3)
    got = {(r.account, r.t): (r.equity, r.high_water) for r in streams.drained(streams.stream_last_equity(stream), spark).collect()}
    want = {}
    for a in accounts:
        equity, peak = 0.0, float("-inf")
        for _, t, _, delta in sorted(r for r in rows if r[0] == a):
            equity += delta
            peak = max(peak, equity)
            want[a, t] = equity, peak
    assert got == want


def test_many_accounts_are_few_groups_of_the_state(spark):
    df = spark.range(2048).selectExpr("id as account", "id as t", "id as seq", "1D as delta")
    stream = streams.stream_last_equity(streams.batched(df, F.lit(0), 1))
    out = streams.shared_path(spark, "state")
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2 and spark.read.parquet(f"{out}/data").count() == 2048
