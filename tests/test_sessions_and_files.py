import gzip
import hashlib
import random
import time
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom.operators import asof as A
from barloom.operators import bars as B
from barloom.operators import calendars as C
from barloom.operators import exact as E
from barloom.operators import gates as G
from barloom.operators import governance as L
from barloom.operators import rules as U
from barloom.operators import store as W
from barloom.operators import trading as T
from barloom.sources import files
from barloom.sources import tables as S
from barloom.sources.shared import settled

HOUR = 3600


def at(*when):
    return int(datetime(*when, tzinfo=UTC).timestamp())


def open_at(spark, table, *times):
    rows = spark.createDataFrame([(i, at(*t)) for i, t in enumerate(times)], "id int, t long")
    return [r.open for r in C.with_session(rows, "t", table).select("id", F.col("found").isNotNull().alias("open")).orderBy("id").collect()]


def test_weeks_move_with_the_clock(spark):
    week = C.sessions(spark, C.NEW_YORK_FOREX, at(2024, 1, 1), at(2025, 1, 1))
    assert open_at(spark, week, (2024, 1, 5, 21, 45), (2024, 1, 5, 22), (2024, 1, 7, 21, 45), (2024, 1, 7, 22)) == [True, False, False, True]
    assert open_at(spark, week, (2024, 3, 15, 20, 45), (2024, 3, 15, 21), (2024, 3, 17, 20, 45), (2024, 3, 17, 21)) == [True, False, False, True]
    assert open_at(spark, week, (2024, 3, 10, 21), (2024, 11, 3, 21, 45), (2024, 11, 3, 22)) == [True, False, True]
    utc = C.sessions(spark, C.UTC_FOREX, at(2026, 1, 1), at(2026, 2, 1))
    assert open_at(spark, utc, (2026, 1, 10, 12), (2026, 1, 11, 21, 59), (2026, 1, 11, 22), (2026, 1, 9, 21, 59), (2026, 1, 9, 22)) == [False, False, True, True, False]


def grid(spark, table, calendar, a, b, width):
    ranges = spark.createDataFrame([("x", at(*a), at(*b))], "symbol string, a long, b long")
    return sorted(r.bar for r in C.expected(ranges, table, calendar, width).collect())


def test_grids(spark):
    week = C.sessions(spark, C.NEW_YORK_FOREX, at(2024, 1, 1), at(2024, 4, 1))
    assert grid(spark, week, C.NEW_YORK_FOREX, (2024, 1, 5, 21, 45), (2024, 1, 7, 22, 15), 900) == [at(2024, 1, 5, 21, 45), at(2024, 1, 7, 22)]
    assert grid(spark, week, C.NEW_YORK_FOREX, (2024, 3, 15, 20, 45), (2024, 3, 17, 21, 15), 900) == [at(2024, 3, 15, 20, 45), at(2024, 3, 17, 21)]
    holidays = spark.createDataFrame([(date(2024, 6, 6),)], "day date")
    early = spark.createDataFrame([(date(2024, 6, 7), 13 * HOUR)], "day date, closes int")
    days = C.sessions(spark, C.US_EQUITY, at(2024, 6, 1), at(2024, 7, 1), holidays, early)
    assert open_at(spark, days, (2024, 6, 5, 14, 30), (2024, 6, 6, 14, 30), (2024, 6, 7, 16, 59), (2024, 6, 7, 17), (2024, 6, 5, 13, 29)) == [True, False, True, False, False]
    assert grid(spark, days, C.US_EQUITY, (2024, 6, 5, 13, 30), (2024, 6, 7, 13, 30), 86_400) == [at(2024, 6, 5, 13, 30)]
    assert grid(spark, days, C.US_EQUITY, (2024, 6, 7, 14), (2024, 6, 10, 14), HOUR) == [at(2024, 6, 7, 14, 30), at(2024, 6, 7, 15, 30), at(2024, 6, 7, 16, 30), at(2024, 6, 10, 13, 30)]
    assert C.calendar_for("forex").name == C.UTC_FOREX.name and C.calendar_for("etf").name == C.US_EQUITY.name


def test_gap_counts_over_nights_and_holidays(spark):
    days = C.sessions(spark, C.US_EQUITY, at(2024, 6, 1), at(2024, 7, 1), spark.createDataFrame([(date(2024, 6, 6),)], "day date"))
    bars = spark.createDataFrame([("x", at(2024, 6, 5, 18, 30)), ("x", at(2024, 6, 5, 19, 30)), ("x", at(2024, 6, 7, 14, 30)), ("x", at(2024, 6, 10, 13, 30))], "symbol string, bar long")
    assert [r.absent for r in C.gap_counts(bars, days, HOUR).orderBy("bar").collect()] == [0, 1, 5]


def test_files_with_different_headers_are_read_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿GMTime,Open,High,Low,Close,Volume\r\n2024-03-10T02:30:00,1,2,0.5,1,7\r\n\r\n2024-11-03T01:30:00,1,2,0.5,1,\r\n2024-06-01T12:00:00+02:00,\"1\",2,0.5,inf,9,8\r\n")
    (tmp_path / "b.csv").write_text("bidclose,ASK_CLOSE,bid_open,bid_high,bid_low,timestamp\n1.5,1.6,1,2,0.5,2024-06-01T12:00:00\n")
    (tmp_path / "c.csv").write_text("open,time\n1,2024-06-01\n")
    (tmp_path / "d.csv").write_text("open,high,low,close\n1,1,1,1\n")
    got = {(r.artifact[-5:], r.row_number): r for r in files.read_quote_bar_csv(spark, str(tmp_path / "*.csv"), zone="America/New_York", width=HOUR, stamps_end=True).collect()}
    assert got["a.csv", 2].rejects == ["timestamp_nonexistent"] and got["a.csv", 3].rejects == ["timestamp_ambiguous"] and got["a.csv", 3].bid_volume is None
    assert got["a.csv", 4].rejects == ["extra_fields", "bid_close: not_finite"] and got["a.csv", 4].bid_open == Decimal(1)
    assert got["b.csv", 2].us == at(2024, 6, 1, 15) * 1_000_000 and (got["b.csv", 2].bid_close, got["b.csv", 2].ask_close) == (Decimal("1.5"), Decimal("1.6"))
    assert got["c.csv", 2].rejects == ["side_incomplete"] and got["d.csv", 2].rejects == ["timestamp_missing"]
    ask = files.read_quote_bar_csv(spark, str(tmp_path / "a.csv"), side="ask").orderBy("row_number").first()
    assert (ask.ask_open, ask.bid_open, ask.bid_volume, ask.ask_volume) == (Decimal(1), None, None, None)


def test_rows_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",".join(files.TICK_HEADER) + "\n" + "".join(f"{i},1.1,1.0,,{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.read_tick_rows(spark, str(tmp_path / "t.csv"))
        assert rows.where("row_number <> us div 1000 + 2 or size(rejects) > 0").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_raw_files_against_their_metadata(spark, tmp_path):
    for n, body in (("a", b"x" * 10), ("b", b"y"), ("c", b"z")):
        (tmp_path / n).write_bytes(body)
    told = [("a", hashlib.sha256(b"x" * 10).hexdigest().upper(), 10), ("b", "0", 1), ("c", "0", 2), ("d", "0", 1)]
    got = files.verify_raw(S.preserve_raw_files(spark, str(tmp_path / "[abc]")), spark.createDataFrame(told, "filename string, sha256 string, byte_size long"))
    assert {r.filename: r.status for r in got.collect()} == {"a": "ok", "b": "hash_differs", "c": "size_differs", "d": "file_missing"}


@pytest.mark.parametrize("split", ["20k", "128m"])
def test_files_are_hashed_as_streams(spark, tmp_path, split):
    rng = random.Random(2)
    bodies = {"empty": b"", "mark": b"\xef\xbb\xbf", "marked": b"\xef\xbb\xbfa,b\n1,2\n", "open": b"\xef\xbb\xbfa\nb", "ends": b"\n\n\n", "dos": b"a\r\nb\r\n\r", "bytes": rng.randbytes(5000), "long": b"".join(b"%d,%d\n" % (i, i * i) for i in range(30_000))}
    bodies["packed.gz"] = gzip.compress(b"a\nb\n")
    for n, body in bodies.items():
        (tmp_path / n).write_bytes(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.artifact.rsplit("/", 1)[1]: (r.sha256, r.byte_size) for r in S.preserve_raw_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n: (hashlib.sha256(body).hexdigest(), len(body)) for n, body in bodies.items() if body}  # Spark lists no empty files


def cycles_of(edges):
    reach = {a: {y for x, y in edges if x == a} for a, _ in edges}
    while True:
        more = {a: r | {z for y in r for z in reach.get(y, ())} for a, r in reach.items()}
        if more == reach:
            break
        reach = more
    return {a: max(b for b in r if a in reach.get(b, ())) for a, r in reach.items() if a in r}


@pytest.mark.parametrize("n", [25, 60])
def test_cycles_equal_reachability(spark, n):
    rng = random.Random(n)
    edges = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(n)] + [("x", "x"), ("x", "n00"), ("y0", "y1")]
    got = {r.node: r.cycle for r in L.lineage_cycles(spark.createDataFrame(edges, "source string, target string").repartition(3)).collect()}
    assert got == cycles_of(set(edges))
    assert L.lineage_cycles(spark.createDataFrame([], "source string, target string")).count() == 0


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    """A ring of 10,000 nodes in order, with a path into it."""
    made = []
    monkeypatch.setattr(L, "settled", lambda df, name="table": made.append(name) or settled(df, name))
    n = 10_000
    edges = spark.range(n).selectExpr("format_string('r%06d', id) as source", f"format_string('r%06d', (id + 1) % {n}) as target").union(spark.range(30).selectExpr("concat('p', id) as source", "if(id = 29, 'r000000', concat('p', id + 1)) as target"))
    got = L.lineage_cycles(edges)
    assert got.count() == n and got.select("cycle").distinct().collect() == [(f"r{n - 1:06}",)]
    assert made.count("colour") < 40


def test_order_events_keeps_wide_rows(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(60_000).select(F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"))
        out = W.order_events(rows, ["k"]).select("k", "event_no").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(r.event_no for r in out) == list(range(60_000)) and [r.event_no for r in sorted(out, key=lambda r: r.k)] == list(range(60_000))


@pytest.mark.parametrize("edge", [65_535, 65_536, 70_000, 1 << 33])
def test_steps_back_in_time_are_found_at_block_edges(spark, edge):
    rows = [("d", "x", 10, edge - 1, 1.0, 1.0, False), ("d", "x", 9, edge, 1.0, 1.0, False), ("d", "x", 11, edge * 3, 1.0, 1.0, False)]
    bars = spark.createDataFrame(rows, "dataset string, symbol string, bar long, row_no long, bid double, ask double, equity_unresolved boolean")
    got = G.qualify_dataset(bars, spark.createDataFrame([], "dataset string")).first()
    assert got.reasons == "timestamps are not strictly monotonic"


def test_quantiles_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", v) for v in (3.0, -inf, 1.0, inf, nan, 0.0, -2.0, 1e-300, -1e300)]
    df = spark.createDataFrame(rows, "g string, v double")
    ordered = [-inf, -1e300, -2.0, 0.0, 1e-300, 1.0, 3.0, inf, nan]
    for k in range(1, 10):
        got = T.nearest_rank_quantile(df, "g", "v", k / 9 - 0.01).first().quantile
        assert got == ordered[k - 1] or got != got and k == 9
    ticks = spark.createDataFrame([("s", 1.0, 2.0), ("s", 1.0, inf), ("s", 1.0, nan)], "symbol string, bid double, ask double")
    assert B.spread_distribution(ticks).first().low == 1.0


def test_required_features_equal_a_search_of_all_pairs(spark):
    draw = random.Random(2)
    feats = [("s", "f", 1, draw.randint(0, 60), draw.randint(0, 90), float(i), draw.choice(["value", "warmup"])) for i in range(150)]
    feats = list({(f[3], f[4]): f for f in feats}.values()) + [("s", "f", 1, None, 5, 0.0, "value"), ("s", "g", 1, 3, 4, 1.0, "value"), ("s", "f", 2, 3, 4, 1.0, "value")]
    events = [(i, "s" if i % 5 else "t", draw.randint(-5, 70), draw.randint(0, 100)) for i in range(200)]
    got = A.required_features(spark.createDataFrame(events, "id int, symbol string, bar long, event_time long"), spark.createDataFrame(feats, "symbol string, feature string, version int, observed long, available long, value double, status string"), [("f", 1), ("f", 2)], block=16)
    told = {(r.id, r.version): (r.observed, r.value) for r in got.collect()}
    assert len(told) == 400
    for i, symbol, bar, now in events:
        for version in (1, 2):
            seen = [f for f in feats if f[0] == symbol and f[1] == "f" and f[2] == version and f[3] is not None and f[3] <= bar and f[4] <= now]
            best = max(seen, key=lambda f: (f[3], f[4]), default=None)
            assert told[i, version] == ((best[3], best[5] if best[6] == "value" else None) if best else (None, None))


def test_touches_within_one_day(spark):
    n = 30_000
    ticks = spark.range(n).select(F.lit("x").alias("symbol"), (F.col("id") * 2_500_000).alias("us"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10 + 50).alias("bid")).withColumn("ask", F.col("bid") + 1)
    orders = spark.range(n).select("id", F.lit("x").alias("symbol"), (F.col("id") * 2_500_000).alias("t"), F.lit("buy").alias("side"), F.lit("limit").alias("kind"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10 + 51).alias("level"), F.lit(None).cast("long").alias("expires"))
    begin = time.time()
    got = {r.id: r.fill_us for r in A.quote_fills(orders, ticks, 0.0).collect()}
    assert time.time() - begin < 60
    prices = [r.ask for r in ticks.orderBy("us").select("ask").collect()]
    for r in orders.where("id % 1500 = 7").collect():
        first = next((k for k in range(r.id + 1, n) if prices[k] <= r.level), None)
        assert got.get(r.id) == (None if first is None else first * 2_500_000)


def test_exact_positions(spark):
    rows = [(1, 1, "s", "buy", "3", "10", "0.30", 1), (2, 1, "s", "buy", "4", "11", "0.40", 2), (3, 1, "s", "sell", "9", "12", "0.90", 3), (4, 1, "s", "buy", "2", "9", "0.10", 4), (5, 1, "s", "buy", "0", "9", "0", 5)]
    fills = spark.createDataFrame([(i, a, s, side, Decimal(q), Decimal(p), Decimal(f), t) for i, a, s, side, q, p, f, t in rows], "fill_id long, account long, symbol string, side string, quantity decimal(16,6), price decimal(18,8), fee decimal(18,8), t long")
    got = {r.fill_id: r for r in E.exact_positions(E.exact_fills(fills)).collect()}
    average = Decimal("10.571428571429")
    assert got[2].average_price == average and got[2].closed_quantity is None
    assert (got[3].closed_quantity, got[3].entry_price, got[3].average_price) == (7, average, 12) and got[3].gross == 7 * (12 - average)
    assert got[3].fees == Decimal("0.70") + Decimal("0.70") and got[3].net == got[3].gross - got[3].fees
    assert (got[4].closed_quantity, got[4].entry_price, got[4].average_price, got[4].gross, got[4].fees) == (2, 12, None, 6, Decimal("0.20") + Decimal("0.10"))
    assert got[5].average_price is None or got[5].average_price == 0


def test_allocation_by_class_counts_reservations(spark):
    asked = spark.createDataFrame([(1, "a", "f", "eur", "forex", 300.0), (1, "b", "f", "usd", "forex", 300.0), (1, "c", "g", "spy", "equity", 100.0)], "decision int, strategy string, family string, symbol string, asset_class string, requested double")
    schema = "decision int, symbol string, asset_class string, value double"
    held, kept = spark.createDataFrame([(1, "jpy", "forex", -200.0)], schema), spark.createDataFrame([(1, "jpy", "forex", 100.0), (1, "spy", "equity", 950.0)], schema)
    big = dict.fromkeys(("strategy", "family", "instrument", "gross", "net", "incremental", "turnover"), 10_000.0) | {"instrument": 1000.0}
    shares, targets = U.allocate_portfolio(asked, held, kept, big, {"forex": 600.0, "equity": 5000.0}, 10.0)
    got = {r.symbol: (r.proposed, r.reasons, r.status) for r in shares.collect()}
    assert got["eur"] == (150.0, ["ASSET_CLASS_BUDGET_REDUCED"], "reduced") and got["usd"][0] == 150.0
    assert got["spy"] == (50.0, ["INSTRUMENT_BUDGET_REDUCED"], "reduced")
    assert {r.symbol: (r.target, r.new_risk) for r in targets.collect()} == {"eur": (150.0, 150.0), "usd": (150.0, 150.0), "spy": (1000.0, 50.0)}


def test_touches_equal_a_walk_and_meet_no_bar_one_by_one(spark):
    """Hits in the order's own block, far behind it and at times with several bars; null and infinite levels, missing and NaN prices."""
    rng = random.Random(7)
    bars = [("ab"[k % 2], k * 7 // 2, rng.choice([None, float(rng.randrange(40, 60))]), float(rng.randrange(30, 50)) if k % 19 else None, float(rng.randrange(50, 70)) if k % 23 else float("nan")) for k in range(400)] + [("a", 5000, 1.0, 0.5, 99.0)]
    orders = [(k, "abc"[k % 3], k * 4, k % 5 < 2, rng.choice([None, float("inf"), float("nan"), 0.5, 31.0, 68.0, 99.0, float(rng.randrange(28, 72))])) for k in range(400)]
    o = spark.createDataFrame(orders, "id long, symbol string, t long, falls boolean, level double")
    b = spark.createDataFrame(bars, "symbol string, bar long, open double, low double, high double")
    hit = A.touches(o, b, block=50)
    assert "Join" not in hit._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.fill_bar, r.touched) for r in hit.collect()}
    number = lambda x, none: none if x is None else float("inf") if x != x else x
    far = float("inf")
    want = {}
    for k, symbol, t, falls, level in orders:
        falls, level = falls or level is None, number(level, far)
        met = [(x[1], number(x[3], far) if falls else number(x[4], -far)) for x in bars if x[0] == symbol and x[1] > t]
        met = [(at, v) for at, v in met if (v <= level if falls else v >= level)]
        if met:
            first = min(at for at, _ in met)
            want[k] = first, (min if falls else max)(v for at, v in met if at == first)
    assert got == want


def test_late_features_meet_no_run_of_places(spark):
    """Restated, late, never known and null times; the plan has no row of each level of a pyramid."""
    rng = random.Random(3)
    seen = [("ab"[k % 2], "f", 1, o, o + rng.choice([1, 5, 400, 90_000]), float(k), "value" if k % 6 else "warmup") for k, o in enumerate(rng.choices(range(0, 200_000, 700), k=300))] + [("a", "f", 1, None, 5, 1.0, "value"), ("a", "f", 1, 7, None, 1.0, "value")]
    asked = [(k, "abc"[k % 3], k * 900, k * 900 + rng.choice([0, 50, 500])) for k in range(200)] + [(900, "a", None, 5), (901, "b", 190_000, None)]
    f = spark.createDataFrame(list({x[:5]: x for x in seen}.values()), "symbol string, feature string, version int, observed long, available long, value double, status string")
    e = spark.createDataFrame(asked, "id long, symbol string, bar long, event_time long")
    out = A.required_features(e, f, [("f", 1)])
    assert "shiftright" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.observed, r.value) for r in out.collect()}
    for k, symbol, bar, at in asked:
        known = [r for r in f.collect()] if k == 0 else known
        ok = [r for r in known if None not in (bar, at, r.observed, r.available) and r.symbol == symbol and r.observed <= bar and r.available <= at]
        best = max(ok, key=lambda r: (r.observed, r.available), default=None)
        assert got[k] == ((best.observed, best.value if best.status == "value" else None) if best else (None, None)), k
