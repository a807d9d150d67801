"""Small cases of the rule and ledger operators, worked out by hand."""

import math

from pyspark.sql import functions as F

from barloom.operators import asof as A
from barloom.operators import bars as B
from barloom.operators import ledger as L
from barloom.operators import quality as K
from barloom.operators import research as R
from barloom.operators import rules as U
from barloom.operators import trading as T

FILL = "account long, symbol string, fill_id long, side string, quantity long, price double, fee double, t long"


def test_average_cost_with_a_reversal(spark):
    rows = [(1, "a", 1, "buy", 10, 100.0, 1.0, 10), (1, "a", 2, "buy", 10, 110.0, 1.0, 20), (1, "a", 3, "sell", 5, 120.0, 1.0, 30), (1, "a", 4, "sell", 25, 90.0, 1.0, 40), (1, "a", 5, "buy", 10, 80.0, 1.0, 50)]
    got = L.position_ledger(spark.createDataFrame(rows, FILL)).orderBy("fill_id").collect()
    assert [r.position for r in got] == [10, 20, 15, -10, 0]
    assert [r.average_price and round(r.average_price, 9) for r in got] == [100.0, 105.0, 105.0, 90.0, None]
    assert [r.realized and round(r.realized, 9) for r in got] == [None, None, 75.0, -225.0, 100.0]
    assert [r.closed_quantity for r in got] == [None, None, 5, 15, 10] and got[4].held == 10 and got[3].held == 30
    assert L.position_ledger(spark.createDataFrame([], FILL)).count() == 0


def test_average_cost_of_a_position_that_never_goes_flat(spark):
    """Thousands of fills that keep a tenth: the running product of what stays would vanish."""
    rows = [(1, "a", 0, "buy", 10, 100.0, 1.0, 0)]
    for k in range(1, 5001):
        rows.append((1, "a", k, "sell" if k % 2 else "buy", 9, 100.0 + (0 if k % 2 else k % 7), 1.0, k))
    got = L.position_ledger(spark.createDataFrame(rows, FILL)).orderBy("fill_id").collect()
    position, average, fees = 0, 0.0, 0.0
    for r, (_, _, _, side, q, price, fee, _) in zip(got, rows):
        if side == "buy":
            average, fees = (average * position + price * q) / (position + q), (fees + fee)
            position += q
        else:
            assert abs(r.realized - q * (price - average)) < 1e-6 and abs(r.entry_fees - fees * q / position) < 1e-9
            fees -= fees * q / position
            position -= q
        assert r.position == position and abs(r.average_price - average) < 1e-9
    trades = L.closed_trades(L.position_ledger(spark.createDataFrame(rows[:2], FILL))).first()
    assert abs(trades.fees - 1.9) < 1e-12 and abs(trades.net_pnl + 1.9) < 1e-12


def test_reports_survive_what_they_count(spark):
    schema = "symbol string, bar long, open double, high double, low double, close double, volume double"
    nan = float("nan")
    rows = [("a", 0, 1.0, 1.0, 1.0, 0.0, 0.0), ("a", 3600, nan, 1.0, 1.0, 1.0, None), ("a", 7200, 5.0, 1.0, 2.0, None, -1.0), ("a", 18_000, 5.0, 5.0, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    r = K.quality_report(df, 3600).first()
    assert (r.row_count, r.nonpositive_price_count, r.nonfinite_price_count, r.missing_price_count, r.volume_anomaly_count, r.missing_intervals, r.suspicious_jumps) == (4, 1, 1, 1, 2, 2, 1)
    assert T.performance_metrics(df.select("symbol", "bar", "close"), annualization=252).count() == 1
    assert L.drawdown_segments(df.na.fill(0.0)).count() == 1 and B.suspicious_jumps(df, 0.2).count() == 1
    assert K.quality_report(df.limit(0), 3600).count() == 0


def test_plans_that_enter_the_locked_period_are_refused(spark):
    df = spark.createDataFrame([(0, 100), (0, 60)], "a long, z long")
    got = [r.f for r in df.select(R.fold_schedule(F.col("a"), 20, 10, 4, F.col("z"), validation=5, purge=1, embargo=2).alias("f")).collect()]
    assert got[1] is None and [(f.train_end, f.validation_end, f.test_start, f.test_end) for f in got[0]][:2] == [(20, 25, 26, 36), (32, 37, 38, 48)]


def test_nearest_rows_of_odd_tables(spark):
    """Ties, strictness, null times and keys, blocks without points, empty tables, clashing names."""
    e = spark.createDataFrame([(1, "a", 100), (2, "a", 50), (3, None, 100), (4, "a", None), (5, "a", 10**9)], "id long, symbol string, t long")
    p = spark.createDataFrame([("a", 100, 1, 1.0), ("a", 100, 2, 2.0), ("a", 60, 3, 3.0), (None, 90, 4, 4.0)], "symbol string, t long, id long, v double")
    at = lambda **k: {r.id: r.found and r.found.v for r in A.nearest(e, p, tie="id", block=40, **k).collect()}
    assert at() == {1: 2.0, 2: None, 3: 4.0, 4: None, 5: 2.0}
    assert at(strict=True) == {1: 3.0, 2: None, 3: 4.0, 4: None, 5: 2.0}
    assert at(after=True) == {1: 1.0, 2: 3.0, 3: None, 4: None, 5: None}
    assert A.nearest(e, p.limit(0), block=40).where("found is not null").count() == 0 and A.nearest(e.limit(0), p).count() == 0


def test_a_tick_may_have_several_findings(spark):
    schema = "symbol string, row_no long, us long, bid double, ask double, bid_volume double, ask_volume double"
    rows = [("a", 1, 5, 1.0, 2.0, 1.0, 1.0), ("a", 2, 5, 3.0, 2.0, None, -1.0), ("a", 3, 4, None, math.inf, 1.0, 1.0), ("a", 4, 6, -1.0, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    found = sorted((r.row_no, r.code) for r in K.validate_ticks(df).collect())
    assert found == [(2, "crossed_quote"), (2, "duplicate_timestamp"), (2, "missing_volume"), (2, "volume_anomaly"), (3, "missing_price"), (3, "non_monotonic_timestamp"), (3, "nonfinite_price"), (4, "nonpositive_price")]
    r = K.tick_validation_report(df).first()
    assert (r.row_count, r.invalid_tick_count, r.non_monotonic_timestamps, r.duplicate_timestamps, r.volume_anomaly_count) == (4, 3, 2, 1, 2)


def test_repair_moves_one_side_by_one_tick_only(spark):
    cols = ", ".join(f"{s}_{n} double" for s in ("bid", "ask") for n in ("open", "high", "low", "close"))
    rows = [(1, 10.0, 10.0, 9.0, 11.0, 12.0, 13.0, 11.0, 12.0), (2, 10.0, 10.0, 9.0, 11.0, 12.0, 11.0, 11.0, 12.0), (3, 10.0, 9.0, 8.0, 11.0, 12.0, 13.0, 11.0, 12.0)]
    got = {r.id: r for r in K.repair_one_tick(spark.createDataFrame(rows, "id long, " + cols), 1.0).collect()}
    assert got[1].repaired == "bid_high" and got[1].bid_high == 11.0 and got[1].raw_values["bid_high"] == "10.0"
    assert got[2].repaired is None and got[3].repaired is None and got[3].bid_high == 9.0


def test_orders_are_sized_inside_the_bound(spark):
    df = spark.createDataFrame([(1, 10.0, 100.0, 1000.0), (2, 10.0, 5.0, 1000.0), (3, 10.0, 1000.0, 42.0)], "id long, price double, authorized double, available double")
    got = {r.id: r.quantity for r in U.size_orders(df, 1.0, 1.0, 0.0, 0.0, 1.0).collect()}
    assert got == {1: 9.0, 2: None, 3: 4.0}


def test_allocation_keeps_every_budget(spark):
    df = spark.createDataFrame([(1, i, f"f{i % 2}", "ab"[i % 2], 900.0 - 100 * i, 200.0) for i in range(4)], "decision long, strategy long, family string, symbol string, requested double, base double")
    budgets = {"strategy": 800.0, "family": 1000.0, "instrument": 900.0, "gross": 1500.0, "net": 1200.0, "incremental": 700.0, "turnover": 5000.0}
    rows = U.allocate(df, budgets, 10.0).collect()
    assert {r.status for r in rows} == {"reduced"} and sum(r.proposed for r in rows) <= 700 and all(0 < r.proposed <= 800 and r.proposed % 10 == 0 for r in rows)


def test_orders_without_a_horizon_find_their_first_touch(spark):
    bars = spark.createDataFrame([("a", i * 86_400, 10.0, 12.0, 8.0 if i != 200 else 1.0) for i in range(1, 300)], "symbol string, bar long, open double, high double, low double")
    orders = spark.createDataFrame([(1, "a", 86_400, "buy", "limit", 2.0), (2, "a", 86_400, "buy", "stop", 11.0), (3, "a", 201 * 86_400, "buy", "limit", 2.0), (4, "a", 86_400, "buy", "limit", 8.5)], "id long, symbol string, t long, side string, kind string, level double")
    got = {r.id: (r.fill_bar // 86_400, r.fill_price) for r in L.first_touch_fills(orders, bars, 86_400).collect()}
    assert got == {1: (200, 2.0), 2: (2, 11.0), 4: (2, 8.5)}


def test_drawdown_of_a_flat_and_a_falling_series(spark):
    df = spark.createDataFrame([("flat", i, 1.0) for i in range(3)] + [("b", i, v) for i, v in enumerate([10.0, 5.0, 8.0, 10.0, 9.0])], "symbol string, bar long, close double")
    got = {r.symbol: (r.max_drawdown, r.longest_seconds, r.recovery_seconds) for r in L.drawdown_segments(df).collect()}
    assert got == {"flat": (0.0, None, None), "b": (-0.5, 3, 2)}


def test_short_series_have_no_bootstrap(spark):
    df = spark.createDataFrame([("a", 1, 0.1), *[("b", i, 0.01) for i in range(1, 8)]], "symbol string, i long, ret double")
    got = {r.symbol: r for r in R.block_bootstrap_mean(df, 20, 2, 1).collect()}
    assert got["a"].mean is None and got["a"].lower is None and abs(got["b"].lower - 0.01) < 1e-12 and got["b"].p_nonpositive == 0
