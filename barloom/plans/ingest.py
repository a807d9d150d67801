"""Registered queries of file readers: the hourly bars and the ticks are written as CSV files with different headers, bad fields among them, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import files
from barloom.sources import tables as S
from barloom.sources.shared import shared_path

from .queries import HOUR, TICKS, bars, bars_sql, query

#: Headers by the bar's hour: two-sided in another order, bare bid names, and other spellings. Stamps are the ends of bars in New York.
SHAPES = [
    {"ask_volume": "Ask Vol", "timestamp": "GMTime", **{f"{s}_{n}": f"{s.title()}{n.title()}" for s in ("ask", "bid") for n in files.OHLC}, "bid_volume": "bid_volume"},
    {"timestamp": "time", **{f"bid_{n}": n.title() for n in files.OHLC}, "bid_volume": "Volume"},
    {"bid_volume": "BIDVOL", **{f"bid_{n}": f"bid {n}" for n in files.OHLC}, "timestamp": "datetime", "note": "note"},
]


def written_bars(s: SparkSession, d: str) -> str:
    h, out = F.col("bar") / HOUR, shared_path(s, "csv")
    clock = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.col("bar") + HOUR), "America/New_York"), "yyyy-MM-dd'T'HH:mm:ss")
    rows = bars(s, d).select("bar", clock.alias("timestamp"), *[F.format_string("%.6f", F.col(n)).alias(f"bid_{n}") for n in files.OHLC], *[F.format_string("%.6f", F.col(f"ask_{n}")).alias(f"ask_{n}") for n in files.OHLC], F.col("volume").cast("string").alias("bid_volume"), F.col("ask_volume").cast("string").alias("ask_volume"), F.lit("a, b").alias("note"))
    rows = rows.withColumns({"bid_close": F.when(h % 13 == 0, "1.2.3").when(h % 17 == 0, "NaN").otherwise(F.col("bid_close")), "bid_volume": F.when(h % 11 == 0, " ").otherwise(F.col("bid_volume")), "timestamp": F.when(h % 19 == 0, "soon").otherwise(F.col("timestamp"))})
    for k, shape in enumerate(SHAPES):
        rows.where(h % 3 == k).select(*[F.col(c).alias(n) for c, n in shape.items()]).write.mode("append").option("header", True).csv(out)
    return out


_two = "bar // 3600 % 3 = 0"
query(
    "read_quote_bar_csv",
    f"""with {bars_sql(HOUR)}, x as (select *, bar // 3600 as h, bar // 3600 % 3 = 0 as two from bars)
    select case when h % 19 <> 0 then bar * 1000000 end as us, printf('%.6f', open) as bid_open, printf('%.6f', high) as bid_high, printf('%.6f', low) as bid_low, case when h % 13 <> 0 and h % 17 <> 0 then printf('%.6f', close) end as bid_close,
    {", ".join(f"case when two then printf('%.6f', ask_{n}) end as ask_{n}" for n in files.OHLC)}, case when h % 11 <> 0 then volume::varchar end as bid_volume, case when two then ask_volume::varchar end as ask_volume,
    concat_ws(',', case when h % 13 = 0 then 'bid_close: not_decimal' when h % 17 = 0 then 'bid_close: not_finite' end, case when h % 19 = 0 and h % 13 <> 0 and h % 17 <> 0 then 'timestamp_not_iso' end) as rejects from x""",
)(
    lambda s, d: (lambda x: x.select("us", *[F.col(f"{a}_{n}").cast("decimal(28,6)").cast("string").alias(f"{a}_{n}") for a in ("bid", "ask") for n in files.OHLC], *[F.col(f"{a}_volume").cast("decimal(28,0)").cast("string").alias(f"{a}_volume") for a in ("bid", "ask")], F.array_join("rejects", ",").alias("rejects")))(
        files.read_quote_bar_csv(s, written_bars(s, d), zone="America/New_York", width=HOUR, stamps_end=True)
    )
)


def written_ticks(s: SparkSession, d: str) -> str:
    r, out = F.col("row_no"), shared_path(s, "csv")
    rows = S.ticks(s, d).select(
        "row_no", F.when(r % 23 == 0, F.concat((F.col("us") / 1000).cast("long"), F.lit(".5"))).otherwise(F.expr("us div 1000").cast("string")).alias("timestamp"), F.format_string("%.4f", "ask").alias("askPrice"),
        F.when(r % 29 == 0, "").when(r % 31 == 0, "-inf").otherwise(F.format_string("%.2f", "bid")).alias("bidPrice"), F.col("ask_volume").cast("string").alias("askVolume"), F.col("row_no").cast("string").alias("bidVolume"),
    )
    rows.where("row_no % 5 > 0").drop("row_no").write.option("header", True).option("emptyValue", "").csv(f"{out}/good")
    rows.where("row_no % 5 = 0").drop("row_no").withColumnRenamed("askPrice", "ask").write.option("header", True).option("emptyValue", "").csv(f"{out}/odd")
    return f"{out}/*"


query(
    "read_tick_csv",
    f"""with {TICKS} select case when row_no % 5 > 0 and row_no % 31 > 0 or row_no % 5 > 0 and row_no % 29 = 0 then case when row_no % 23 > 0 then us // 1000 * 1000 end when row_no % 5 > 0 and row_no % 23 > 0 then us // 1000 * 1000 end as us,
    case when row_no % 5 > 0 then printf('%.4f', ask) end as ask, case when row_no % 5 > 0 and row_no % 29 > 0 and row_no % 31 > 0 then printf('%.2f', bid) end as bid, case when row_no % 5 > 0 then row_no::varchar end as bid_volume,
    case when row_no % 5 = 0 then 'wrong_header' else concat_ws(',', case when row_no % 29 > 0 and row_no % 31 = 0 then 'bid: not_finite' end, case when row_no % 23 = 0 and not (row_no % 29 > 0 and row_no % 31 = 0) then 'timestamp_not_epoch_ms' end) end as rejects from ticks""",
)(
    lambda s, d: (lambda x: x.select("us", F.col("ask").cast("decimal(28,4)").cast("string").alias("ask"), F.col("bid").cast("decimal(28,2)").cast("string").alias("bid"), F.col("bid_volume").cast("decimal(28,0)").cast("string").alias("bid_volume"), F.array_join("rejects", ",").alias("rejects")))(
        files.read_tick_rows(s, written_ticks(s, d))
    )
)
