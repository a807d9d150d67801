"""Market calendars as tables of session intervals, and what is asked of them: whether a time is open, which bars a series should have, how many lie between two times.

A calendar is a rule in the local time of its zone; Spark turns it into rows (session, start, stop; epoch seconds, stop
exclusive) for a range of days, so that clock changes come from the zone's own rules. A table has at most a row a day (a
century: 36,525), so it is broadcast; rows meet it by the UTC day, and sessions of a calendar never overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400


@dataclass(frozen=True)
class Calendar:
    """name: its identity. weekly: one session from Sunday's opening to Friday's closing time, else one each weekday. Times are local seconds of the day.

    anchored: bars of a session start at its opening (and a daily bar is the opening); else they are multiples of the width from the start of the range that is asked for."""

    name: str
    zone: str
    opens: int
    closes: int
    weekly: bool = True
    anchored: bool = False


#: Identities and hours (fixed values).
UTC_FOREX = Calendar("forex-utc-week-v1", "UTC", 22 * 3600, 22 * 3600)
NEW_YORK_FOREX = Calendar("forex-new-york-week-v1", "America/New_York", 17 * 3600, 17 * 3600)
US_EQUITY = Calendar("us-equity-regular-v1", "America/New_York", 9 * 3600 + 1800, 16 * 3600, weekly=False, anchored=True)


def calendar_for(asset_class: str) -> Calendar:
    """The default of an asset class; anything but forex is held against the equity session."""
    return UTC_FOREX if asset_class == "forex" else US_EQUITY


def instant(day: Column, of_day: Column, zone: str) -> Column:
    """Epoch seconds of a local date and second of the day."""
    clock = F.timestamp_seconds(F.unix_date(day).cast("long") * DAY + of_day)
    return F.unix_seconds(F.to_utc_timestamp(clock, zone))


def sessions(spark: SparkSession, calendar: Calendar, start: int, stop: int, holidays: DataFrame | None = None, early: DataFrame | None = None) -> DataFrame:
    """Sessions that touch start <= t < stop (epoch seconds). holidays: day (local dates without a session); early: day, closes (local second of the day), at most one a day; both only matter to daily sessions."""
    days = spark.range(start // DAY - 8, stop // DAY + 9).select(F.date_from_unix_date(F.col("id").cast("int")).alias("day"))
    weekday = F.dayofweek("day")  # 1 is Sunday
    opens, closes = F.lit(calendar.opens), F.lit(calendar.closes)
    if calendar.weekly:
        rows = days.where(weekday == 1).select("day", instant(F.col("day"), opens, calendar.zone).alias("start"), instant(F.date_add("day", 5), closes, calendar.zone).alias("stop"))
    else:
        rows = days.where(weekday.between(2, 6))
        if holidays is not None:
            rows = rows.join(F.broadcast(holidays.select("day").distinct()), "day", "left_anti")
        if early is not None:
            rows = rows.join(F.broadcast(early.groupBy("day").agg(F.min("closes").alias("closes"))), "day", "left")
            closes = F.coalesce("closes", closes)
        rows = rows.select("day", instant(F.col("day"), opens, calendar.zone).alias("start"), instant(F.col("day"), closes, calendar.zone).alias("stop"))
    return rows.where((F.col("stop") > F.col("start")) & (F.col("stop") > start) & (F.col("start") < stop)).withColumnRenamed("day", "session")


def by_day(table: DataFrame) -> DataFrame:
    """Sessions once for each UTC day that they touch."""
    return table.withColumn("_day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("stop") - 1) / DAY))))


def with_session(rows: DataFrame, at: str, table: DataFrame, name: str = "found") -> DataFrame:
    """rows with the struct `name` (session, start, stop) of the session that holds the time at, null outside all of them. A null time has none."""
    s = F.broadcast(by_day(table).select("_day", F.struct("session", "start", "stop").alias(name)))
    inside = (F.col(at) >= F.col(f"{name}.start")) & (F.col(at) < F.col(f"{name}.stop"))
    keyed = rows.withColumn("_at_day", F.floor(F.col(at) / DAY))
    return keyed.join(s, (keyed["_at_day"] == s["_day"]) & inside, "left").drop("_day", "_at_day")


def expected(ranges: DataFrame, table: DataFrame, calendar: Calendar, width: int) -> DataFrame:
    """symbol, bar: the bars that each range (symbol, a, b; a <= bar < b) should have. width: seconds; a day or more asks anchored calendars for the openings alone."""
    if not calendar.anchored:
        grid = ranges.where("a < b").select("symbol", F.explode(F.sequence("a", F.col("b") - 1, F.lit(width).cast("long"))).alias("bar"))
        return with_session(grid, "bar", table).where("found is not null").select("symbol", "bar")
    # A series meets the sessions of its own days.
    days = ranges.where("a < b").select("symbol", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / DAY), F.floor((F.col("b") - 1) / DAY))).alias("_day"))
    own = days.join(F.broadcast(table.withColumn("_day", F.floor(F.col("start") / DAY))), "_day")
    # A session that opens on the day before a may still have bars from a on.
    first = ranges.where("a < b").select("symbol", "a", "b", (F.floor(F.col("a") / DAY) - 1).alias("_day"))
    own = own.unionByName(first.join(F.broadcast(table.withColumn("_day", F.floor(F.col("start") / DAY))), "_day"))
    bars = F.array("start") if width >= DAY else F.sequence("start", F.col("stop") - 1, F.lit(width).cast("long"))
    return own.select("symbol", "a", "b", F.explode(bars).alias("bar")).where("bar >= a and bar < b").select("symbol", "bar")


def spans(bars: DataFrame, width: int) -> DataFrame:
    """symbol, a, b: from each series' first bar to behind its last one."""
    return bars.groupBy("symbol").agg(F.min("bar").alias("a"), (F.max("bar") + 1).alias("b"))


def missing(bars: DataFrame, table: DataFrame, calendar: Calendar, width: int) -> DataFrame:
    """Expected bars that a series lacks."""
    return expected(spans(bars, width), table, calendar, width).join(bars.select("symbol", "bar"), ["symbol", "bar"], "left_anti")


def unexpected(bars: DataFrame, table: DataFrame, calendar: Calendar, width: int) -> DataFrame:
    """symbol, bar, code of bars that the grid lacks: closed (outside all sessions) or off_grid."""
    found = with_session(bars.select("symbol", "bar"), "bar", table)
    if calendar.anchored:
        off = (F.col("bar") != F.col("found.start")) if width >= DAY else ((F.col("bar") - F.col("found.start")) % width != 0)
        found = found.withColumn("off", off)
    else:
        found = found.join(spans(bars, width), "symbol").withColumn("off", (F.col("bar") - F.col("a")) % width != 0)
    code = F.when(F.col("found").isNull(), "closed").when(F.col("off"), "off_grid")
    return found.select("symbol", "bar", code.alias("code")).where("code is not null")


def numbered(table: DataFrame, width: int) -> DataFrame:
    """Sessions with before: how many grid points of width lie in the sessions before them. Prefix sums over one row a session."""
    points = F.ceil((F.col("stop") - F.col("start")) / width)
    over = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("before", F.coalesce(F.sum(points).over(over), F.lit(0)))


def gap_counts(bars: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """symbol, bar, previous, absent: how many session bars lie between a bar and the one before it, by the difference of their places in all sessions and not by listing them. Bars outside all sessions count as the place they'd have next."""
    line = numbered(table, width)
    # The place of a time: the last session that starts at or before it, and how far the time is into it.
    keyed = line.withColumn("_until", F.lead("start").over(Window.orderBy("start")))
    reach = keyed.withColumn("_day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.coalesce("_until", F.col("stop") + DAY) - 1) / DAY))))
    rows = bars.select("symbol", "bar").withColumn("_at", F.floor(F.col("bar") / DAY))
    inside = (F.col("bar") >= F.col("start")) & (F.col("_until").isNull() | (F.col("bar") < F.col("_until")))
    placed = rows.join(F.broadcast(reach), (F.col("_at") == F.col("_day")) & inside, "left")
    points = F.ceil((F.col("stop") - F.col("start")) / width)
    into = F.ceil((F.col("bar") - F.col("start")) / width)
    placed = placed.withColumn("_place", F.col("before") + F.least(into, points)).withColumn("_in", F.col("bar") < F.col("stop"))
    w = Window.partitionBy("symbol").orderBy("bar")
    step = F.col("_place") - F.lag("_place").over(w) - F.coalesce(F.lag("_in").over(w), F.lit(False)).cast("int")
    out = placed.select("symbol", "bar", F.lag("bar").over(w).alias("previous"), step.alias("absent"))
    return out.where("previous is not null")


def local_labels(t: Column, zone: str) -> dict[str, Column]:
    """month, weekday, hour and dst (whether clocks are ahead of the zone's January time) of epoch seconds in a zone's local time."""
    offset = lambda x: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(x), zone)) - x
    clock = F.from_utc_timestamp(F.timestamp_seconds(t), zone)
    january = F.unix_seconds(F.date_trunc("year", F.timestamp_seconds(t)))
    return {"month": F.month(clock), "weekday": F.weekday(clock), "hour": F.hour(clock), "dst": offset(t) > offset(january)}


def gap_distribution(gaps: DataFrame, zone: str, width: int) -> DataFrame:
    """symbol, label, value, n: absent bars (symbol, bar) by local month, weekday, hour and clock state, and runs of them by length."""
    labels = local_labels(F.col("bar"), zone)
    each = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in labels.items()])
    counted = gaps.select("symbol", F.explode(each).alias("x")).groupBy("symbol", "x.label", "x.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy("bar")
    run = gaps.withColumn("run", F.col("bar") - F.row_number().over(w) * width).groupBy("symbol", "run").agg(F.count("*").alias("length"))
    lengths = run.groupBy("symbol", F.col("length").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counted.unionByName(lengths.select("symbol", F.lit("run_length").alias("label"), "value", "n"))


def zero_volume_distribution(bars: DataFrame, table: DataFrame, zone: str, width: int) -> DataFrame:
    """symbol, label, value, n of bars (symbol, bar, open, high, low, close, volume) whose volume is zero: how many lie in active and closed sessions; the active ones by the labels of gap_distribution, by length of their runs, and by movement (flat: four equal prices). A null volume is not zero."""
    found = with_session(bars.where("volume = 0"), "bar", table).withColumn("active", F.col("found").isNotNull())
    sides = found.groupBy("symbol", F.when(F.col("active"), "active").otherwise("closed").alias("value")).agg(F.count("*").alias("n"))
    active = found.where("active")
    flat = F.least("open", "high", "low", "close").eqNullSafe(F.greatest("open", "high", "low", "close"))
    moves = active.groupBy("symbol", F.when(flat, "flat").otherwise("moving").alias("value")).agg(F.count("*").alias("n"))
    of = lambda df, label: df.select("symbol", F.lit(label).alias("label"), "value", "n")
    return gap_distribution(active, zone, width).unionByName(of(sides, "session")).unionByName(of(moves, "movement"))
