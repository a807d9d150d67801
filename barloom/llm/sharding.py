"""Sharding by histogram sort (operator 4); DataFrame functions only.

The sort key of a row is (hash of its text, hash of its id, row number), so equal texts lie together and even one
text that fills a third of all bytes can be cut. Candidate boundaries are the prefixes of the key, 8 bits at a time:
one aggregation counts the exact bytes below each of them, and only prefixes that still straddle a wanted splitter are
refined in the next round, until what is left uncertain is within the tolerance. Then each row compares its key with
the splitters and the rows are exchanged once, by (shard, slice of the shard), to number them. A shard has as many
slices as its rows need, so no task ever holds a whole shard.

Law `bytes`: sizes of shards differ from the mean by the tolerance and one row at most. Size is UTF-8 bytes plus 16.

Defined cases: null text has size 16 and the checksum of the empty text; repeated rows are placed one by one; an empty
table gives an empty result; other columns are ignored; null ids are placed like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WIDTH = 8  # bits of a digit
EACH = 64 // WIDTH  # digits each of text hash, id hash, row number
DIGITS = 3 * EACH
LIMIT = 1 << WIDTH


def digit(k: int) -> Column:
    return F.shiftrightunsigned(F.col(("h", "g", "r")[k // EACH]), 64 - WIDTH * (k % EACH + 1)).bitwiseAND(LIMIT - 1).cast("int")


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[list[int]]:
    """For each inner boundary the key prefix at which the next shard starts. At most shards - 1 prefixes are refined in a round, so what reaches the driver is bounded by shards times 256 counts."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = {k: total * k / shards for k in range(1, shards)}
    slack = tolerance * total / shards
    cut: dict[int, list[int]] = {}
    # Open splitters by the prefix that holds them, with the bytes before that prefix.
    groups: dict[tuple[int, ...], tuple[float, list[int]]] = {(): (0, sorted(wanted))}
    for depth in range(DIGITS):
        if not groups:
            break
        rows = keys
        prefix = [F.col(f"d{i}") for i in range(depth)]
        if depth:
            tied = F.concat_ws(",", *prefix).alias("prefix")
            rows = keys.where(F.concat_ws(",", *prefix).isin([",".join(map(str, p)) for p in groups]))
        else:
            tied = F.lit("").alias("prefix")
        counted = rows.groupBy(tied, digit(depth).alias("d")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        found: dict[str, list[tuple[int, int, int]]] = {}
        for row in sorted(counted, key=lambda r: (r.prefix, r.d)):
            found.setdefault(row.prefix, []).append((row.d, row.bytes, row.rows))
        following: dict[tuple[int, ...], tuple[float, list[int]]] = {}
        for p, (below, open_) in groups.items():
            cells = found[",".join(map(str, p))]
            k, i = below, 0
            for s in open_:
                while i < len(cells) - 1 and k + cells[i][1] <= wanted[s]:
                    k += cells[i][1]
                    i += 1
                d, size, rows_in = cells[i]
                if size <= slack or rows_in == 1 or depth == DIGITS - 1:
                    cut[s] = [*p, d + (wanted[s] - k > size / 2)]
                else:
                    before, inside = following.setdefault((*p, d), (k, []))
                    inside.append(s)
        groups = following
        keys = keys.withColumn(f"d{depth}", digit(depth))
    return [cut[s] for s in sorted(cut)]


def at_least(cut: list[int]) -> Column:
    """Whether a row's key is at or behind a boundary: words of the key compared as unsigned numbers."""
    padded = cut + [0] * (DIGITS - len(cut))
    words = []
    for w in range((len(cut) + EACH - 1) // EACH):
        value = 0
        for d in padded[EACH * w : EACH * (w + 1)]:
            value = value * LIMIT + d
        words.append(value)
    test = F.lit(True)
    for name, value in reversed(list(zip(("h", "g", "r"), words))):
        if value >= 1 << 64:  # behind the last prefix
            bound = F.lit(False)
            test = bound
            continue
        signed = F.lit(value - (1 << 63))
        flipped = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))
        test = (flipped > signed) | ((flipped == signed) & test)
    return test


def placed(cuts: list[list[int]]) -> Column:
    """The shard of a row: a balanced tree of comparisons, so that each row makes about log2(shards) of them."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at_least(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def shard(df: DataFrame, shards: int = 40, tolerance: float = 0.002, slice_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(
        F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col).cast("string"), F.lit("id")).alias("g"), F.monotonically_increasing_id().alias("r"),
    )
    keys = written(keys, "keys")  # a few numbers a row: the rounds read these and not the texts
    rows = keys.count()
    at = keys.withColumn("shard", placed(splitters(keys, shards, tolerance)).cast("int") if rows else F.lit(0))
    slices = max(1, -(-rows // (shards * slice_rows)))
    at = at.withColumn("slice", F.pmod(F.xxhash64("r"), F.lit(slices)).cast("int"))
    # shards x slices rows: bounded by rows / slice_rows.
    sums = at.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", "slice", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "slice").orderBy("h", "g", "r")
    numbered = at.withColumn("rank", F.row_number().over(inside) - 1).join(base, ["shard", "slice"])
    return numbered.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
