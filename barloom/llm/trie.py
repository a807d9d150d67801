"""Prefix trie of rebuilt conversations (operator 12).

A turn is a digest of its role and text, and the digests are dictionary-encoded to numbers, so a conversation is a short
array. The arrays are dealt out to shards by ranges of their order. Each shard puts its sequences into a ternary search
tree, the median first and then the medians of both halves, and goes through the nodes once, children before parents, to
sum up members, leaves and savings. Where the ranges are cut a node can have members on both sides; these boundary nodes
are exactly the prefixes of the splitters, so at most shards times the longest conversation. A shard gives them out as
parts that lack other boundary nodes below; the parts are added up, and then each boundary node gets those below it.

Members that end at the same node come as sorted blocks of at most 4,096 ids, which are hashed one after the other, so
no list of all of them is ever made.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null role or text is empty; a null
turn is before all others; turns of equal number are ordered by their digest; repeated rows are turns of their own; a
conversation left without turns is a member of the root alone; no conversations, no nodes; other columns are ignored;
conv_id must be an integer (what casts to long).
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, sweep, written

BLOCK = 12  # bits: most members of a block
SHARD_ROWS, MOST_SHARD_ROWS, SHARDS = 4_000, 100_000, 1_024
SAMPLES = 16  # sampled sequences a shard: they only decide where ranges are cut
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "j int, depth long, conv_id long, parent_conv_id long, parent_j int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(df: DataFrame, made: list[str], period: int = 5, heads: int = 9, conv: str = "conv_id") -> DataFrame:
    """Per conversation: conv_id, ids and sizes (of its rebuilt turns: their dictionary numbers and the bytes of their texts)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length in front keeps ("a", "bc") and ("ab", "c") apart.
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("n"))
    turns = written(turns, "turns", made)  # some tens of bytes a turn; texts are read once
    words = written(turns.groupBy("key").agg(F.first("n").alias("n")).select("key", "n", F.monotonically_increasing_id().alias("id")), "dictionary", made)
    coded = turns.drop("n").join(words, "key")
    own = coded.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "id", "n"))).alias("t"))
    own = written(own.select("c", F.col("t.id").alias("ids"), F.col("t.n").alias("sizes")), "own", made)
    base = own.where(F.col("c") % period == 0).select(F.col("c").alias("b"), F.slice("ids", 1, heads - 1).alias("head"), F.slice("sizes", 1, heads - 1).alias("head_sizes"))
    h = (F.crc32(F.col("c").cast("string")) % heads).cast("int")
    joined = own.withColumns({"b": F.col("c") - F.col("c") % period, "h": h}).join(base, "b", "left")
    none = F.array().cast("array<long>")

    def rebuilt(head: str, mine: str) -> F.Column:
        first = F.slice(F.coalesce(head, none), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine) - F.col("h"), F.lit(0))))

    return joined.select(F.col("c").alias("conv_id"), rebuilt("head", "ids").alias("ids"), rebuilt("head_sizes", "sizes").alias("sizes"))


class Tree:
    """A ternary search tree over numbers. Node 0 is the root; a node is made after the one it hangs under."""

    def __init__(self):
        self.turn, self.low, self.below, self.high = [None], [-1], [-1], [-1]
        self.up, self.depth, self.size, self.ends = [-1], [0], [0], [None]
        self.members, self.first, self.children, self.leaves, self.saved = [0], [None], [0], [0], [0]

    def add(self, turn: int, up: int, size: int) -> int:
        for part, value in ((self.turn, turn), (self.low, -1), (self.below, -1), (self.high, -1), (self.up, up), (self.depth, self.depth[up] + 1), (self.size, size), (self.ends, None), (self.members, 0), (self.first, None), (self.children, 0), (self.leaves, 0), (self.saved, 0)):
            part.append(value)
        return len(self.turn) - 1

    def find(self, up: int, turn: int, size: int | None = None) -> int:
        """The node of this turn below up; it is made if size is given, else -1 if there is none."""
        link, at = self.below, up
        while (node := link[at]) >= 0:
            if self.turn[node] == turn:
                return node
            link, at = (self.low if turn < self.turn[node] else self.high), node
        if size is None:
            return -1
        link[at] = self.add(turn, up, size)
        return link[at]

    def insert(self, ids: list[int], sizes: list[int], members: int, first: int, ends: str) -> None:
        node = 0
        for turn, size in zip(ids, sizes):
            node = self.find(node, turn, size)
        self.members[node], self.first[node], self.ends[node] = members, first, ends

    def marked(self, splitters: list[tuple[int, list[int]]], owner) -> dict[int, int]:
        """Boundary nodes, each with the splitter that names it."""
        found = {0: -1}
        for j, ids in splitters:
            node = 0
            for d, turn in enumerate(ids, 1):
                node = self.find(node, turn)
                if node < 0:
                    break
                found[node] = owner(j, d)
        return found

    def rows(self, boundary: dict[int, int]):
        """Children before parents: a boundary node takes over only its members from other boundary nodes."""
        for v in range(len(self.turn) - 1, -1, -1):
            up, inner = self.up[v], v not in boundary
            if inner:
                self.leaves[v] = self.leaves[v] or 1
                self.saved[v] += (self.members[v] - 1) * self.size[v]
            if up >= 0:
                self.members[up] += self.members[v]
                self.first[up] = self.first[v] if self.first[up] is None else min(self.first[up], self.first[v])
                if inner:
                    self.children[up] += 1
                    self.leaves[up] += self.leaves[v]
                    self.saved[up] += self.saved[v]
        for v, up in enumerate(self.up):
            inner, named = v not in boundary, boundary.get(up)
            yield boundary.get(v), self.depth[v], self.first[v], None if not inner or named is not None else self.first[up], named if inner else None, self.members[v], self.children[v], self.leaves[v], self.saved[v], self.ends[v] or (EMPTY if inner else None)


def planted(rows: list[tuple]) -> Tree:
    """Sorted sequences into a tree, medians first."""
    tree, todo = Tree(), [(0, len(rows))]
    while todo:
        a, z = todo.pop()
        if a < z:
            mid = (a + z) // 2
            tree.insert(*rows[mid])
            todo += [(a, mid), (mid + 1, z)]
    return tree


class Splitters:
    """Where ranges are cut. A prefix that several splitters share is named by the first of them."""

    def __init__(self, cuts: list[tuple[tuple[int, ...], tuple[int, ...]]]):
        self.ids, self.sizes = [c[0] for c in cuts], [c[1] for c in cuts]
        self.shared = [0]  # turns that a splitter has in common with the one before it
        for a, b in zip(self.ids, self.ids[1:]):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            self.shared.append(n)
        self.names: list[list[int]] = []  # names[j][d]: the first splitter with the same d turns
        for j, ids in enumerate(self.ids):
            same = self.names[j - 1][: self.shared[j] + 1] if j else [-1]
            self.names.append([*same, *[j] * (len(ids) + 1 - len(same))])

    def owner(self, j: int, depth: int) -> int:
        return self.names[j][depth]

    def shard(self, ids: tuple[int, ...]) -> int:
        return bisect.bisect_right(self.ids, ids)

    def around(self, shard: int) -> list[tuple[int, tuple[int, ...]]]:
        return [(j, self.ids[j]) for j in (shard - 1, shard) if 0 <= j < len(self.ids)]


def cuts(blocks: DataFrame, shards: int) -> Splitters:
    """Splitters from the rows with the least hashes: SAMPLES a shard reach the driver."""
    some = blocks.select("ids", "sizes", F.xxhash64("ids", "block").alias("h")).orderBy("h").limit(SAMPLES * shards).collect() if shards > 1 else []
    some = sorted((tuple(r.ids), tuple(r.sizes)) for r in some)
    return Splitters(sorted({some[len(some) * k // shards] for k in range(1, shards)} - {((), ())})) if some else Splitters([])


def trie(df: DataFrame, period: int = 5, heads: int = 9) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, made = df.sparkSession, []
    blocks = sequences(df, made, period, heads).groupBy("ids", "sizes", F.shiftright("conv_id", BLOCK).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("members"))
    blocks = written(blocks, "blocks", made)
    sweep(spark, made, blocks)
    n = blocks.count()
    at = cuts(blocks, min(-(-n // SHARD_ROWS), max(SHARDS, -(-n // MOST_SHARD_ROWS))))
    sent = spark.sparkContext.broadcast(at)

    def dealt(batches):
        for batch in batches:
            shard = [sent.value.shard(tuple(ids)) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    def grown(batches):
        def out(shard, rows):
            tree, splitters = planted(rows), sent.value
            found = tree.rows(tree.marked(splitters.around(shard), splitters.owner))
            while some := [row for _, row in zip(range(20_000), found)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)

        shard, rows, open_ = None, [], None  # open_: ids, sizes, members so far, the first of them, running hash

        def closed():
            ids, sizes, members, first, hashed = open_
            rows.append((ids, sizes, members, first, hashed.hexdigest()))

        for batch in batches:
            for r in batch.to_pylist():
                if open_ is not None and (r["shard"] != shard or r["ids"] != open_[0]):
                    closed()
                    open_ = None
                if r["shard"] != shard:
                    if rows:
                        yield from out(shard, rows)
                    shard, rows = r["shard"], []
                said = ",".join(map(str, r["members"])).encode()
                if open_ is None:
                    open_ = (r["ids"], r["sizes"], len(r["members"]), r["members"][0], hashlib.sha256(said))
                else:
                    open_[4].update(b"," + said)
                    open_ = (*open_[:2], open_[2] + len(r["members"]), *open_[3:])
        if open_ is not None:
            closed()
            yield from out(shard, rows)

    types, names = [pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 4, pa.string()], [x.split()[0] for x in NODES.split(", ")]
    ordered = in_batches(blocks, dealt, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in blocks.schema)}, shard int", "trie")
    ordered = ordered.repartition(max(1, len(at.ids) + 1), "shard").sortWithinPartitions("shard", "ids", "block")
    nodes = written(in_batches(ordered, grown, NODES, "trie"), "nodes")
    sweep(spark, made)
    return merged(nodes, at)


def merged(nodes: DataFrame, at: Splitters) -> DataFrame:
    """Parts of boundary nodes are added up (one row for each prefix of a splitter reaches the driver), then each gets the boundary nodes below it."""
    parts = nodes.where("j is not null").groupBy("j", "depth").agg(F.min("conv_id").alias("first"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends")).collect()
    whole = {(r.j, r.depth): [r["first"], r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends or EMPTY] for r in parts}
    above, known = {}, defaultdict(int)
    for j, d in sorted(whole, key=lambda k: -k[1]):
        row = whole[j, d]
        if not row[2]:
            row[3] = 1
        if d:
            row[4] += (row[1] - 1) * at.sizes[j][d - 1]
            up = above[j, d] = (at.names[j][d - 1], d - 1)
            whole[up][2] += 1
            whole[up][3] += row[3]
            whole[up][4] += row[4]
    schema = "j int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    rows = [(j, d, row[0], whole[above[j, d]][0] if d else None, *row[1:]) for (j, d), row in whole.items()]
    edge = nodes.sparkSession.createDataFrame(rows, schema)
    named = F.broadcast(edge.select(F.col("j").alias("parent_j"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("named")))
    inner = nodes.where("j is null").join(named, ["parent_j", "depth"], "left").withColumn("parent_conv_id", F.coalesce("named", "parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.select(out).unionByName(edge.select(out))


def oracle(table: str = "conversations", period: int = 5, heads: int = 9) -> str:
    """DuckDB SQL; the checksum is worked out bit by bit."""
    steps = ", ".join(["-1"] * 8)
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM {table} WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id AS c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, {steps}]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % {heads} AS h FROM t),
r AS (SELECT c, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c - c % {period} AND k <= h UNION ALL SELECT c, 1, k, role, text FROM c JOIN t ON t.conv_id = c AND k > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, length(role) || ':' || role || text AS turn, octet_length(encode(text)) AS n FROM r),
p AS (SELECT c, d, n, md5(string_agg(md5(turn), '') OVER (PARTITION BY c ORDER BY d)) AS path FROM o UNION ALL SELECT c, 0, 0, '' FROM c),
e AS (SELECT c, max(d) AS last FROM p GROUP BY c),
m AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last = d), '') AS ends FROM p JOIN e USING (c) GROUP BY path, d),
u AS (SELECT m.path, m.d, a.path AS up, a.d AS up_d FROM m JOIN p AS a ON a.c = m.conv_id AND a.d <= m.d),
k AS (SELECT up AS path, up_d AS d, count(*) AS n_children FROM u WHERE up_d = d - 1 GROUP BY up, up_d),
s AS (SELECT u.up AS path, u.up_d AS d, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.n) AS saved FROM u JOIN m ON m.path = u.path AND m.d = u.d LEFT JOIN k ON k.path = u.path AND k.d = u.d GROUP BY u.up, u.up_d)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.path = m.path AND s.d = m.d LEFT JOIN k ON k.path = m.path AND k.d = m.d
LEFT JOIN u ON u.path = m.path AND u.d = m.d AND u.up_d = m.d - 1 LEFT JOIN m AS up ON up.path = u.up AND up.d = u.up_d"""
