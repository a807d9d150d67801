"""SimHash near-duplicates found with BK-trees (operator 6).

Links of fingerprints (`near_duplicates`). The bits are cut into radius + 2 blocks; fingerprints within `radius` bits
agree in two of the blocks at least, so the values of each two blocks name the shards in which both meet, and every
link is found in some shard. A shard is searched with a BK-tree: children hang at their Hamming distance to the parent
and only edges within the radius of the query's distance are followed. A tree of all fingerprints would grow with the
corpus, so shards are exchanged by key instead of being broadcast whole. A shard of more than `tree_size` fingerprints
is cut anew by the bits that its key leaves free (radius + 1 pieces, of which one agrees); what is still larger is
split into several trees, whose fingerprints are then queries against the shard's other trees as well. A tree keeps
its own components and a query names one member of each component it touches, so a group of m mutual links gives
about m edges and not m squared. Components are joined up by minimum labels.

Links of texts (`similar_texts`). Texts of similarity 0.8 differ in about ten bits, too many for blocks of bits. There
the shards are bands of least shingle hashes, the tree's radius is wide, and each link is verified on the shingles.

Fingerprints are made of 3-word shingles by default, hashed with XXH64 (seed 42); a bit is set if set in over half of
the shingles, repeats included.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words than a
shingle form one shingle; equal fingerprints link; repeated rows each give a row; a null id never names a component
unless all ids of it are null; other columns are ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SMALL_IDS, chunks, in_batches, only, sweep, with_groups, words_of, written
from .substring import tokens

TREE_SIZE = 4096
#: Shards of at most so many texts have all their pairs within the radius verified at once; larger ones are indexed by token for what is still apart, with the same groups in the end.
FEW = 64
#: Tokens in the index of a task.
TREE_TOKENS = 1 << 21


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for part in chunks(batches):
            got = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], [id_col, "fp"])

    return in_batches(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


class BKTree:
    """Children keyed by their Hamming distance to the parent; members carry the component they belong to."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def touched(self, value: int, radius: int) -> set[int]:
        """One member of each component that has a member within the radius."""
        found, todo = set(), [0] if self.values else []
        while todo:
            n = todo.pop()
            d = (self.values[n] ^ value).bit_count()
            if d <= radius:
                found.add(self.root(n))
            kids = self.children[n]
            if kids:
                todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
        return found

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, member) of all members within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            n = todo.pop()
            d = (self.values[n] ^ value).bit_count()
            if d <= radius:
                found.append((d, n))
            kids = self.children[n]
            todo += [kids[k] for k in kids if abs(k - d) <= radius]
        return found

    def nearest(self, value: int, radius: int) -> dict[int, int]:
        """Of each component that has a member within the radius, the nearest one, by its root."""
        best: dict[int, tuple[int, int]] = {}
        for d, n in self.within(value, radius):
            r = self.root(n)
            best[r] = min(best.get(r, (d, n)), (d, n))
        return {r: n for r, (_, n) in best.items()}

    def add(self, value: int, roots: set[int]) -> None:
        me = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.parent.append(me)
        for r in roots:
            self.parent[r] = me
        n = 0
        while me:
            d = (self.values[n] ^ value).bit_count()
            if d not in self.children[n]:
                self.children[n][d] = me
                break
            n = self.children[n][d]


def bits(of: str, first: int, width: int) -> F.Column:
    return F.shiftrightunsigned(of, first).bitwiseAND((1 << width) - 1)


def block_keys(distinct: DataFrame, radius: int, tree_size: int, made: list[str]) -> DataFrame:
    """(key, n, fp) of all shards; keys are hashes, and a collision only joins two shards."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    block = [bits("fp", a, b - a) for a, b in zip(edges, edges[1:])]
    pairs = list(combinations(range(n), 2))
    keys = [F.struct(F.xxhash64(F.lit(k), block[i], block[j]).alias("key"), F.lit(k).alias("of")) for k, (i, j) in enumerate(pairs)]
    rows = written(with_groups(distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.key", "k.of"), "key", made=made), "shards", made)
    # In a large shard the bits outside of its two blocks are cut anew; at most radius of them differ.
    free = []
    for k, (i, j) in enumerate(pairs):
        left = [b for m, (a, z) in enumerate(zip(edges, edges[1:])) if m not in (i, j) for b in range(a, z)]
        cuts = [left[len(left) * c // (radius + 1) : len(left) * (c + 1) // (radius + 1)] for c in range(radius + 1)]
        masks = [sum(1 << b for b in cut) for cut in cuts]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        free.append(F.array(*[F.xxhash64("key", F.lit(c), F.col("fp").bitwiseAND(F.lit(m))) for c, m in enumerate(signed)]))
    again = F.element_at(F.array(*free), F.col("of") + 1)
    large = with_groups(rows.where(F.col("n") > tree_size).select("fp", F.explode(again).alias("key")), "key", made=made)
    return rows.where(F.col("n") <= tree_size).select("key", "n", "fp").unionByName(large.select("key", "n", "fp"))


def tree_rows(rows: DataFrame, tree_size: int, node: str) -> DataFrame:
    """rows (key, n, node, ...) exchanged by key and tree and sorted, members of a tree before the queries from the shard's other trees."""
    rows = rows.withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int")).withColumn("own", F.pmod(F.xxhash64(node), F.col("trees")).cast("int"))
    rows = rows.withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1)))
    rows = rows.withColumn("query", (F.col("own") != F.col("tree")).cast("int"))
    return rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "query", node)


def links(distinct: DataFrame, radius: int, tree_size: int, made: list[str]) -> DataFrame:
    """(a, b): edges between different fingerprints that connect what is linked within the radius."""
    rows = tree_rows(block_keys(distinct, radius, tree_size, made), tree_size, "fp").select("key", "tree", "query", "fp")

    def run(batches):
        now, tree = None, BKTree()
        for batch in batches:
            a, b = [], []
            for key, number, query, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, number) != now:
                    now, tree = (key, number), BKTree()
                bits = fp & (1 << 64) - 1
                roots = tree.touched(bits, radius)
                for r in roots:
                    a.append(fp)
                    other = tree.values[r]
                    b.append(other - (1 << 64) if other >> 63 else other)
                if not query:
                    tree.add(bits, roots)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_batches(rows, run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node of each component, by minimum labels with pointer jumping. Each round is written to the shared folder, and the one before it removed."""
    made: list[str] = []
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges", made)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", made)
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = written(lower.join(up, "label", "left").select("node", F.least("label", "upper").alias("label"), "old"), "labels", made)
        sweep(spark, made, both, new)
        labels = new.select("node", "label")
        if not new.where("label != old").limit(1).count():
            sweep(spark, made, new)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(df: DataFrame, radius: int = 2, shingle: int = 3, tree_size: int = TREE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id that is reachable over links)."""
    made: list[str] = []
    prints = written(fingerprints(df, shingle, id_col, text_col), "fingerprints", made)
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    labels = components(links(distinct, radius, tree_size, made))
    sweep(df.sparkSession, made, prints)
    # Nodes are fingerprints; their smallest document over the whole component names it.
    linked = distinct.join(labels, distinct.fp == labels.node)
    named = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    of = distinct.join(labels, distinct.fp == labels.node, "left").join(named, "label", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def multipliers(n: int) -> list[int]:
    """Odd multipliers of the least shingle hashes: from a rule, so that all runs use the same."""
    return [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 7) | 1 for k in range(n)]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different 5-word shingles; fewer words are one shingle, no words none."""
    got = np.unique(tokens(text))
    if len(got) == 0 and (words := words_of(text)):
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return got


def sketches(df: DataFrame, minima: int) -> DataFrame:
    """(id, kind, fp, least) of rows (id, text): kind names the set of shingles, fp is its SimHash, least its least hashes."""
    odd = np.array(multipliers(minima), np.uint64)

    def run(batches):
        for part in chunks(batches, 1 << 20):
            kinds, fps, least = [], [], []
            for text in part.column(1).to_pylist():
                h = shingle_set(text)
                kinds.append(xxhash.xxh128_digest(h.tobytes()))
                ones = np.zeros(64, np.int64)
                low = np.full(minima, (1 << 64) - 1, np.uint64)
                for k in range(0, len(h), 1 << 14):
                    some = h[k : k + (1 << 14)]
                    ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    low = np.minimum(low, (some[:, None] * odd).min(axis=0))
                fps.append(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))
                least.append((low >> np.uint64(33)).astype(np.int32))
            flat = pa.array(np.concatenate(least))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1) * minima, pa.int32()), flat)
            cols = [part.column(0), pa.array(kinds, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["id", "kind", "fp", "least"])

    return in_batches(df.select("id", "text"), run, f"id {df.schema['id'].dataType.simpleString()}, kind binary, fp long, least array<int>")


def tree_pairs(rows: DataFrame, radius: int, tree_size: int, kind: str) -> DataFrame:
    """(a, b) candidates of rows (key, n, id, fp): each row and, in shards of at most FEW, every member within the radius; in larger ones the nearest member of each component."""
    rows = tree_rows(rows, tree_size, "id").select("key", "tree", "query", "id", "fp", "n")
    ids = to_arrow_type(rows.schema["id"].dataType)

    def run(batches):
        now, tree, names = None, BKTree(), []
        for batch in batches:
            a, b = [], []
            for key, number, query, doc, fp, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, number) != now:
                    now, tree, names = (key, number), BKTree(), []
                value = fp & (1 << 64) - 1
                if n <= FEW:
                    roots, found = set(), [m for _, m in tree.within(value, radius)]
                else:
                    best = tree.nearest(value, radius)
                    roots, found = set(best), best.values()
                a += [doc] * len(found)
                b += [names[m] for m in found]
                if not query:
                    tree.add(value, roots)
                    names.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], ["a", "b"])

    return in_batches(rows, run, f"a {kind}, b {kind}")


def links_apart(rows: DataFrame, similar: float, most: int, kind: str) -> DataFrame:
    """(a, b): links of rows (key, n, id, label, tokens) of the same shard between different labels, as many as join them. n: tokens of the shard.

    Shards are cut in trees of about `most` tokens, of which an index of the members by token is built; a text's shared
    tokens with all members are counted in one pass over its postings. So no pair is emitted but the links that join labels."""
    rows = tree_rows(rows, most, "id").select("key", "tree", "query", "id", "label", "tokens")
    ids = to_arrow_type(rows.schema["id"].dataType)

    def run(batches):
        now, built, names, labels, sets, parent = None, True, [], [], [], {}
        a, b = [], []
        index: list[np.ndarray] = []

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def ask(doc, label, own: np.ndarray) -> None:
            values, who, sizes = index
            lo, n = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n -= lo
            at = np.repeat(lo - (n.cumsum() - n), n) + np.arange(n.sum())
            shared = np.bincount(who[at], minlength=len(sizes))
            for m in np.flatnonzero(shared >= similar * (len(own) + sizes - shared) - 1e-9).tolist():
                x, y = root(label), root(labels[m])
                if x != y:
                    parent[x] = y
                    a.append(doc)
                    b.append(names[m])

        def build() -> None:
            values, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
            order = values.argsort(kind="stable")
            index[:] = values[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
            often = max(set(labels), key=labels.count) if len(set(labels)) < 64 else None  # its members are asked by all others
            for doc, label, own in zip(names, labels, sets):
                if label != often:
                    ask(doc, label, own)

        for batch in batches:
            column = {n: batch.column(n).to_pylist() for n in ("key", "tree", "query", "id", "label")}
            for k, (key, number, query, doc, label) in enumerate(zip(*column.values())):
                own = batch.column("tokens")[k].values.to_numpy(zero_copy_only=False)
                if (key, number) != now:
                    if not built:
                        build()
                    now, built, names, labels, sets, parent = (key, number), False, [], [], [], {}
                if query and not built:
                    if sets:
                        build()
                    built = True
                if not query:
                    names.append(doc)
                    labels.append(label)
                    sets.append(own)
                elif sets:
                    ask(doc, label, own)
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], ["a", "b"])
            a.clear()
            b.clear()
        if not built:
            build()
        yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], ["a", "b"])

    return in_batches(rows, run, f"a {kind}, b {kind}")


def similar_texts(
    df: DataFrame, similar: float = 0.8, radius: int = 18, bands: int = 10, band: int = 3, tree_size: int = TREE_SIZE, small: int = SMALL_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids that belong to a group: id, component_id (the smallest id that is reachable over verified links).

    Texts link when their sets of 5-word shingles have a similarity (shared over all) of at least `similar`. Equal sets
    are one node. Nodes meet in `bands` shards, each named by `band` least hashes, so two texts at 0.8 miss each other
    with probability (1 - 0.8^3)^10 < 0.001. A shard is searched with a BK-tree of its fingerprints, where a text at 0.8 is
    beyond 18 of 64 bits with probability under 0.005. All pairs are verified on the shingles.

    In shards of more than FEW nodes, those whose least hashes mostly agree with those of the smallest id or of the node in
    the middle of all fingerprints are paired with it first, so that a family of m copies makes about 2 m pairs and not m
    squared; the tree searches the others. Shards that verified links leave in more than one component are then searched
    for all links between their components, by an index of tokens (`links_apart`). So groups are those of all pairs at every
    size, though pairs inside a component are never looked at.

    Defined cases: rows without an id are left out; rows that share an id are one document; texts without words are
    equal; fewer than five words are one shingle; an empty table gives no row; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kind = docs.schema["id"].dataType.simpleString()
    made: list[str] = []
    spark = df.sparkSession
    seen = written(sketches(docs, bands * band), "sketches", made)
    nodes = written(seen.groupBy("kind").agg(F.min("id").alias("id"), F.max("id").alias("top"), F.first("fp").alias("fp"), F.first("least").alias("least")), "nodes", made)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("least")[band * b + i] for i in range(band)]) for b in range(bands)])
    rows = with_groups(nodes.select("id", "fp", "least", F.explode(keys).alias("key")), "key", F.min(F.struct("id", "least")).alias("first"), made=made)
    rows = written(rows.select("key", "n", "id", "fp", "least", "first"), "met", made)
    minima = bands * band
    agree = lambda x: F.size(F.filter(F.zip_with("least", x, lambda p, q: p == q), lambda e: e))
    # A large shard is a family: most of it is near its middle, the text whose fingerprint is nearest to the majority of each bit.
    large = rows.where(F.col("n") > FEW)
    bit = lambda k: F.shiftrightunsigned("fp", k).bitwiseAND(1)
    value = lambda k: F.lit(1 << k if k < 63 else -(1 << 63))
    sums = large.groupBy("key").agg(F.count("*").alias("m"), *[F.sum(bit(k)).alias(f"b{k}") for k in range(64)])
    major = sums.select("key", reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * F.col(f"b{k}") > F.col("m"), value(k)).otherwise(F.lit(0).cast("long")) for k in range(64)]).alias("major"))
    major = written(major, "major", made)
    n_large = major.count()
    sized = lambda x: F.broadcast(x) if n_large <= small else x
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("major")))
    middle = large.join(sized(major), "key").groupBy("key").agg(F.min_by(F.struct("id", "least"), F.struct(away, "id")).alias("middle"))
    middle = written(middle, "middle", made)
    large = large.join(sized(middle), "key").withColumns({"to_first": agree(F.col("first.least")), "to_middle": agree(F.col("middle.least"))})
    close = 0.85 * similar * minima  # some way below, for the pairs are verified
    each = F.array(*[F.when(F.col(f"to_{x}") >= close, F.col(f"{x}.id")) for x in ("first", "middle")])
    lead = (F.col("id") == F.col("first.id")) | (F.col("id") == F.col("middle.id"))
    large = written(large.select("key", "n", "id", "fp", F.array_compact(each).alias("pivots"), lead.alias("lead")), "shards", made)
    stars = large.select(F.col("id").alias("a"), F.explode("pivots").alias("b")).where("a <> b")
    rest = rows.where(F.col("n") <= FEW).select("key", "n", "id", "fp").unionByName(large.where((F.size("pivots") == 0) | F.col("lead")).select("key", "n", "id", "fp"))
    pairs = written(stars.unionByName(tree_pairs(rest, radius, tree_size, kind)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs", made)
    sweep(spark, made, seen, nodes, large, pairs)

    def verify(batches):
        sets = lru_cache(maxsize=256)(shingle_set)
        for batch in chunks(batches, 1 << 20, at=2):
            good = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = sets(one), sets(other)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similar * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        texts = only(docs, needed, "left_semi", small).distinct()
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
        return written(in_batches(both.select("a", "b", "one", "other"), verify, f"a {kind}, b {kind}"), "links", made)

    # A node with copies links their ids as well.
    copies = seen.join(nodes.where("id <> top").select("kind", F.col("id").alias("a")), "kind").where("id <> a").select("a", F.col("id").alias("b"))
    edges = confirmed(pairs).unionByName(copies)
    labels = components(edges)
    if n_large:
        apart = large.select("key", "id").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        apart = written(apart, "apart", made)
        mixed = apart.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        apart = written(only(apart, mixed, "left_semi", small, on="key"), "mixed", made)

        def told(batches):
            for part in chunks(batches, 1 << 20):
                sets = [np.sort(shingle_set(t).view(np.int64)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])

        texts = only(docs, apart.select("id").distinct(), "left_semi", small).distinct()
        sets = written(in_batches(texts.select("id", "text"), told, f"id {kind}, tokens array<long>").withColumn("w", F.size("tokens")), "sets", made)
        weight = written(apart.join(sets.select("id", "w"), "id").groupBy("key").agg(F.sum("w").alias("n")), "weights", made)
        rows = apart.join(F.broadcast(weight) if weight.count() <= small else weight, "key").join(sets.select("id", "tokens"), "id")
        more = written(links_apart(rows, similar, TREE_TOKENS, kind), "links", made)
        if more.limit(1).count():
            labels = components(edges.unionByName(more))
    sweep(spark, made)
    return labels.select(F.col("node").alias(id_col), F.col("label").alias("component_id"))
