"""Document fingerprints by I-Match with randomised lexicons (operator 8); DataFrame functions only.

The lexicon keeps the terms whose document frequency lies in a band: too rare terms are noise, too frequent ones say
nothing. Each of `subsets` random lexicons keeps a share of it, chosen by a hash of term and subset; the shares go down
in steps of two (1/16, 1/32, ... `levels` steps, then again), so that a text of any length has lexicons of which it
holds about one term. Per subset, a document's distinct terms are sorted and hashed; the fingerprint is the sequence of
these hashes, and the likeness of two fingerprints is the share of equal hashes among the subsets in which either has
a term. A document without any kept term falls back to the hash of all its distinct terms, in every subset.

The number of terms in the band is at most (mean distinct terms a document) / low, whatever the number of documents;
it is counted and the lexicon is broadcast only up to `small` terms, else joined by shuffle.

Defined cases: null text is empty; texts without words share one fingerprint; equal texts have equal fingerprints;
other columns are ignored; ids are integers (anything that casts to long; other texts raise). Rows stand in ascending id
order, null ids first, and rows that share an id in the order of their texts' hashes; repeated rows follow each other,
so all but the last of them are followed by their own text. The order is found in ranges of ids, so no task holds all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sweep, word_array, written

KEY = ["k", "t"]


def lexicon(docs: DataFrame, low: float, high: float, subsets: int, levels: int, text_col: str) -> DataFrame:
    """(term, subset) of the band, over all documents."""
    n = docs.count()
    term = F.explode(F.array_distinct(word_array(F.col(text_col))))
    df = docs.select(term.alias("word")).select(F.xxhash64("word").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)))
    chosen = [F.when(F.pmod(F.xxhash64("term", F.lit(j)), F.lit(16 << j % levels)) == 0, F.lit(j)) for j in range(subsets)]
    return band.select("term", F.explode(F.array_compact(F.array(*chosen))).alias("subset"))


def fingerprints(texts: DataFrame, kept: DataFrame, subsets: int, by: list[str], text_col: str) -> DataFrame:
    """by, sha (of the text) and prints (array of one hash a subset, null where no term is kept; the hash of all terms in each where none is) for each row of texts, whose by is unique."""
    words = F.sort_array(F.array_distinct(word_array(F.col(text_col))))
    rows = texts.select(*by, F.sha2(text_col, 256).alias("sha"), words.alias("words"))
    rows = rows.select(*by, "sha", "words", F.xxhash64(F.array_join("words", " ")).alias("all"))
    # Only the empty word, which stands for the document so that all stay, carries what is told of the whole text.
    none = F.lit(None)
    entry = lambda w, sha, all_: F.struct(w.alias("word"), sha.cast("string").alias("sha"), all_.cast("long").alias("all"))
    every = F.concat(F.array(entry(F.lit(""), F.col("sha"), F.col("all"))), F.transform("words", lambda w: entry(w, none, none)))
    rows = rows.select(*by, F.explode(every).alias("e")).select(*by, "e.*")
    rows = rows.withColumn("term", F.when(F.col("word") != "", F.xxhash64("word")).otherwise(F.lit(0)))
    hashed = F.xxhash64(F.array_join(F.sort_array(F.collect_list("word")), " "))
    terms = rows.join(kept, "term").groupBy(*by, "subset").agg(hashed.alias("print"), F.max("sha").alias("sha"), F.max("all").alias("all"))
    found = terms.groupBy(*by).agg(F.collect_list(F.when(F.col("subset") >= 0, F.struct("subset", "print"))).alias("got"), F.max("sha").alias("sha"), F.max("all").alias("all"))
    of = F.map_from_entries("got")
    each = F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda j: F.try_element_at(of, j))
    return found.select(*by, "sha", F.when(F.size("got") > 0, each).otherwise(F.array_repeat("all", subsets)).alias("prints"))


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.when(x.eqNullSafe(y), 1.0).otherwise(0.0)))
    told = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(told) == 0, 1.0).otherwise(F.aggregate(told, F.lit(0.0), lambda s, x: s + x) / F.size(told))


def shown(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.when(x.isNull(), "--------").otherwise(F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8)))), "")


def followers(ids: DataFrame, made: list[str]) -> DataFrame:
    """ids (k, t, n_chars, copies; k and t unique) with nk, nt of the next row and pk, pt, p_chars of the row before, in ascending order; the last is followed by the first."""
    ranged = ids.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("part", F.spark_partition_id())
    cut = written(ranged, "ranges", made)  # the number of a range is kept as it was dealt
    me = F.struct("k", "t", "n_chars")
    w = Window.partitionBy("part").orderBy(*KEY)
    inside = cut.withColumn("next", F.lead(me).over(w)).withColumn("prev", F.lag(me).over(w))
    ends = cut.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    over = Window.orderBy("part")  # one row for each range, not for each document
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(over), F.last("last").over(whole)).alias("ahead"))
    rows = inside.join(F.broadcast(ends), "part").withColumns({"next": F.coalesce("next", "after"), "prev": F.coalesce("prev", "ahead")})
    return rows.select(*KEY, "n_chars", "copies", F.col("next.k").alias("nk"), F.col("next.t").alias("nt"), F.col("prev.k").alias("pk"), F.col("prev.t").alias("pt"), F.col("prev.n_chars").alias("p_chars"))


def fingerprint_edits(
    docs: DataFrame, low: float = 0.002, high: float = 0.2, subsets: int = 32, levels: int = 8, small: int = 500_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Equal rows are one until the end: a row is named by its id and its text's hash, both of which any scan gives again.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    ids = rows.groupBy(*KEY).agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    made: list[str] = []
    line = written(followers(ids, made), "order", made)
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    # What a row gives to the one before it: as many first characters as that one loses.
    given = texts.join(line, KEY)
    given = given.select(*KEY, "n_chars", "copies", "text", "pk", "pt", F.expr("left(text, cast(floor(p_chars / 4) as int))").alias("head"))
    heads = given.select(F.col("pk").alias("k"), F.col("pt").alias("t"), "head")
    kept_part = F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))")
    mine = given.select(*KEY, "n_chars", "copies", "text").join(heads, KEY)
    last = F.concat(kept_part, F.col("head"))
    again = F.concat(kept_part, F.expr("left(text, cast(floor(length(text) / 4) as int))"))
    # kind 0: the text; 1: edited by the next row; 2: edited by its own text, where the same row follows.
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("x")), F.struct(F.lit(1).alias("kind"), last.alias("x")), F.struct(F.lit(2).alias("kind"), F.when(F.col("copies") > 1, again).alias("x")))
    each = mine.select(*KEY, F.inline(kinds)).where("x is not null")
    kept = written(lexicon(docs, low, high, subsets, levels, text_col), "lexicon", made)
    size = kept.count()
    kept = kept.union(kept.sparkSession.createDataFrame([(0, -1)], "term long, subset int"))
    told = fingerprints(each, F.broadcast(kept) if size <= small else kept, subsets, [*KEY, "kind"], "x")
    at = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    own = told.groupBy(*KEY).agg(at("prints", 0).alias("prints"), at("prints", 1).alias("edited"), at("sha", 1).alias("sha"), at("prints", 2).alias("edited_again"), at("sha", 2).alias("sha_again"))
    own = written(own, "prints", made)
    sweep(docs.sparkSession, made, line, own)
    other = own.select(F.col("k").alias("nk"), F.col("t").alias("nt"), F.col("prints").alias("next_prints"))
    out = own.join(line.select(*KEY, "n_chars", "copies", "nk", "nt"), KEY).join(other, ["nk", "nt"])
    # The last of equal rows is followed by the next document, the ones before it by themselves.
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    out = out.withColumn("copy", copy).withColumn("same", F.col("copy") < F.col("copies"))
    pick = lambda a, b: F.when(F.col("same"), F.col(a)).otherwise(F.col(b))
    edited, following = pick("edited_again", "edited"), pick("prints", "next_prints")
    doc = F.when(F.col("k") != -(1 << 63), F.col("k")).cast(docs.schema[id_col].dataType)
    return out.select(
        doc.alias(id_col), "n_chars", pick("sha_again", "sha").alias("edited_sha256"), shown(F.col("prints")).alias("fingerprint"), shown(edited).alias("edited_fingerprint"),
        likeness(F.col("prints"), edited).alias("near_edited"), likeness(F.col("prints"), following).alias("near_next"),
    )
