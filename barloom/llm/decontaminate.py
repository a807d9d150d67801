"""Benchmark decontamination with a distributed positional inverted index (operator 7); DataFrame functions only.

The frequency of every benchmark term is counted over all documents. A benchmark window is led by its three rarest
terms; the index holds the postings (term, document, position) of all terms that lead some window, stored by term.
Phrases: the postings of a window's rarest term, shifted by the term's offset in the window, are intersected with the
shifted postings of its next two; what is left is compared with the document's words, so that only exact places
remain. Proximity: the postings of a window's two rarest different terms that lie within a window's length of each
other, in any order, are met in blocks of positions; `n_near` counts the windows of which a document has such a pair.

Benchmark terms and windows are joined by broadcast while they are few (`small` rows, counted first) and by shuffle
beyond that.

Defined cases: null and empty texts have no words and hit nothing; a benchmark item without words has no window;
repeated document rows each give a row with the same values; items with equal windows are all reported; rows without
an id are kept and named by their text's hash; document ids are integers (anything that casts to long); other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, sweep, word_array, written

KEY = ["k", "th"]
LEADS = 3


def sized(df: DataFrame, rows: int, small: int) -> DataFrame:
    return F.broadcast(df) if rows <= small else df


def names(id_col: str, text_col: str) -> list[Column]:
    """k and th name a document: its id (null as the smallest long) and its text's hash."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]


def windows_of(items: DataFrame, size: int, id_col: str, text_col: str, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """Different windows (wid, terms) and which items have them (wid, item). wid is a window's content hash."""
    words = items.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size))).alias("s"))
    rows = starts.select("item", F.slice("words", F.col("s") + 1, F.lit(size)).alias("terms"))
    rows = written(rows.select(F.sha2(F.array_join("terms", " "), 256).alias("wid"), "terms", "item").distinct(), "windows", made)
    return rows.groupBy("wid").agg(F.first("terms").alias("terms")), rows.select("wid", "item").distinct()


def index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings (tid, k, th, pos) of the terms (term, tid), once each, sorted by term in files dealt by the whole posting, so that a frequent term is spread.

    The empty term stands at place -1 of every document, where n_words tells its length."""
    rows = docs.select(*names(id_col, text_col), word_array(F.col(text_col)).alias("words"))
    rows = rows.select(*KEY, F.size("words").alias("n"), "words")
    one = rows.select(*KEY, "n", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("at", "term")).join(terms, "term")
    one = one.select("tid", *KEY, (F.col("at") - 1).alias("pos"), F.when(F.col("tid") < 0, F.col("n").cast("long")).alias("n_words"))
    return one.distinct().sortWithinPartitions("tid")


def close(lead: DataFrame, second: DataFrame, distance: int) -> DataFrame:
    """(k, th, wid) of places (k, th, pos, wid) of two terms at most so many words apart, in any order; joined by blocks of positions."""
    a = lead.select(*KEY, "wid", "pos", F.floor(F.col("pos") / distance).alias("block"))
    b = second.select(*KEY, "wid", F.col("pos").alias("other"), F.explode(F.array(*[F.floor(F.col("pos") / distance) + d for d in (-1, 0, 1)])).alias("block"))
    return a.join(b, [*KEY, "wid", "block"]).where(F.abs(F.col("pos") - F.col("other")) <= distance).select(*KEY, "wid").distinct()


def matches(
    docs: DataFrame, items: DataFrame, size: int = 13, small: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(exact places (k, th, start, length, wid), proximity matches (k, th, wid), items of windows (wid, item), lengths of documents (k, th, n_words)); all are written."""
    made: list[str] = []
    spark = docs.sparkSession
    windows, of_items = windows_of(items, size, item_id, item_text, made)
    of_items = written(of_items, "items", made)
    terms = windows.select(F.posexplode("terms").alias("off", "term"), "wid", F.size("terms").alias("length"))
    vocabulary = written(terms.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary", made)
    n_terms = vocabulary.count()
    known = sized(vocabulary, n_terms, small)
    df = docs.select(F.explode(word_array(F.col(text_col))).alias("term")).join(known, "term").groupBy("tid").agg(F.count("*").alias("df"))
    df = written(df, "frequencies", made)
    # A window with a term that no document has can't occur; the others are led by their rarest places.
    ranked = terms.join(vocabulary, "term").join(df, "tid", "left").select("wid", "length", "off", "tid", F.coalesce("df", F.lit(0)).alias("df"))
    best = ranked.groupBy("wid", "length").agg(F.array_sort(F.collect_list(F.struct("df", "off", "tid"))).alias("by"))  # size terms at most
    best = written(best.where(F.col("by")[0]["df"] > 0), "ranked", made)
    n = best.count()
    leads = best.select(F.explode(F.slice("by", 1, LEADS)).alias("x")).select("x.tid").distinct()
    # The second different term of a window, for proximity.
    other = F.filter("by", lambda x: x["tid"] != F.col("by")[0]["tid"])
    pairs = best.where(F.size(other) > 0).select("wid", F.col("by")[0]["tid"].alias("one"), other[0]["tid"].alias("two"))
    wanted = vocabulary.join(leads.union(pairs.select(F.col("two").alias("tid"))).distinct(), "tid", "left_semi").select("term", "tid")
    wanted = wanted.union(spark.createDataFrame([("", -1)], "term string, tid long"))
    postings = written(index(docs, sized(wanted, n_terms, small), id_col, text_col), "postings", made)
    found = None
    for k in range(LEADS):
        lead = best.where(F.size("by") > k).select("wid", "length", F.col("by")[k]["off"].alias("off"), F.col("by")[k]["tid"].alias("tid"))
        shifted = postings.join(sized(lead, n, small), "tid").where("pos >= off").select(*KEY, (F.col("pos") - F.col("off")).alias("start"), "wid", "length")
        if found is not None:
            shorter = found.where(F.col("length") <= k)
            shifted = found.where(F.col("length") > k).join(shifted, [*KEY, "start", "wid", "length"], "left_semi").union(shorter)
        found = written(shifted, "candidates", made)
    at = lambda c: postings.join(sized(pairs.select("wid", F.col(c).alias("tid")), n, small), "tid")
    near = written(close(at("one"), at("two"), size), "near", made)
    here = found.select(*KEY).distinct()
    words = only(docs.select(*names(id_col, text_col), F.col(text_col).alias("text")), here, "left_semi", small, on=KEY).groupBy(*KEY).agg(F.first("text").alias("text"))
    words = words.select(*KEY, word_array(F.col("text")).alias("words"))
    told = found.join(sized(windows, n, small), "wid").join(words, KEY)
    exact = told.where(F.slice("words", F.col("start") + 1, F.col("length")) == F.col("terms")).select(*KEY, "start", "length", "wid").distinct()
    exact = written(exact, "exact", made)
    lengths = written(postings.where("tid < 0").select(*KEY, "n_words"), "lengths", made)
    sweep(spark, made, exact, near, of_items, lengths)
    return exact, near, of_items, lengths


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words and any hit), n_near, text_xxhash64."""
    exact, near, of_items, lengths = matches(docs, items, size, id_col=id_col, text_col=text_col, item_id=item_id, item_text=item_text)
    places = exact.select(*KEY, "start", "length").distinct()
    hit = places.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = exact.select(*KEY, "wid").distinct().join(of_items, "wid").select(*KEY, "item").distinct()
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))  # as many as the benchmark has at most
    close_ = near.groupBy(*KEY).agg(F.count("*").alias("n_near"))
    rows = docs.select(F.col(id_col).alias("doc"), *names(id_col, text_col))
    out = rows.join(lengths, KEY).join(hit, KEY, "left").join(named, KEY, "left").join(close_, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("th").alias("text_xxhash64"),
    )


def oracle(size: int = 13) -> str:
    """DuckDB SQL for the query."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with d as (select doc_id, {words('text')} as w from documents),
    i as (select cast(item_id as varchar) as item, {words('text')} as w from benchmark),
    iw as (select distinct item, least(len(w), {size}) as n, array_to_string(list_slice(w, s + 1, s + {size}), ' ') as win
           from (select item, w, unnest(range(greatest(len(w) - {size}, 0) + 1)) as s from i where len(w) > 0)),
    dw as (select doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') as win
           from (select doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) as s from d, (select distinct n from iw))),
    m as (select doc_id, s, dw.n, item from dw join iw on dw.win = iw.win and dw.n = iw.n),
    h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from m)) group by doc_id),
    t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from m) group by doc_id),
    wt as (select win, unnest(string_split(win, ' ')) as term, unnest(range(n)) as off from (select distinct win, n from iw)),
    dp as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from d), tf as (select term, count(*) as df from dp group by 1),
    rk as (select win, wt.term, row_number() over (partition by win order by coalesce(df, 0), off) as r, coalesce(df, 0) as df from wt left join tf on wt.term = tf.term),
    one as (select win, term from rk where r = 1 and df > 0), two as (select rk.win, arg_min(rk.term, r) as term from rk join one on rk.win = one.win where rk.term <> one.term group by 1),
    nr as (select a.doc_id, count(distinct one.win) as n_near from one join two on one.win = two.win join dp a on a.term = one.term join dp b on b.doc_id = a.doc_id and b.term = two.term and abs(a.pos - b.pos) <= {size} group by 1)
    select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0) as n_near
    from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id left join nr on d.doc_id = nr.doc_id"""
