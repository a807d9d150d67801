"""Brute-force versions of the operators on small, awkward tables."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

from barloom.llm import common, decontaminate, imatch, langid, licenses, sharding, simhash

RNG = random.Random(9)
VOCAB = ["mit", "license", "apache", "general", "public", "licensed", "under", "the", "version", "2", "0", "É", "copyright", "c", "all", "rights", "reserved", "x"]
TEXTS = [None, "", "  \n", "MIT License", "mit-license, MIT LICENSE", "Copyright (c) 2020 by A b C. All rights reserved", "x" * 5000, "Licensed under the Apache License, Version 2.0"]
TEXTS += [" ".join(RNG.choices(VOCAB, k=RNG.randrange(60))) for _ in range(150)]
TEXTS += [TEXTS[20]] * 30


def frame(spark, texts=TEXTS, n=3):
    rows = [(i, t, "z", i, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, fp long, shard int").repartition(n)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.execute(query).fetchdf()


def test_license_scan_equals_sql(spark):
    got = rows(licenses.scan(frame(spark)))
    want = sql(licenses.oracle(), documents=frame(spark))
    assert len(got) == len(want) == len(TEXTS)
    for w in want.to_dict("records"):
        r = got[w["doc_id"]]
        assert (r.n_words, r.n_base, r.base_labels, r.labels, r.score) == (w["n_words"], w["n_base"], w["base_labels"], w["labels"], w["score"])
        assert (r.first_word is None) == bool(pd.isna(w["first_word"])) and (r.first_word is None or (r.first_word, r.last_word) == (w["first_word"], w["last_word"]))
    assert "all-rights" in got[5].labels and "apache-2.0" in got[7].labels


def test_whole_licenses_need_every_word(spark):
    """Each license with names and numbers put in is found as itself; with one mandatory word changed it is not."""
    rng, texts, want = random.Random(3), [], []
    for label, template in licenses.WHOLE.items():
        words, skip = [], False
        for mark in licenses.MARK.finditer(template):
            if mark[0].startswith("<<opt") or mark[0].startswith("<</opt"):
                skip = mark[0] == "<<opt>>" and rng.random() < 0.5
            elif mark[1]:
                words += ["Acme", "Inc"]
            elif not skip:
                words.append(mark[0])
        texts.append("Copyright (c) 2020 Acme. " + " ".join(words).upper() + " the end")
        want.append((label, True))
        broken = list(words)
        broken[-3] = "zzz"
        texts.append(" ".join(broken))
        want.append((label, False))
    texts.append("licensed under the gnu lesser general public license version 3")
    df = frame(spark, texts)
    got = rows(licenses.scan(df))
    for i, (label, there) in enumerate(want):
        assert (label in got[i].labels.split(",")) == there and (got[i].score == 1.0) == there, (label, there, got[i].labels)
    assert got[len(want)].labels == "gpl,lgpl-3.0" and got[len(want)].score == 0.75
    for w in sql(licenses.oracle(), documents=df).to_dict("records"):
        assert (got[w["doc_id"]].labels, got[w["doc_id"]].score) == (w["labels"], w["score"])
    free = licenses.Automaton({"x": "<<var:2>> stop"})
    assert [p[:2] for p in free.places([b"a", b"b", b"stop"])] == [(0, 3), (1, 3), (2, 3)]
    odd = licenses.scan(spark.createDataFrame([(None, "MIT License"), (None, None), (1, "mit license " * 300_000)], "doc_id long, text string")).collect()
    assert sorted(r.n_base for r in odd) == [0, 1, 300_000] and licenses.scan(df.limit(0)).count() == 0


def test_language_is_learned(spark):
    words = {"en": ["the", "and", "ing", "tion"], "de": ["der", "sch", "ung", "über"], "fr": ["les", "eau", "été", "que"]}
    docs = [(i, "".join(RNG.choices(words[lang] + [" "], k=40)), lang) for i, lang in enumerate(RNG.choices(list(words), k=300))]
    df = spark.createDataFrame(docs + [(900, None, "en"), (901, "123 !?", "de"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 != 1"), per_language=50)
    got = rows(langid.predict(df, model))
    assert sum(got[i].lang_pred == lang for i, _, lang in docs) >= 0.97 * len(docs)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(df.limit(0)) is None
    assert rows(langid.predict(df, None))[0].lang_pred == "und"


def brute_code_lengths(samples, text):
    """Plain PPM with exclusion: whole distributions, mixed down order by order."""
    plain = lambda t: bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode())
    symbols = [32, *range(97, 123), *range(128, 256)]
    out = []
    for lang in sorted(samples):
        seen = {}
        for t in samples[lang]:
            raw = b"   " + plain(t)
            for i in range(3, len(raw)):
                for k in range(4):
                    at = seen.setdefault(raw[i - k : i], {})
                    at[raw[i]] = at.get(raw[i], 0) + 1
        raw, bits = b"   " + plain(text), 0.0
        for i in range(3, len(raw)):
            p = {s: 1 / len(symbols) for s in symbols}
            for k in range(4):
                at = seen.get(raw[i - k : i])
                if at:
                    n, d = sum(at.values()), len(at)
                    rest = sum(v for s, v in p.items() if s not in at)
                    p = {s: at[s] / (n + d) if s in at else v / rest * d / (n + d) for s, v in p.items()}
            assert abs(sum(p.values()) - 1) < 1e-9
            bits -= np.log2(p[raw[i]])
        out.append(bits)
    return out


def test_code_lengths_equal_plain_ppm(spark):
    samples = {"en": ["the cat sat on the mat", "then that", ""], "ru": ["привет мир", "мир и мир"], "xx": ["zzz zzz"]}
    docs = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in samples for t in samples[lang])]
    docs += [(None, "the end", "en"), (None, "the end", "en"), (77, None, "en")]
    samples["en"] += ["the end", "the end"]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(df)
    texts = ["the cat", "привет", "日本 the Ж", "qqq", "x", " ", "ZZZ 123 zzz", "the мир" * 40]
    got = langid.code_lengths(model, pa.array(texts))
    for t, g in zip(texts, got):
        assert np.allclose(g, brute_code_lengths(samples, t), rtol=1e-4, atol=1e-3), t
    # other languages never read as blanks: Cyrillic text is Russian; ties give the first language; rows stay, null ids too
    asked = spark.createDataFrame([(1, "мир привет", "a", 5), (None, "the cat", "b", 6), (None, "the cat", "b", 6), (2, "", "c", 7)], "doc_id long, text string, lang_pred string, score int")
    told = langid.predict(asked, model, keep=("text",)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in told) == [(0, "en"), (0, "en"), (1, "ru"), (2, "und")]
    same = langid.train(df.where("lang = 'xx'").unionByName(df.where("lang = 'xx'").withColumn("lang", F.lit("yy"))))
    assert [r.lang_pred for r in langid.predict(asked.limit(1), same).collect()] == ["xx"]


def test_shards_are_balanced_and_gapless(spark):
    for texts in (TEXTS, [], ["same text"] * 400, ["a" * 5000, *["b"] * 50]):
        got = sharding.shard(frame(spark, texts), shards=7, slice_rows=10).collect()
        assert len(got) == len(texts)
        size = np.zeros(7)
        for r in got:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
            size[r.shard] += r.size
        for s in range(7):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        if got:
            mean, most = size.sum() / 7, max(r.size for r in got)
            assert (abs(size - mean) <= 2 * most + 0.01 * mean).all(), size


def test_shards_of_odd_rows(spark):
    """Null ids, repeated rows, one text of half of all bytes, clashing columns: slots stay gapless and sizes near equal."""
    rows = [(None, "a"), (None, "a"), *[(5, "same")] * 60, *[(i, f"text {i}") for i in range(200)], (9, "x" * 3000)]
    df = spark.createDataFrame([(i, t, 1, "l") for i, t in rows], "doc_id long, text string, shard int, law string").repartition(3)
    got = sharding.shard(df, shards=5, tolerance=0.01, slice_rows=20).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((i is not None, i or 0, len(t) + 16) for i, t in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 2 * 3016


def brute_fingerprint(text):
    raw = (text or "").encode()
    words = [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in raw).replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tree_size", [4096, 2])
def test_simhash_components_equal_brute_force(spark, tree_size):
    base = [" ".join(RNG.choices(VOCAB + [f"w{i}" for i in range(200)], k=300)) for _ in range(12)]
    near = [t.replace(" ", "  ", 1) if i % 3 else " ".join(t.split()[:-1] + [f"e{i}"]) for i, t in enumerate(base * 6)]
    texts = TEXTS + base + near
    got = rows(simhash.near_duplicates(frame(spark, texts), tree_size=tree_size))
    prints = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(50):
        before = list(label)
        for a, b in combinations(range(len(texts)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    for i in range(len(texts)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", label[i])


def test_simhash_and_language_on_odd_rows(spark):
    """Null ids, repeated rows, an id of two texts, a text of half a million words, no rows, clashing columns."""
    long = "the quick brown fox " * 125_000
    rows_ = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "other words here now"), (8, None), (9, ""), (10, long), (11, long)]
    df = spark.createDataFrame([(i, t, "en", 1, "z") for i, t in rows_], "doc_id long, text string, lang string, fp int, component_id string").repartition(3)
    got = sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = {t: f"{brute_fingerprint(t):016x}" for _, t in rows_}
    same = prints["a b c d"]
    assert [(d, f) for d, f, _ in got] == sorted(((d or 0), prints[t]) for d, t in rows_)
    assert {c for d, f, c in got if f == same} == {7} and {c for d, f, c in got if f == prints[None]} == {8} and {c for d, f, c in got if d in (10, 11)} == {10}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    model = langid.train(df)
    told = langid.predict(df, model).collect()
    assert sorted(((r.doc_id or 0), r.lang_pred) for r in told) == sorted(((d or 0), "en" if t else "und") for d, t in rows_)
    assert langid.predict(df.limit(0), model).count() == 0


def test_decontamination_equals_sql(spark):
    line = " ".join(f"q{i}" for i in range(40))
    texts = TEXTS + [line, "a b " + line.upper() + " c", " ".join(line.split()[5:18]), " ".join(line.split()[5:17]), "short item here", line + " x " + line]
    items = spark.createDataFrame([(0, line, 1), (1, "Short item", 2), (2, None, 3), (3, "", 4), (4, "the", 5), (5, line, 6), (6, "never seen words", 7)], "item_id long, text string, n_hit int")
    df = frame(spark, texts)
    want = sql(decontaminate.oracle(), documents=df, benchmark=items)
    got = rows(decontaminate.decontaminate(df, items))
    assert len(got) == len(want) == len(texts)
    for w in want.to_dict("records"):
        r = got[w["doc_id"]]
        assert {c: r[c] for c in w} == w
    assert any(r.n_near > r.n_items for r in got.values())
    # rows without an id, repeated rows, an id of two texts and a text of a million words
    odd = [(None, line), (None, "x"), (7, line), (7, line), (7, "other"), (8, "word " * 1_000_000 + line)]
    told = decontaminate.decontaminate(spark.createDataFrame([(i, t, "c", 1) for i, t in odd], "doc_id long, text string, term string, n_hit int"), items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in told) == [(0, 1, 0, False), (0, 40, 40, True), (7, 1, 0, False), (7, 40, 40, True), (7, 40, 40, True), (8, 1_000_040, 40, False)]
    assert decontaminate.decontaminate(df.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, items.limit(0)).collect())


def spark_hash(spark, values, *more):
    """xxhash64 as Spark computes it, asked of Spark."""
    df = spark.createDataFrame([(v,) for v in values], "v string" if not values or isinstance(values[0], str) else "v long")
    return [r.h for r in df.select(F.xxhash64("v", *more).alias("h")).collect()]


def imatch_words(text):
    return sorted({w.decode() for w in common.words_of(text)}, key=lambda w: w.encode())


def brute_prints(spark, texts, corpus, low, high, subsets, levels):
    """Fingerprints of texts: the hashes of sorted kept terms a subset, or of all terms where none is kept."""
    df = {}
    for t in corpus:
        for w in imatch_words(t):
            df[w] = df.get(w, 0) + 1
    band = [w for w, n in df.items() if max(2, low * len(corpus)) <= n <= max(2, high * len(corpus))]
    term = dict(zip(band, spark_hash(spark, band)))
    kept = [set() for _ in range(subsets)]
    for j in range(subsets):
        kept[j] = {w for w, h in zip(band, spark_hash(spark, [term[w] for w in band], F.lit(j))) if h % (16 << j % levels) == 0}
    lines, at = {}, []
    for t in texts:
        words = imatch_words(t)
        row = [" ".join(w for w in words if w in kept[j]) or None for j in range(subsets)]
        at.append(row if any(row) else [" ".join(words)] * subsets)
    for row in at:
        for x in row:
            lines[x] = None
    names = [x for x in lines if x is not None]
    lines.update(zip(names, spark_hash(spark, names)))
    return [[None if x is None else lines[x] for x in row] for row in at]


def brute_likeness(a, b):
    told = [x == y for x, y in zip(a, b) if x is not None or y is not None]
    return sum(told) / len(told) if told else 1.0


def test_imatch_equals_brute_force(spark):
    words = [f"t{i}" for i in range(300)]
    texts = TEXTS[:40] + [" ".join(RNG.choices(words, k=RNG.randrange(1, 400))) for _ in range(60)] + ["日本 語 é"] * 2 + ["longer text " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (50, texts[50]), (50, texts[50]), (51, "another text of the same id")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kind string, k int").repartition(5)
    t_hash = spark_hash(spark, [t or "" for _, t in rows])
    line = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, t_hash[n]))
    ordered = [(rows[n][0], rows[n][1] or "") for n in line]
    edited = [t[: len(t) - len(t) // 4] + ordered[(n + 1) % len(ordered)][1][: len(t) // 4] for n, (_, t) in enumerate(ordered)]
    args = {"low": 0.02, "high": 0.9, "subsets": 12, "levels": 3}
    prints = brute_prints(spark, [t for _, t in ordered] + edited, [t for _, t in ordered], **args)
    own, changed = prints[: len(ordered)], prints[len(ordered) :]
    show = lambda p: "".join("--------" if x is None else f"{x & (1 << 64) - 1:016x}"[8:] for x in p)
    want = sorted(
        (-1 if d is None else d, len(t), hashlib.sha256(edited[n].encode()).hexdigest(), show(own[n]), show(changed[n]), round(brute_likeness(own[n], changed[n]), 9), round(brute_likeness(own[n], own[(n + 1) % len(ordered)]), 9))
        for n, (d, t) in enumerate(ordered)
    )
    got = imatch.fingerprint_edits(df, **args).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert np.mean([r.near_edited for r in got]) > 2 * np.mean([r.near_next for r in got])
    assert imatch.fingerprint_edits(frame(spark, [])).count() == 0
