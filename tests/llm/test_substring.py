import random

import corpus_pipeline
import numpy as np
import pytest

from barloom.llm import simhash, substring

RNG = random.Random(3)


def passage(n, tag="w"):
    return [f"{tag}{RNG.randrange(100000)}" for _ in range(n)]


def test_windows_are_the_cartesian_tree():
    for values in ([], [1] * 30, *[[RNG.randrange(40) for _ in range(60)] for _ in range(20)]):
        v, want = np.array(values, np.uint64), set()
        for i in range(len(v)):
            for j in range(i + 7, len(v)):
                want.add((i, j, i + int(v[i : j + 1].argmin())))
        got = substring.compact_windows(v, 8)
        long, substring.LONG = substring.LONG, 0
        try:
            assert sorted(got) == sorted(substring.compact_windows(v, 8))
        finally:
            substring.LONG = long
        for i, j, c in want:  # each range belongs to exactly one window, the one of its minimum
            assert [w[1] for w in got if w[0] <= i <= w[1] <= j <= w[2]] == [c]


def test_planted_passages_are_found(spark):
    shared, edited = passage(60), None
    edited = [*shared[:30], "changed", *shared[31:]]
    texts = {i: passage(200) for i in range(40)}
    for i in (5, 9, 17, 30):
        texts[i] = texts[i][:70] + shared + texts[i][70:]
    texts[33] = texts[33][:20] + edited + texts[33][20:]
    texts[40], texts[41], texts[42] = passage(10), passage(10), texts[3]
    texts[43] = texts[7][:49] + passage(100)
    rows = [(i, " ".join(t).upper(), "en", "s", 0) for i, t in texts.items()] + [(50, None, None, None, None), (51, "", None, None, None), (None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = substring.passages(df)
    got = {(r.doc_id, r.source_doc_id): r for r in found.collect()}
    assert set(got) == {(9, 5), (17, 5), (30, 5), (33, 5), (42, 3)}
    r = got[17, 5]
    assert (r.first_word, r.last_word, r.source_first, r.similarity) == (70, 129, 70, 1.0)
    assert 0.8 <= got[33, 5].similarity < 1
    assert (got[42, 3].first_word, got[42, 3].last_word) == (0, 199)
    out = {r.doc_id: r for r in substring.cut(df, found).collect()}
    assert len(out) == len(rows) and out[5].text == " ".join(texts[5]).upper()
    assert out[9].text.lower().split() == texts[9][:70] + texts[9][130:]
    assert out[50].text is None and out[42].text == ""
    assert substring.passages(df.limit(0)).count() == 0


def found_pairs(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.source_doc_id): r for r in substring.passages(df).collect()}


def test_a_smaller_document_with_a_part_hides_nothing(spark):
    """A has 30 words of the passage of B and C (and so any key that lies in them), D has them as well."""
    texts, want = {}, set()
    for k in range(0, 60, 6):
        shared = passage(55)
        part = shared[13:43]
        texts[k] = [*passage(80), *part, *passage(80)]
        texts[k + 1] = [*passage(40), *shared, *passage(40)]
        texts[k + 2] = [*passage(90), *shared, *passage(10)]
        texts[k + 3] = [*part, *passage(60)]
        want.add((k + 2, k + 1))
    assert set(found_pairs(spark, texts)) == want


def test_passages_at_the_threshold_are_always_found(spark):
    """50 words with one changed (0.80), and 60 words with one put in or left out, at any place."""
    texts, want = {}, set()
    for k in range(0, 240, 2):
        shared, at = passage(50 if k % 3 == 0 else 60), RNG.randrange(5, 45)
        put = [shared[at] + "x"] if k % 3 == 0 else ["new", shared[at]] if k % 3 == 1 else []
        texts[k] = [*passage(30), *shared, *passage(30)]
        texts[k + 1] = [*passage(9), *shared[:at], *put, *shared[at + 1 :], *passage(40)]
        want.add((k + 1, k))
    got = found_pairs(spark, texts)
    assert set(got) == want and all(0.8 <= r.similarity < 1 for r in got.values())


def test_repetitive_texts_are_compared_by_diagonals():
    for _ in range(20):
        line, shared = passage(27), passage(70)
        a = substring.tokens(" ".join([*line * 3, *shared[:33], "new", *shared[33:], *line]))
        b = substring.tokens(" ".join([*passage(20), *shared, *line * 2]))
        got = [substring.shared_ranges(a, b, 46, 0.8, most) for most in (1 << 22, 0)]
        assert got[0] == got[1] and any(s <= 81 and e >= 81 + 67 for s, e, _, _ in got[0])


def test_pipeline_stages(spark, tmp_path):
    line = " ".join(passage(200, "Wort"))
    leak = " ".join(passage(30, "quiz"))
    shared = " ".join(passage(60))
    texts = [line, line + " end", "12 34", None, f"{passage(90)} {shared}", f"{shared} {passage(120)}", leak, "a clean short text"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        if name != "bpe":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in df.collect()})
    assert kept[0] == {0, 1, 4, 5, 6, 7} and kept[1] == {0, 4, 5, 6, 7} and kept[2] == kept[1]  # the text with a word put behind it is a near copy
    assert kept[3] == kept[2] - {6} == kept[4]
    cut = spark.read.parquet(f"{tmp_path}/substring_dedup").where("doc_id = 5").first()
    assert shared.split()[0] not in cut.text and cut.n_chars == len(cut.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_every_exact_repeat_is_covered(spark):
    """Brute force over all pairs: each run of 50 words that a smaller document has lies in found passages, whoever quotes parts of it."""
    rng = random.Random(12)
    pool = [passage(n) for n in (50, 55, 64, 80, 120) for _ in range(4)]
    texts = {}
    for i in range(90):
        text = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            if rng.random() < 0.4:  # a part that is too short
                k = rng.randrange(20, 46)
                at = rng.randrange(len(p) - k)
                p = p[at : at + k]
            text += [*passage(rng.randrange(0, 30)), *p]
        texts[i] = text
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    found = {}
    for r in substring.passages(df).collect():
        found.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
        shared = set(zip(*[texts[r.doc_id][r.first_word + k : r.last_word + 1] for k in range(5)])) & set(zip(*[texts[r.source_doc_id][k:] for k in range(5)]))
        assert r.source_doc_id < r.doc_id and r.last_word - r.first_word >= 49 and shared
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            run = tuple(t[k : k + 50])
            if seen.setdefault(run, i) < i:
                assert set(range(k, k + 50)) <= found.get(i, set()), (i, k, seen[run])


def test_quoters_of_the_runs_hide_no_similar_passage(spark):
    """30 pairs with two quoters: each long run of a passage with one word changed stands in a smaller document that does not share it."""
    texts, want = {}, set()
    for k in range(0, 120, 4):
        shared, at = passage(52), RNG.randrange(24, 28)
        texts[k] = [*passage(20), *shared[:at], *passage(20)]
        texts[k + 1] = [*passage(20), *shared[at + 1 :], *passage(20)]
        texts[k + 2] = [*passage(30), *shared, *passage(30)]
        texts[k + 3] = [*passage(9), *shared[:at], "new", *shared[at + 1 :], *passage(40)]
        want.add((k + 3, k + 2))
    assert set(found_pairs(spark, texts)) == want


def test_every_link_is_found_or_held_by_a_common_source(spark):
    """Brute force over all pairs of texts that quote changed parts of few passages: each with a passage is a row, or both have rows with one source."""
    rng = random.Random(21)
    pool = [passage(n) for n in (60, 75, 120) for _ in range(2)]
    texts = {}
    for i in range(100):
        text = []
        for _ in range(rng.randrange(1, 3)):
            p = list(rng.choice(pool))
            if rng.random() < 0.5:
                k = rng.randrange(24, 50)
                at = rng.randrange(len(p) - k)
                p = p[at : at + k]
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(p))
                p[k : k + rng.randrange(2)] = [f"e{rng.randrange(3)}"] * rng.randrange(2)
            text += [*passage(rng.randrange(0, 20)), *p]
        texts[i] = text
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    sources = {i: {i} for i in texts}
    for r in substring.passages(df).collect():
        sources[r.doc_id].add(r.source_doc_id)
    base = {i: substring.tokens(" ".join(t)) for i, t in texts.items()}
    for x in texts:
        for y in range(x):
            if substring.shared_ranges(base[x], base[y], 46, 0.8):
                assert sources[x] & sources[y], (x, y)


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_similar_texts_equal_brute_force(spark):
    """Copies, and copies with words changed, put in and left out: groups are those of all pairs at 0.8."""
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = passage(rng.randrange(40, 400))
        texts.append(base)
        for _ in range(rng.randrange(6)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 30)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = [rng.choice(["new", "words", "here"])] * rng.randrange(2)
            texts.append(t)
    texts += [["short", "text"]] * 2 + [["short", "words"], [], []]
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [brute_sets(t) for _, t in docs]
    label, links = list(range(len(docs))), []
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.append((a, b))
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = [(i, t, 1) for i, t in docs] + [(None, docs[0][1], 1), (0, docs[0][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert {i: got.get(i, i) for i, _ in docs} == dict(enumerate(label))
    assert {i: simhash_groups.get(i, i) for simhash_groups in [{r.doc_id: r.component_id for r in simhash.similar_texts(df, tree_size=3).collect()}] for i, _ in docs} == dict(enumerate(label))
    assert simhash.similar_texts(df.limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Rows without an id, repeated rows, an empty table, a long text and extra columns with clashing names."""
    leak = " ".join(passage(30, "quiz"))
    long = " ".join(passage(60_000))
    text = " ".join(passage(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, label string"
    rows = [(None, text, "en", "s", 1, 5, "x"), (None, text, "en", "s", 1, 5, "x"), (None, leak, "en", "s", 1, 5, "x"), (3, text, "en", "s", 1, 5, "x"), (3, text, "en", "s", 1, 5, "x"), (4, text, "en", "s", 1, 5, "x"), (5, long, "en", "s", 1, 5, "x"), (6, None, None, None, None, None, None)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wanted = {"language_id": [None, None, None, 3, 3, 4, 5], "simhash_near_dedup": [None, None, None, 3, 3, 5], "substring_dedup": [None, None, None, 3, 3, 5], "decontamination": [None, None, 3, 3, 5], "bpe": [None, None, 3, 3, 5]}
    for name, data in (("odd", rows), ("none", [])):
        df = spark.createDataFrame(data, schema)
        for stage, run in corpus_pipeline.STAGES:
            run(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{stage}")
            df = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            assert sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x or 0)) == (wanted[stage] if data else []), stage


def groups_of_all_pairs(sets):
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("changes", "tree_size"), [(4, 4096), (5, 4096), (4, 50)])
def test_large_families_have_the_groups_of_all_pairs(spark, monkeypatch, changes, tree_size):
    """300 texts with words of one changed, so that they are near 0.8 of the middle, and often under 0.8 of each other; the middle is missing in half of the families."""
    if tree_size == 50:
        monkeypatch.setattr(simhash, "TREE_TOKENS", 5000)  # many trees a shard
    rng = random.Random(8)
    base = passage(200)
    texts = []
    for i in range(300):
        t = list(base)
        for k in rng.sample(range(200), changes + i % 3):
            t[k] = f"e{rng.randrange(10**6)}"
        texts.append(t)
    if changes == 4:
        texts.insert(150, base)
    chain = passage(200)  # each is near the one before it only
    for k in range(80):
        chain = [*chain[:k], f"c{k}", *chain[k + 1 :]]
        texts.append(chain)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = groups_of_all_pairs([brute_sets(t) for _, t in docs])
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(docs, "doc_id long, text string"), tree_size=tree_size).collect()}
    assert [got.get(i, i) for i in range(len(docs))] == want


def test_few_pairs_of_a_family_are_compared(spark, monkeypatch):
    """120 texts that are one text with a twelfth of the words changed, and 60 of words repeated many times: what a common source holds, or what has no passage over a key, is not compared pair by pair."""
    rng = random.Random(31)
    base, words = passage(300), passage(6)
    texts = {i: [f"e{rng.randrange(10**6)}" if rng.random() < 1 / 12 else w for w in base] for i in range(120)}
    texts |= {i: [w for w in rng.sample(words, 4) for _ in range(rng.randrange(30, 90))] for i in range(120, 180)}
    compared = []
    verified = substring.verified
    monkeypatch.setattr(substring, "verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    found_pairs(spark, texts)
    assert len(compared) == 3 and compared[2] < 2000, compared


def test_allowed_pairs_include_all_with_a_passage_over_the_key():
    """Passages with words changed, put in, left out or repeated, met in a run of 21 tokens around a place: none is refused."""
    rng, hits, refused = random.Random(5), 0, 0
    for _ in range(300):
        a, b = [*passage(120)], []
        for w in a:
            x = rng.random()
            b += [] if x < 0.015 else [w, "in"] if x < 0.03 else ["new"] if x < 0.045 else [w, w] if x < 0.05 else [w]
        x, y = substring.tokens(" ".join(a)), substring.tokens(" ".join(b))
        ranges = substring.shared_ranges(x, y, 46, 0.8)
        for at in range(30, 90, 7):
            there = np.flatnonzero(substring.runs(y, 11) == substring.runs(x, 11)[at])
            for to in there.tolist():
                left = next((k for k in range(min(at, to)) if x[at - k - 1] != y[to - k - 1]), min(at, to))
                right = next((k for k in range(min(len(x) - at, len(y) - to)) if x[at + k] != y[to + k]), min(len(x) - at, len(y) - to))
                sides = [np.full((2, 102), -1, np.int32) for _ in range(2)]
                for row, (t, p) in enumerate(((x, at), (y, to))):
                    short = (t >> np.uint64(33)).astype(np.int32)
                    for side, near in zip(sides, (short[max(0, p - 102) : p][::-1], short[p + 11 : p + 113])):
                        side[row, : len(near)] = near
                ok = substring.allowed(*sides, np.full(2, 11), np.full(2, -1), np.array([0]), np.array([1]), 46, 0.8)[0]
                over = any(s <= at and at + 11 <= e and q <= to for s, e, q, _ in ranges)
                hits += over and left + right >= 21
                assert ok or not (over and left + right >= 21), (at, to)
                refused += not ok
    assert hits > 100 and refused > 100


def test_repeated_words_are_told_apart_by_where_a_passage_may_end(spark, monkeypatch):
    """Texts of words repeated 15 to 90 times: no pair of places with a passage over a run is refused; most without one are, and few pairs of texts are compared."""
    rng, words = random.Random(17), passage(12)
    texts = {i: [w for w in rng.sample(words, 5) for _ in range(rng.randrange(15, 90) if rng.random() < 0.6 else rng.randrange(42, 50))] for i in range(60)}
    base = {i: substring.tokens(" ".join(t)) for i, t in texts.items()}
    ranges = {(x, y): substring.shared_ranges(base[x], base[y], 46, 0.8) for x in texts for y in range(x)}
    hits = refused = 0
    for word in words:
        key = int(substring.tokens(" ".join([word] * 5))[0])
        places = {i: np.flatnonzero(t == np.uint64(key)) for i, t in base.items()}
        ids = [i for i, p in places.items() if len(p) >= 11]
        sides, again = [np.full((len(ids), 102), -1, np.int32) for _ in range(2)], []
        for k, i in enumerate(ids):
            short, at, stop = (base[i] >> np.uint64(33)).astype(np.int32), int(places[i][0]), int(places[i][-1]) + 1
            for side, near in zip(sides, (short[max(0, at - 102) : at][::-1], short[stop : stop + 102])):
                side[k, : len(near)] = near
            again.append(int(short[at]) if stop - at > 11 else -1)
        core = np.array([len(places[i]) for i in ids])
        pairs = [(a, b) for a in range(len(ids)) for b in range(a)]
        ok = substring.allowed(*sides, core, np.array(again), *np.array(pairs).T, 46, 0.8)
        for (a, b), may in zip(pairs, ok):
            if min(core[a], core[b]) >= 21:
                p, q = places[ids[a]], places[ids[b]]
                over = any(s <= p[-1] - 10 and e > p[0] + 10 and at <= q[-1] - 10 and at + (e - s) > q[0] + 10 for s, e, at, _ in ranges[ids[a], ids[b]])
                assert may or not over, (ids[a], ids[b], word)
                hits += may and over
                refused += not may
                # Runs of 41 to 45 tokens would be full enough, but are too short.
                outside = set(base[ids[a]].tolist()) & set(base[ids[b]].tolist()) - {key}
                assert not may or outside or min(core[a], core[b]) >= 46
    assert hits > 30 and refused > 100, (hits, refused)
    compared = []
    verified = substring.verified
    monkeypatch.setattr(substring, "verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    sources = {i: {i} for i in texts}
    for x, y in found_pairs(spark, texts):
        sources[x].add(y)
    assert all(sources[x] & sources[y] for (x, y), found in ranges.items() if found)
    assert compared[2] < 500, compared
