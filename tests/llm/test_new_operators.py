"""Decontamination, lexical search and phrase mining against brute force, with nulls, empty and repeated rows, ties, long texts and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.llm import collocations, decontamination, lexical_search, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def rows(df):
    return [r.asDict() for r in df.collect()]


def make(spark, texts, ids=None, kind="long", **extra):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


# ---- words --------------------------------------------------------------------------------------


def test_words_agree_with_the_pattern():
    for text in ("", "Ab-c9_É é`{z|Z", "a\x00b\x7fc", "ÄÖ ß1 x", "...", "A" * 5000):
        assert [w.decode() for w in words.alnum_words(text.encode())] == terms(text)
    assert words.alnum_words(None) == []


def test_sieve_lets_every_key_through(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)
    s = words.sieve_of(df, 1 << 16)
    other = np.random.default_rng(1).integers(-(2**63), 2**63, 5000).view(np.uint64)
    with np.errstate(over="ignore"):
        assert s.has(keys.view(np.uint64)).all() and s.has(other).mean() < 0.1
    assert not words.sieve_of(df.limit(0), 1 << 16).has(other).any()


# ---- 11 decontamination -------------------------------------------------------------------------


def brute_windows(texts, items, window=10, n=5, num=1, den=1):
    wins = defaultdict(set)
    for item, text in items:
        w = terms(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                wins[tuple(w[i : i + window])].add(item)
    out = []
    for text in texts:
        w, hit, found = terms(text), set(), set()
        for win, ids in wins.items():
            k = min(n, len(win))
            m = len(win) - k + 1
            for i in range(len(w) - len(win) + 1):
                same = sum(tuple(w[i + j : i + j + k]) == win[j : j + k] for j in range(m))
                if same >= -(-m * num // den):
                    hit.update(range(i, i + len(win)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize(("num", "den", "entries"), [(1, 1, 2_000_000), (1, 1, 40), (1, 2, 2_000_000), (2, 3, 60)])
def test_decontamination_against_brute_force(spark, num, den, entries):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(12)] + [(3, prose(rng, 12)), (None, prose(rng, 14)), (50, None), (51, ""), (52, "w1"), (53, "Ä ö W2"), (54, "rare " * 11)]
    parts = [t for _, t in items if t]
    texts = [None, "", " . ", "w1", "w1 w1", "Ä-Ö w2 ä ö", "Ä ö w2 Ä ö W2", "rare " * 500, parts[0], parts[0]]
    for _ in range(50):
        a = rng.choice(parts).split()
        for _ in range(rng.randint(0, 2)):
            a[rng.randrange(len(a))] = "odd"
        texts.append(f"{prose(rng, rng.randint(0, 30))} {' ! '.join(a).upper()} {prose(rng, rng.randint(0, 9))}")
    texts.append(prose(rng, 20_000))
    docs = make(spark, texts, [*range(len(texts) - 2), None, 0], n_words="clash", spans=1, _text="x", item="y")
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = rows(decontamination.contaminated(docs, table, num=num, den=den, max_entries=entries))
    by = Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(r["items"])) for r in got)
    want = Counter((d, a, b, tuple(c)) for d, (a, b, c) in zip([*range(len(texts) - 2), None, 0], brute_windows(texts, items, num=num, den=den), strict=True))
    assert by == want
    for r in got:
        assert all(x["end"] < y["start"] for x, y in zip(r["spans"], r["spans"][1:], strict=False))


def test_decontamination_of_empty_tables_and_text_ids(spark):
    docs = make(spark, ["a b c", None], ["x", "y"], "string")
    items = spark.createDataFrame([("k", "b c")], "item_id string, text string")
    assert {r["doc_id"]: (r["items"], [tuple(s) for s in r["spans"]]) for r in rows(decontamination.contaminated(docs, items))} == {"x": (["k"], [(1, 3)]), "y": ([], [])}
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert [r["spans"] for r in rows(decontamination.contaminated(docs, items.limit(0)))] == [[], []]


# ---- 12 lexical search --------------------------------------------------------------------------


def brute_search(ids, texts, items, k=10):
    docs = [Counter(terms(t)) for t in texts]
    n = [sum(d.values()) for d in docs]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(w for d in docs for w in d)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for i, ws in asked.items():
        scores = []
        for doc, d, size in zip(ids, docs, n, strict=True):
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * d[w] // (1000 * d[w] + 8 * (10 + 90 * size * n_docs // n_terms))) for w in ws if w in d)
            if s > 0:
                scores.append((-s, doc is not None, doc))
        for r, (s, _, doc) in enumerate(sorted(scores)[:k], 1):
            out[i, r] = (doc, -s)
    return out


@pytest.mark.parametrize("max_terms", [1_000_000, 30])
def test_search_against_brute_force(spark, max_terms):
    rng = random.Random(7)
    texts = [None, "", "?!", "w1", "W1 w1", "É é", *(prose(rng, int(300 * rng.random() ** 3) + 1, 300) for _ in range(300)), *["w3 w200 w250"] * 40, prose(rng, 30_000, 300)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[10] = None
    items = [(i, prose(rng, rng.randint(1, 25), 300)) for i in range(20)] + [(3, "w250"), (None, "w200 w3"), (90, None), (91, ""), (92, "nowhere"), (93, "é"), (94, "w1 w1 w1")]
    docs = make(spark, texts, ids, score="clash", q=2, term=3).withColumn("ids", F.lit(1))
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows(lexical_search.search(docs, table, max_terms=max_terms))}
    assert got == brute_search(ids, texts, items)


def test_bounds_hold_and_spare_exact_scores(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 200), 2000) for _ in range(600)]
    docs = make(spark, texts)
    vocabulary = sorted({w.encode() for t in texts for w in terms(t)})
    index, weights, n_docs, n_terms = lexical_search.build_index(docs, vocabulary)
    asked = [np.array(sorted(rng.sample(range(len(vocabulary)), 8))) for _ in range(20)]
    least = lexical_search.thresholds(index, asked, weights, 10)
    found = rows(lexical_search.rescored(index, asked, weights, least, n_docs, n_terms, 10))
    for q in range(20):
        assert sorted((r["score"] for r in found if r["q"] == q), reverse=True)[9] >= least[q]
    assert sum(r["checked"] for r in found) < 0.2 * 20 * 600
    q = np.arange(256)
    assert (lexical_search.LOWER[1:] <= lexical_search.UPPER[1:]).all() and (np.ceil(255 * lexical_search.UPPER / 1e6) == q).all()


def test_search_over_empty_tables(spark):
    docs, items = make(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert rows(lexical_search.search(make(spark, ["a b", "a b"], ["y", "x"], "string"), items, k=1))[0]["doc_id"] == "x"


# ---- 13 collocations ----------------------------------------------------------------------------


def brute_phrases(pairs, least, depth=4, first=2000):
    counts, n = Counter(), Counter()
    for lang, text in pairs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    often = {k: f for k, f in counts.items() if f >= least}
    held = defaultdict(int)
    for (lang, p), f in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held[lang, p[i : i + k]], f)
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and 100 * held[lang, p] < 80 * a:
            cuts = [(2_000_000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((score, a, " ".join(p), often[lang, p[:k]], often[lang, p[k:]]))
    found = {}
    for lang, x in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(x, key=lambda r: (-r[0], -r[1], r[2].encode()))[:first], 1):
            found[lang, rank] = (p, a, left, right, n[lang], score)
    return found


@pytest.mark.parametrize(("depth", "first", "bits"), [(4, 2000, 1 << 26), (4, 7, 1 << 10), (3, 2000, 1 << 20), (2, 2000, 1 << 20)])
def test_collocations_against_brute_force(spark, depth, first, bits):
    rng = random.Random(9)
    fixed = ["new york city hall", "Über den Wolken", "x\x01 y", "a a a a a a", "red\tred   herring", "one. two, three"]
    texts = []
    for i in range(400):
        bits_ = [prose(rng, rng.randint(0, 8), 25)] + [rng.choice(fixed) for _ in range(rng.randint(0, 3))]
        rng.shuffle(bits_)
        texts.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\n", "; "]).join(bits_)))
    texts += [("en", None), (None, ""), ("fr", "once only"), ("en", "same words here. " * 3000), ("de", texts[0][1]), ("de", texts[0][1])]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5).withColumns({"grp": F.lit(1), "word": F.lit("clash"), "w1": F.lit(2), "phrase": F.lit("p")})
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(collocations.collocations(df, least=9, depth=depth, first=first, sieve_bits=bits))}
    assert got == brute_phrases(texts, 9, depth, first)


def test_shards_and_flushes_change_nothing(spark, monkeypatch):
    rng = random.Random(10)
    texts = [("en", prose(rng, 40, 20)) for _ in range(120)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    monkeypatch.setattr(collocations, "word_counts", lambda t, f=collocations.word_counts: f(t, held_words=5))
    monkeypatch.setattr(collocations, "frequent_cells", lambda t, s, n, f=collocations.frequent_cells: f(t, s, n, held_grams=10))
    monkeypatch.setattr(collocations, "shard_tries", lambda t, s, f=collocations.shard_tries: f(t, s, shard_words=10, held_nodes=5))
    monkeypatch.setattr(collocations, "merged", lambda t, d, n, f=collocations.merged: f(t, d, n, held_nodes=3))
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(collocations.collocations(df, least=5))}
    assert got == brute_phrases(texts, 5)


def test_collocations_of_few_rows(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0
    assert rows(collocations.collocations(df, least=1))[0]["score"] == 1_000_000


def test_prefix_ranges_follow_the_corpus(spark, monkeypatch):
    """A larger corpus is merged in more ranges, with the same phrases."""
    from orthoweave.llm import collocations as c

    rows = [(i, "und", f"alpha beta gamma delta w{i % 7} v{i % 3}. alpha beta") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = sorted(map(tuple, c.collocations(docs).collect()))
    assert want and c.prefix_ranges(100) == c.PREFIXES and c.prefix_ranges(600 << 20) == 600
    seen = []
    plain = c.shard_tries
    monkeypatch.setattr(c, "RANGE_WORDS", 16)
    monkeypatch.setattr(c, "shard_tries", lambda texts, sieves, prefixes: seen.append(prefixes) or plain(texts, sieves, prefixes, shard_words=50, held_nodes=20))
    assert sorted(map(tuple, c.collocations(docs).collect())) == want
    assert seen == [-(-200 * 8 // 16)]
