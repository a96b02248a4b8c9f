"""Registered results column by column, plain versions of the kernels, and odd rows: nulls, repeats, ties, clashing names, long and no texts."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.llm import common, exact_dedup, jaccard_join, line_dedup, media, packing, pii, quality, queries, sampling
from tests.llm.test_operators import SF, near_by_brute_force, rows, shingle_set, spans_by_pattern


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}


LONG = "long text of words that go on and on " * 6000
#: Nulls, repeated ids with equal and with other texts, no text, one very long one; names that operators use themselves.
ODD_ROWS = [(None, None), (None, "null id"), (None, "null id"), (1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of one id"), (2, ""), (3, None), (4, LONG), (5, LONG.upper()), (6, "mail a@b.org and +1 784 555 8120")]


def odd(spark, *extra):
    df = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(ODD_ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


# ---- registered results -------------------------------------------------------------------------


def test_op1_columns(spark, texts):
    got = rows(media.op1_media(spark, SF))
    assert len(got) == len(texts)
    by = collections.defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        stored = media.encode_bytes(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        by[texts[r["doc_id"]] or ""].add((r["feature"], r["media_sha256"]))
    assert all(len(x) == 1 for x in by.values()) and len({f for x in by.values() for f, _ in x}) > len(by) / 4


def test_op2_columns(spark):
    pages = rows(spark.read.parquet(f"{SF}/pages.parquet"))
    payload = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    got = rows(queries.QUERIES["op2_warc"](spark, SF))
    assert len(got) == len(pages)
    for r in got:
        raw = payload[r["page_id"]]
        keeper = first[raw]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == r["page_id"] else ("revisit", keeper))


def test_op6_columns(spark, texts):
    ids = sorted(texts)
    want = {ids[k]: (n, ids[c]) for k, (n, c) in near_by_brute_force([texts[i] for i in ids]).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.op6_jaccard_join(spark, SF))} == want


def test_op7_columns(spark, texts):
    got = {r["doc_id"]: r for r in rows(pii.op7_pii(spark, SF))}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base, r = spans_by_pattern(t), got[i]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2])) and set(base) <= set(spans) and len(spans) == len(base) + r["n_added"]


def test_op8_columns(spark, texts):
    got = rows(packing.op8_packing(spark, SF))
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["n_units"]) for r in got)
    top = max(packing.LENGTHS)
    assert pieces == collections.Counter((i, k, k * top, min(top, len(t) - k * top)) for i, t in texts.items() for k in range(-(-len(t or "") // top)))
    bins = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        bins[r["bin_id"]].append(r)
    for inside in bins.values():
        used = sum(r["n_units"] for r in inside)
        assert {r["bin_length"] for r in inside} == {min(x for x in packing.LENGTHS if x >= used)} and len({r["bin_offset"] for r in inside}) == len(inside)


def test_op10_columns(spark, texts):
    got = rows(quality.op10_quality(spark, SF))
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


# ---- plain versions of the kernels --------------------------------------------------------------


def plain_pack(sizes, lengths, least, overhead=32.0, square=65536.0):
    """Best-fit decreasing under one policy, every open bin tried for every piece: (bin, final lengths)."""
    bins, left, out = [], sum(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        room = min((b["size"] - b["used"] for b in bins if b["size"] - b["used"] >= n), default=None)
        if room is None:
            fit = [c for c in lengths if c >= n]
            size = max(least, fit[0]) if least else min(fit, key=lambda c: (packing.cost(c, overhead, square) / min(c, left), c))
            bins.append({"size": size, "used": 0})
            at = len(bins) - 1
        else:  # of equally full bins any: lengths and cost do not depend on which
            at = next(k for k, b in enumerate(bins) if b["size"] - b["used"] == room)
        bins[at]["used"] += n
        out[i], left = at, left - n
    final = [min(c for c in lengths if c >= b["used"]) for b in bins]
    return sum(packing.cost(c, overhead, square) for c in final), final


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_the_cheapest_plain_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 16384), rng.randint(1, 900), 1024, 16384]) for _ in range(300)]
    bins, final = packing.pack(sizes)
    used = collections.Counter()
    for b, n in zip(bins, sizes, strict=True):
        used[b] += n
    assert final == [min(c for c in packing.LENGTHS if c >= used[b]) for b in range(len(final))]
    total = sum(packing.cost(c, 32.0, 65536.0) for c in final)
    best = min(plain_pack(sizes, packing.LENGTHS, least)[0] for least in (*packing.LENGTHS, None))
    assert total <= best * 1.005  # ties between equally full bins may differ


def test_packing_depends_on_rows_alone(spark):
    df = spark.createDataFrame([(i % 9, "x" * (100 + 37 * i)) for i in range(60)] + [(3, "same")] * 7 + [(None, "same")] * 3, "doc_id long, text string")
    key = lambda n: collections.Counter(tuple(r.values()) for r in rows(packing.pack_documents(df.repartition(n), shard_pieces=10)))
    assert key(1) == key(5) and sum(key(2).values()) == 70


def test_marginals_are_exact_on_trees():
    rng = np.random.default_rng(3)
    f = pii.Field()
    f.node, f.pair, f.trained = rng.normal(size=f.node.shape), rng.normal(size=f.pair.shape), True
    f.pair = (f.pair + f.pair.transpose(0, 2, 1)) / 2
    for text in ("1a 2b 3c", "555-1234567 x y 5551234567", "1a 2b x 9c x a@b", "1a"):
        g = pii.Graph([text])
        assert len(g.edges) < len(g.doc)
        n = len(g.doc)
        want = np.zeros((n, 5))
        for labels in itertools.product(range(5), repeat=n):
            s = sum(g.x[i] @ f.node[:, c] for i, c in enumerate(labels)) + sum(f.pair[k, labels[a], labels[b]] for (a, b), k in zip(g.edges, g.kind, strict=True))
            for i, c in enumerate(labels):
                want[i, c] += np.exp(s)
        want /= want.sum(1, keepdims=True)
        assert np.abs(f.marginals(g, rounds=200, damping=0.0) - want).max() < 1e-3


def test_one_decisive_mention_moves_all_repeats():
    f = pii.Field()
    f.node[18, 4], f.node[0, 0] = 12.0, 0.05  # a leading + says phone, anything else slightly other
    f.pair[1] = np.eye(5) * 3
    g = pii.Graph(["+17845558120 " + "then a b 17845558120 c d " * 40])
    assert (f.marginals(g).argmax(1) == 4).all()


def test_marginals_do_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    f = pii.Field()
    f.node, f.pair = rng.normal(size=f.node.shape), rng.normal(size=f.pair.shape)
    docs = [" ".join(rng.choice(["12", "a@b.c", "x", "+1 784", "555-8120", "12"], 30)) for _ in range(20)]
    together, g = None, pii.Graph(docs)
    together = f.marginals(g)
    for k, d in enumerate(docs):
        at = np.array(g.doc) == k
        assert np.array_equal(f.marginals(pii.Graph([d])), together[at])


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    y = (x[:, 2] + 0.3 * rng.normal(size=400) > 0.4).astype(float)
    f = quality.fit_forest(x, y, trees=1, depth=1, bins=64)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = (-1.0,)
    for j in range(5):
        for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, j] <= e
            if 10 <= left.sum() <= len(y) - 10:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1.0)
                best = max(best, (gain, j, e))
    assert (f.feature[0, 0], f.threshold[0, 0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert np.allclose(f.leaf[0], [0.15 * g[m].sum() / (h[m].sum() + 1.0) for m in (left, ~left)])


def flat_jpeg(blocks, restart=0):
    """A grey image, one block high, of (DC difference, AC symbols) with 4-bit codes; AC: end 00, (run 1, size 2) 01, size 1 10, sixteen zeros 110."""
    dc = bytes([0]) + bytes([0, 0, 0, 8] + [0] * 12) + bytes(range(8))
    ac = bytes([0x10]) + bytes([0, 3, 1] + [0] * 13) + bytes([0x00, 0x12, 0x01, 0xF0])
    code = {"end": "00", "pair": "01" + "11", "one": "10" + "1", "zeros": "110"}
    pieces, bits = [], ""
    for k, (diff, symbols) in enumerate(blocks):
        s = abs(diff).bit_length()
        bits += format(s, "04b") + (format(diff if diff > 0 else diff + (1 << s) - 1, f"0{s}b") if s else "") + "".join(code[x] for x in symbols)
        if k == len(blocks) - 1 or restart and k % restart == restart - 1:
            bits += "1" * (-len(bits) % 8)
            pieces.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))
            bits = ""
    scan = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(pieces) - 1 else b"") for i, p in enumerate(pieces))
    head = (8).to_bytes(1) + (8).to_bytes(2) + (8 * len(blocks)).to_bytes(2) + bytes([1, 1, 0x11, 0])
    seg = media._segment
    return b"\xff\xd8" + seg(media.DQT, bytes([0, 8]) + b"\1" * 63) + seg(media.DHT, dc) + seg(media.DHT, ac) + (seg(media.DRI, restart.to_bytes(2)) if restart else b"") + seg(media.SOF0, head) + seg(media.SOS, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 7])
def test_huffman_walk_of_blocks_with_coefficients(restart):
    rng = random.Random(restart)
    images, want = [], []
    for _ in range(9):
        blocks, plane, dc = [], [], 0
        for k in range(rng.randint(1, 40)):
            if restart and k % restart == 0:
                dc = 0
            diff = rng.randint(-60, 60)
            diff = max(-100 - dc, min(100 - dc, diff))
            dc += diff
            plane.append(dc + 128)
            blocks.append((diff, [rng.choice(["pair", "one"]) for _ in range(rng.randint(0, 9))] + rng.choice([[], ["zeros", "one"]]) + ["end"]))
        images.append(flat_jpeg(blocks, restart)), want.append(plane)
    for (planes, *_), plane in zip(media.thumbnails_of(images, together=200), want, strict=True):
        assert planes[0].tolist() == [plane]


@pytest.mark.parametrize("cut", ["SOF0", "DHT", "DQT"])
def test_images_without_a_needed_segment_raise(cut):
    good = media.encode_bytes(b"x" * 5000)
    at = good.index(bytes([0xFF, getattr(media, cut)]))
    size = int.from_bytes(good[at + 2 : at + 4])
    with pytest.raises(ValueError):
        media.thumbnail(good[:at] + good[at + 2 + size :])


def test_values_that_one_set_alone_has(spark):
    rng = random.Random(12)
    sets = {k: sorted(rng.sample(range(2000), rng.randint(1, 120))) for k in range(150)}
    seen = collections.Counter(v for s in sets.values() for v in s)
    rows_ = [(k - 75, np.array(s, np.uint64).tobytes()) for k, s in sets.items()] + [(0 - 75, np.array(sets[0], np.uint64).tobytes())]  # a set comes twice
    got = {r["sid"]: r["own"] for r in rows(jaccard_join.own_shingles(spark.createDataFrame(rows_, "sid long, set binary").repartition(5)))}
    want = {k - 75: sum(seen[v] == 1 for v in s) for k, s in sets.items()}
    assert got == {k: n for k, n in want.items() if n}


# ---- odd rows -----------------------------------------------------------------------------------


def test_exact_dedup_of_odd_rows(spark):
    got = rows(exact_dedup.exact_dedup(odd(spark, "keep_id")))
    groups = collections.defaultdict(list)
    for i, t in ODD_ROWS:
        groups[hashlib.sha256((t or "").lower().encode()).hexdigest()].append(i)
    assert len(got) == len(ODD_ROWS)
    for r in got:
        ids = groups[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), None if r["doc_id"] is None or keep is None else r["doc_id"] == keep)


def test_near_components_of_odd_rows(spark):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows(jaccard_join.near_components(odd(spark, "sid", "keys"))))
    n = len(shingle_set(LONG))
    assert got == sorted([(-1, 0, -1), (-1, 1, -1), (-1, 1, -1), (1, 3, 1), (1, 3, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (5, n, 4), (6, 3, 6)])


def test_personal_data_of_odd_rows(spark):
    df = odd(spark, "base", "added", "t", "h")
    found = rows(pii.find_pii(df, pii.train_field(df)))
    assert sorted((r["doc_id"] or -1, len(r["base"])) for r in found) == sorted((i or -1, len(spans_by_pattern(t))) for i, t in ODD_ROWS)


def test_segmentation_of_odd_rows(spark):
    got = rows(sampling.sample_segmentations(odd(spark, "rank", "ids").filter("doc_id is null or doc_id <> 5"), k=2))
    m = sampling.Model()
    seen = collections.Counter((r["doc_id"], sampling.decode(m, r["ids"])) for r in got if r["rank"] == 0)
    assert seen == collections.Counter((i, t or "") for i, t in ODD_ROWS if i != 5)


def test_quality_of_odd_rows(spark):
    df, labels = odd(spark, "_t", "_y", "held_out"), spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    forest = quality.train(df, labels)
    got = rows(quality.score(df, forest, keep=df.columns))
    assert len(got) == len(ODD_ROWS) and {r["_t"] for r in got} == {"clash"}
    with pytest.raises(ValueError, match="score"):
        quality.score(odd(spark, "Score"), forest, keep=["doc_id", "Score"])
    assert "points" in quality.score(odd(spark, "score"), forest, keep=["doc_id", "score"], score_col="points").columns


def test_a_repeated_id_keeps_the_training_bound(spark):
    df = spark.createDataFrame([(1, f"text {k}") for k in range(400)] + [(2, "z"), (5, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0)], "doc_id long, quality int")
    seen = []
    fit, quality.fit_forest = quality.fit_forest, lambda x, y, **k: seen.append(len(x)) or fit(x, y, **k)
    try:
        quality.train(df, labels, max_train_rows=50)
    finally:
        quality.fit_forest = fit
    assert seen[0] <= 50


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_lines_of_odd_rows(spark, limit):
    names = ["row", "copy", "_k", "t1", "gone", "h1", "line", "found"]
    df = odd(spark, *names)
    got = rows(line_dedup.clean(df, line_dedup.spread_lines(df, min_sites=2), broadcast_lines=limit))
    assert len(got) == len(ODD_ROWS) and all(r[c] == "clash" for r in got for c in names)
    assert sorted((r["doc_id"] or -1, r["cleaned"] or "") for r in got) == sorted([(-1, ""), (-1, "null id"), (-1, "null id"), (1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of one id"), (2, ""), (3, ""), (4, LONG), (5, LONG.upper()), (6, ODD_ROWS[-1][1])])
    with pytest.raises(ValueError, match="cleaned"):
        line_dedup.clean(odd(spark, "cleaned"), line_dedup.spread_lines(df))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_a_three_line_footer_goes_from_unrelated_pages(spark, limit):
    rng = random.Random(5)
    body = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    footer = "About us\nOK\nAll rights reserved by the owners of this site"
    df = spark.createDataFrame([(i, f"{body()}\n{footer}", f"site{i % 12}") for i in range(60)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(line_dedup.clean(df, line_dedup.spread_lines(df), broadcast_lines=limit))}
    assert got[0]["cleaned"].endswith(footer) and not any(line in got[i]["cleaned"] for i in range(1, 60) for line in footer.split("\n"))


# ---- pipeline -----------------------------------------------------------------------------------


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_near_stage_drops_rows_not_ids(spark):
    import corpus_pipeline as cp

    a, b = "one two three four five six seven", "other words that stand in no relation to these"
    df = spark.createDataFrame([(1, a), (2, a.upper()), (2, b), (3, b), (7, "x y z u v"), (7, "x y z u v"), (None, ""), (None, ""), (8, None)], "doc_id long, text string")
    got = rows(cp.near_stage(spark, common.stash(df, "t"), ""))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == [(-1, ""), (-1, ""), (1, a), (2, b), (7, "x y z u v"), (8, "")]


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    import corpus_pipeline as cp

    # every name in quotes that the stages use themselves, and names that need quoting
    own = set()
    for m in (cp, quality, line_dedup, jaccard_join, pii, common):
        own |= set(re.findall(r'"(_?[a-z][a-z0-9_]*)"', Path(m.__file__).read_text()))
    clash = sorted(own - {"doc_id", "text", "lang", "source", "n_chars"}) + ["a.b", "c d", "e`f"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd(spark, *clash)
    sf = folder(spark, tmp_path / "a", docs, labels)
    state = common.table(spark, sf, "documents")
    for name, stage in cp.STAGES[:-1]:
        state = common.stash(stage(spark, state, sf), "odd")
        assert state.columns == docs.columns, name
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in rows(state))
    assert kept == sorted([(-1, ""), (-1, "null id"), (1, "a b c d e f g"), (1, "quite another text of one id"), (2, ""), (3, ""), (4, LONG), (6, "mail <EMAIL> and <PHONE>")])
    packed = rows(cp.run(spark, sf))
    assert sum(r["n_units"] for r in packed) == sum(len(t) for _, t in kept)
    empty = folder(spark, tmp_path / "b", docs.limit(0), labels)
    assert cp.run(spark, empty).count() == 0


def test_quality_and_line_stages_against_plain_versions(spark, texts):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    state = common.stash(cp.quality_stage(spark, d, SF), "plain")
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{SF}/labels.parquet"))}
    known = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in texts)
    order = sorted(known, key=lambda i: i)
    forest = quality.fit_forest(np.array([quality.statistics(texts[i]) for i in order]), np.array([float(labels[i]) for i in order]))
    score = {i: float(forest.score(np.array([quality.statistics(t)]))[0]) for i, t in texts.items()}
    kept = {r["doc_id"] for r in rows(state)}
    assert all((score[i] >= 0.5) == (i in kept) for i in texts if abs(score[i] - 0.5) > 0.05)
    before = {r["doc_id"]: (r["text"], r["source"]) for r in rows(state)}
    sites, first = collections.defaultdict(set), {}
    for i in sorted(before):
        for line in (before[i][0] or "").split("\n"):
            if line:
                sites[line].add(before[i][1]), first.setdefault(line, i)
    spread = {x for x, s in sites.items() if len(s - {None}) >= 8}
    want = {}
    for i, (t, _) in before.items():
        shared = collections.Counter(first[x] for x in set((t or "").split("\n")) & spread if first[x] != i)
        a = shingle_set(t)
        near = any(n >= 3 and 100 * len(a & (b := shingle_set(before[j][0]))) >= 80 * len(a | b) for j, n in shared.items())
        seen, out = set(), []
        for x in (t or "").split("\n"):
            if near or x not in spread or (first[x] == i and x not in seen):
                out.append(x)
            seen.add(x)
        text = "\n".join(out)
        if text.strip(" ") or text == t:
            want[i] = text
    assert {r["doc_id"]: r["text"] or "" for r in rows(cp.line_stage(spark, state, SF))} == want


def test_stages_carry_maps_and_do_without_n_chars(spark, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd(spark).drop("n_chars").withColumn("about", F.create_map(F.lit("k"), F.array(F.lit(1))))
    sf = folder(spark, tmp_path / "m", docs, labels)
    state = common.table(spark, sf, "documents")
    for _, stage in cp.STAGES[:-1]:
        state = common.stash(stage(spark, state, sf), "maps")
        assert state.columns == docs.columns
    assert all(r["about"] == {"k": [1]} for r in state.collect())
    assert sum(r["doc_id"] == 1 for r in state.collect()) == 2


def test_rules_that_lack_a_field_are_none(spark):
    from orthoweave.llm import url_filter

    pages = spark.createDataFrame([(1, "http://a.b.org/x"), (2, None), (None, "http://c.org/y")], "page_id long, url string")
    rules = [("block", "b.org", "/"), (None, "c.org", "/"), ("block", None, "/"), ("block", "c.org", None)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(url_filter.apply_rules(pages, rules))}
    assert got == {1: ("b.org/", "block"), 2: (None, "allow"), None: (None, "allow")}
    assert {r["verdict"] for r in rows(url_filter.apply_rules(pages, rules[1:]))} == {"allow"}


def test_sampling_takes_text_keys(spark):
    docs = spark.createDataFrame([("d2", "some words"), (None, "some words"), ("d3", None)], "doc_id string, text string")
    got = rows(sampling.sample_segmentations(docs))
    assert {r["doc_id"] for r in got if r["decoded"]} >= {"d2", None} and all(r["decoded"] for r in got)


def damaged_corpus(n, seed):
    """Documents with an intact mention, words, and the same mention damaged; and documents with the damaged form alone."""
    rng = random.Random(seed)
    filler = lambda: " ".join(rng.choice(["north", "wind", "and", "sun", "room 12", "in 1999", "x7"]) for _ in range(rng.randint(4, 12)))
    out = []
    for i in range(n):
        kind = pii.KINDS[i % 4]
        digits = "".join(rng.choice("123456789") for _ in range(18))
        if kind == "card":
            digits = next(d for k in range(10) if pii.luhn(d := digits[:15] + str(k)))
        tok = {"email": f"user{digits[:4]}@mail{digits[4]}.org", "ip": f"{digits[0]}1.{digits[1]}2.1{digits[2]}3.{digits[3]}4", "card": digits, "phone": f"+{digits[0]} {digits[1:4]} {digits[4:7]} {digits[7:11]}"}[kind]
        other = pii.damaged(tok, kind, rng.randrange(2))
        first = filler() + " "
        out.append((f"{first}{tok} {filler()} {other} {filler()}", kind, other, True))
        out.append((f"{first}{filler()} {other} {filler()}", kind, other, False))
    return out


def test_skip_links_decide_about_damaged_mentions(spark):
    """Held-out documents: what the trained field adds with and without its pair weights."""
    field = pii.train_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    alone = pii.Field()
    alone.node, alone.trained = field.node, True
    docs = [d for d in damaged_corpus(200, 5) if not any(d[0][s:e] == d[2] for _, s, e in pii.base_spans(d[0]))]

    def found(f):
        hit = {True: [], False: []}
        for (text, kind, other, linked), (base, added) in zip(docs, pii.all_spans([d[0] for d in docs], f), strict=True):
            assert base == pii.base_spans(text)
            hit[linked].append(any(k == kind and text[s:e] in other for k, s, e in added))
        return np.mean(hit[True]), np.mean(hit[False])

    recall, false = found(field)
    recall_alone, _ = found(alone)
    print("recall with and without pair weights, and of unlinked ones:", recall, recall_alone, false)
    assert recall > 0.8 and recall > recall_alone + 0.5 and false < 0.05
