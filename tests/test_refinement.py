"""Refinement and two-stage alignment against plain numpy, and operators that have no SQL of their own."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.operators import evaluation, graph, ml, procrustes, retrieval, species, vector

rng = np.random.default_rng(11)


def rotation(d):
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    if np.linalg.det(q) < 0:
        q[:, 0] *= -1
    return q


def frame(spark, x, **columns):
    rows = [(i, v.tolist(), *columns.values()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {c} int" for c in columns))


def plain_refine(x, y, pairs, rounds=5, threshold=0.2, k=10, center=False, scale=False):
    """Dense similarities, Python sets, one solve a round."""
    w = np.array([p[2] for p in pairs], float)
    a, b = x[[p[0] for p in pairs]], y[[p[1] for p in pairs]]
    known = {(p[0], p[1]) for p in pairs}
    rot = procrustes.solve(procrustes.Sums.of(a, b, w), center=center, scale=scale)
    log = []
    for _ in range(rounds):
        sim = np.round(procrustes.unit(rot.apply(x).astype(np.float32).astype(float)) @ procrustes.unit(y).T, 9)
        to, back = sim.argmax(1), sim.argmax(0)
        ra, rb = np.sort(sim, 1)[:, -k:].mean(1), np.sort(sim, 0)[-k:].mean(0)
        new = [(i, j) for i, j in enumerate(to) if back[j] == i and 2 * sim[i, j] - ra[i] - rb[j] >= threshold and (i, j) not in known]
        log.append(len(new))
        if not new:
            break
        i, j = np.array(new).T
        nxt = procrustes.solve(procrustes.Sums.of(np.concatenate([a, x[i]]), np.concatenate([b, y[j]]), np.concatenate([w, np.full(len(i), w.mean())])), center=center, scale=scale)
        moved, rot = np.linalg.norm(nxt.r - rot.r), nxt
        if moved < 1e-5:
            break
    return rot, log


@pytest.mark.parametrize("options", [{}, {"center": True, "scale": True}])
def test_refinement_both_ways_matches_a_plain_loop(spark, options):
    d, n = 6, 90
    y = rng.normal(size=(n, d)) + 0.4
    x = 1.7 * (y + 0.15 * rng.normal(size=(n, d))) @ rotation(d) + 0.3
    pairs = [(i, i, 1.0 + i % 3) for i in range(15)]
    src, ref = frame(spark, x), frame(spark, y)
    p = spark.createDataFrame(pairs, "src long, ref long, w double")
    want, counts = plain_refine(x, y, pairs, **options)
    for held in (64 << 20, 0):
        rot, log = procrustes.refine(p, src, ref, threshold=0.2, held_bytes=held, **options)
        assert [r["new"] for r in log] == counts and len(counts) > 1
        assert np.abs(rot.r - want.r).max() < 1e-5 and rot.scale == pytest.approx(want.scale, abs=1e-6)


def stages(spark, noise=0.0, shift=0.0):
    """Species 0 is the reference, 1 a seed, 2 and 3 follow 0 and 1, each a turned (and scaled, shifted) copy."""
    d, n = 5, 60
    base = rng.normal(size=(n, d))
    rows, true = [], {}
    for s in range(4):
        turn = np.eye(d) if s == 0 else rotation(d)
        v = base if s == 0 else (1 + 0.2 * s) * (base + noise * rng.normal(size=base.shape)) @ turn + shift
        rows += [(s, 100 * s + i, i, x.tolist()) for i, x in enumerate(v)]
        true[s] = v
    emb = spark.createDataFrame(rows, "species int, id long, idx long, v array<double>")
    ref = {1: 0, 2: 0, 3: 1}
    pairs = spark.createDataFrame([(s, t, 100 * s + i, 100 * t + i, 1.0) for s, t in ref.items() for i in range(20)], "sp_src int, sp_ref int, src long, ref long, w double")
    return base, true, emb, pairs, spark.createDataFrame([(2, 0), (3, 1)], "species int, seed int")


@pytest.mark.parametrize("refinement", [None, {"threshold": 0.1, "k": 5}])
def test_all_species_get_centre_and_scale(spark, refinement):
    base, _, emb, pairs, groups = stages(spark, shift=3.0)
    out = procrustes.two_stage(emb, pairs, 0, [0, 1], groups, refinement=refinement, center=True, scale=True).collect()
    assert collections.Counter(r["status"] for r in out) == {"reference": 60, "seed": 60, "aligned": 120}
    for r in out:
        assert np.abs(np.array(r["v"]) - base[r["idx"]]).max() < 1e-3
    plain = procrustes.two_stage(emb, pairs, 0, [0, 1], groups, refinement=refinement).collect()
    assert max(np.abs(np.array(r["v"]) - base[r["idx"]]).max() for r in plain if r["species"] == 3) > 0.5


def test_large_species_are_refined_alike(spark):
    _, _, emb, pairs, groups = stages(spark, noise=0.2)
    key = lambda o: {(r["species"], r["id"]): np.round(r["v"], 4).tolist() for r in o.collect()}
    a, b = (key(procrustes.two_stage(emb, pairs, 0, [0, 1], groups, refinement={"threshold": 0.1, "k": 5}, local_genes=n)) for n in (200_000, 10))
    assert a.keys() == b.keys() and all(np.abs(np.array(a[k]) - b[k]).max() < 1e-3 for k in a)


def test_options_act_alike_on_seeds_and_others(spark):
    """Species 2 and seed 1 hold the same vectors and pairs: every option gives them the same result."""
    _, true, emb, pairs, _ = stages(spark, noise=0.3)
    twin = emb.filter("species < 2").unionByName(emb.filter("species = 1").select(F.lit(2).alias("species"), (F.col("id") + 100).alias("id"), "idx", "v"))
    p = pairs.filter("sp_src = 1").withColumn("w", 1.0 + F.col("src") % 4)
    p = p.unionByName(p.select(F.lit(2).alias("sp_src"), "sp_ref", (F.col("src") + 100).alias("src"), "ref", "w"))
    groups = spark.createDataFrame([(2, 0)], "species int, seed int")
    seen = []
    for options in ({}, {"vanilla": True}, {"center": True}, {"scale": True}, {"allow_reflection": True, "center": True}):
        for refinement in (None, {"threshold": 0.1, "k": 5, "rounds": 2}):
            out = procrustes.two_stage(twin, p, 0, [0, 1], groups, refinement=refinement, **options).collect()
            by = {s: np.array([r["v"] for r in sorted(out, key=lambda r: r["id"]) if r["species"] == s]) for s in (1, 2)}
            assert np.allclose(by[1], by[2], atol=1e-5)
            seen.append(by[1])
    assert all(np.abs(seen[0] - x).max() > 1e-4 for x in seen[2:8:2])


def test_subsamples_and_robustness(spark):
    d, n = 5, 80
    y = rng.normal(size=(n, d))
    turn = rotation(d)
    src, ref = frame(spark, y @ turn.T), frame(spark, y)
    pairs = spark.createDataFrame([(i, i, 1.0) for i in range(n)], "src long, ref long, w double")
    half = [{r["src"] for r in procrustes.subsampled(pairs, 0.5, k).collect()} for k in (0, 0, 1)]
    assert half[0] == half[1] != half[2] and len(half[0]) == 40
    truth = spark.createDataFrame([(i, j, round(float(y[i] @ y[j] / np.linalg.norm(y[i]) / np.linalg.norm(y[j])), 9)) for i in range(n) for j in (i, (i + 7) % n, (i + 20) % n)], "u long, v long, s double")
    out = procrustes.anchor_robustness(pairs, src, ref, truth, rates=(1.0, 0.25), replicates=2).collect()
    assert sorted((r["rate"], r["replicate"], r["n_anchors"]) for r in out) == [(0.25, 0, 20), (0.25, 1, 20), (1.0, 0, 80), (1.0, 1, 80)]
    assert all(r["rho"] > 0.9999 for r in out)


def test_rows_of_factor_tables_align(spark):
    y = rng.normal(size=(30, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    pairs = spark.createDataFrame([(i, i) for i in range(30)], "src long, ref long")
    assert np.abs(procrustes.legacy_fit(frame(spark, y @ q.T), frame(spark, y), pairs).r - q).max() < 1e-5


def test_moments_by_group(spark):
    x, y = rng.normal(size=(20, 3)), rng.normal(size=(20, 2))
    df = spark.createDataFrame([(i % 2, a.tolist(), b.tolist(), float(i)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g int, x array<double>, y array<double>, w double").repartition(3)
    got = {(r["g"], r["i"], r["j"]): r["m"] for r in vector.moments(df, "g").collect()}
    for g in (0, 1):
        at = np.arange(20) % 2 == g
        want = (x[at] * np.arange(20)[at, None]).T @ y[at]
        assert all(got[g, i, j] == pytest.approx(want[i, j]) for i in range(3) for j in range(2))


@pytest.mark.parametrize("limit", [64 << 20, 400])
def test_gene_pair_counts(spark, limit):
    x = rng.normal(size=(30, 4))
    emb = frame(spark, x)
    members = spark.createDataFrame([(i, f"t{i % 4}") for i in range(28)] + [(3, "t0"), (3, "t3")], "gene long, term string")
    terms = collections.defaultdict(set)
    for r in members.collect():
        terms[r["gene"]].add(r["term"])
    unit = procrustes.unit(x)
    want = collections.Counter((round(float(unit[i] @ unit[j]), 2) + 0.0, int(bool(terms[i] & terms[j]))) for i in terms for j in terms if i < j)
    got = {(r["score"], r["y"]): r["n"] for r in evaluation.gene_pair_counts(emb, members, digits=2, block_bytes=limit).collect()}
    assert got == want


def test_hubs_of_the_set_join(spark):
    members = [(g, 0) for g in range(400)] + [(g, 1 + g % 7) for g in range(400)]
    df = spark.createDataFrame(members, "gene long, el long")
    got = {(r["i"], r["j"]): r["inter"] for r in graph.set_jaccard_self(df).collect()}
    assert len(got) == 400 * 399 // 2 and all(n == 1 + (i % 7 == j % 7) for (i, j), n in got.items())


def test_cross_validation_trains_on_the_other_folds(spark):
    x = rng.normal(size=(120, 3))
    rows = [(i, c, int((x[i, c] > 0)), x[i].tolist(), i % 3) for i in range(120) for c in range(2)]
    df = spark.createDataFrame(rows, "id long, class int, y int, x array<double>, part int")
    out = ml.cross_validated(df, "part").collect()
    assert sorted((r["fold"], r["n_test"]) for r in out) == [(0, 40), (1, 40), (2, 40)] and all(r["f1_micro"] > 0.9 for r in out)
    scored = {(r["fold"], r["class"], r["id"]): r["score"] for r in ml.fold_scores(df, "part").collect()}
    train = np.arange(120) % 3 != 1
    w = ml.fit_logistic(x[train], (x[train, 0] > 0).astype(float))
    assert all(scored[1, 0, i] == pytest.approx(1 / (1 + np.exp(-(x[i] @ w[:-1] + w[-1])))) for i in range(1, 120, 3))
    moved = ml.term_transfer(df.withColumnRenamed("part", "species")).collect()
    assert all(r["n_terms"] == 2 and r["fmax"] > 0.9 for r in moved)


def test_small_rules(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "a"), (1, "b"), (2, "b")], "cluster int, og string")
    assert {(r["og"], r["cluster"], r["n"], round(r["share"], 3)) for r in ml.dominant_cluster(df, "og").collect()} == {("a", 0, 2, 0.667), ("b", 1, 1, 0.5)}
    present = spark.createDataFrame([(1, 5), (2, 5)], "species int, og int")
    assert species.checked_seeds(present, [1, 2]) == [1, 2]
    with pytest.raises(ValueError, match="7"):
        species.checked_seeds(present, [1, 7])
    labels = spark.createDataFrame([("Nucleus",), ("Elsewhere",)], "label string")
    assert [r["label"] for r in ml.known_compartments(labels).collect()] == ["Nucleus"]


def test_shuffled_vectors_are_a_permutation(spark):
    x = rng.normal(size=(40, 3))
    got = {r["id"]: tuple(np.round(r["v"], 9)) for r in retrieval.shuffled_vectors(frame(spark, x), 0).collect()}
    assert sorted(got) == list(range(40)) and sorted(got.values()) == sorted(tuple(np.round(v, 9)) for v in x) and got[0] != tuple(np.round(x[0], 9)) or got[1] != tuple(np.round(x[1], 9))


@pytest.mark.parametrize("vanilla", [False, True])
def test_refinement_with_orthogroups_needs_no_pairs(spark, vanilla):
    """All pairs of an orthogroup as anchors: the same map with and without rows for them, in a task, on the driver and by tables."""
    from orthoweave.operators import orthologs

    rng = np.random.default_rng(8)
    r = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = rng.normal(size=(80, 6))
    y = x @ r + 0.05 * rng.normal(size=x.shape)
    rows = lambda s, m, at: [(s, at + i, at + i, None if i % 9 == 0 else f"g{i % 20}", v.tolist()) for i, v in enumerate(m)]
    emb = spark.createDataFrame(rows(0, y, 0) + rows(1, x, 1000) + rows(2, x @ r.T + 0.01, 2000), "species int, id long, idx long, og string, v array<float>").cache()
    a, b = emb.filter("species = 1"), emb.filter("species = 0")
    options = {"threshold": 0.0, "k": 3, "vanilla": vanilla}
    every = lambda s, t: orthologs.weighted_pairs(emb.filter(f"species = {s}"), emb.filter(f"species = {t}")).select(F.lit(s).alias("sp_src"), F.lit(t).alias("sp_ref"), F.col("ia").alias("src"), F.col("ib").alias("ref"), "w")
    want, log = procrustes.refine(every(1, 0).select("src", "ref", "w"), a.select("id", "v"), b.select("id", "v"), **options)
    assert log[0]["new"] > 0
    for held in (64 << 20, 0):
        rot, again = procrustes.refine_orthogroups(a, b, held_bytes=held, **options)
        assert np.allclose(rot.r, want.r, atol=1e-5) and [e["new"] for e in again] == [e["new"] for e in log]
    groups = spark.createDataFrame([(2, 0)], "species int, seed int")
    pairs = every(1, 0).unionByName(every(2, 0))
    kw = {"refinement": {"threshold": 0.0, "k": 3}, "vanilla": vanilla, "center": True, "scale": True}
    vectors = lambda df: np.array([row["v"] for row in df.orderBy("species", "id").collect()])
    plain = vectors(procrustes.two_stage(emb.drop("og"), pairs, 0, [0, 1], groups, **kw))
    for genes in (200_000, 10):
        assert np.allclose(vectors(procrustes.two_stage(emb, None, 0, [0, 1], groups, local_genes=genes, **kw)), plain, atol=1e-4)


def test_robustness_makes_no_row_for_a_trial(spark, monkeypatch):
    """Shares as a full sort would give them; fits and correlations as of plain loops, though no pair is stored with vectors or ranked as a row, in many cells."""
    import hashlib

    from orthoweave.operators import stats

    n, d = 40, 4
    x, y = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    anchors = [(i, j, 1.0 + (i + j) % 3) for i in range(n) for j in range(n) if i % 4 == j % 4]
    pairs = spark.createDataFrame(anchors, "src long, ref long, w double")
    order = {rep: sorted(anchors, key=lambda p: (hashlib.md5(f"{p[0]}:{p[1]}:{rep}".encode()).hexdigest(), f"{p[0]}:{p[1]}")) for rep in range(2)}
    assert sorted(tuple(r) for r in procrustes.subsampled(pairs, 0.3, 1).collect()) == sorted(order[1][:120])
    assert procrustes.subsampled(pairs, 1.0, 0).count() == 400
    truth = [(j, i, float((i * j) % 5)) for i in range(n + 3) for j in range(n) if (i + j) % 3]
    cells = vector.pair_cells
    monkeypatch.setattr(vector, "pair_cells", lambda p, a, b: cells(p, a, b, block=9, most=30))
    monkeypatch.setattr(procrustes, "stored", None)
    monkeypatch.setattr(stats, "spearman_by", None)
    out = procrustes.anchor_robustness(pairs, frame(spark, x), frame(spark, y), spark.createDataFrame(truth, "u long, v long, s double"), rates=(0.25, 1.0, 0.003), replicates=2, center=True).collect()
    assert sorted((r["rate"], r["n_anchors"]) for r in out) == [(0.003, 2)] * 2 + [(0.25, 100)] * 2 + [(1.0, 400)] * 2
    known = [t for t in truth if t[1] < n]

    def ranks(v):
        _, of, c = np.unique(v, return_inverse=True, return_counts=True)
        return (c.cumsum() - (c - 1) / 2)[of]

    for r in out:
        i, j, w = (np.array(c) for c in zip(*order[r["replicate"]][: r["n_anchors"]], strict=True))
        rot = procrustes.solve(procrustes.Sums.of(x[i], y[j], w), center=True)
        cos = (procrustes.unit(rot.apply(x))[[t[1] for t in known]] * procrustes.unit(y)[[t[0] for t in known]]).sum(1)
        want = np.corrcoef(ranks(np.round(cos, 9)), ranks(np.array([t[2] for t in known])))[0, 1]
        assert r["n_anchors"] == 2 or r["rho"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"carried": 3, "hub": 10}, {"carried": 3, "hub": 10, "parts": 3}])
def test_set_join_shuffles_no_pair(spark, options):
    """Equal to plain loops, with sets too large to carry, elements of many sets and nulls; between carried sets a pair is neither grouped nor shuffled."""
    own = np.random.default_rng(5)
    members = sorted({(int(g), int(e)) for g, e in zip(own.integers(0, 60, 260), own.integers(0, 40, 260), strict=True)} | {(g, 7) for g in range(30)})
    df = spark.createDataFrame([*members, (3, None), (70, None)], "gene long, el long").repartition(3)
    sets, n = collections.defaultdict(set), collections.Counter(g for g, _ in members)
    n[3] += 1
    for g, e in members:
        sets[g].add(e)
    want = {(i, j): (len(sets[i] & sets[j]), len(sets[i] & sets[j]) / (n[i] + n[j] - len(sets[i] & sets[j]))) for i in sets for j in sets if i < j and sets[i] & sets[j]}
    out = graph.set_jaccard_self(df, **options)
    got = {(r["i"], r["j"]): (r["inter"], r["jaccard"]) for r in out.collect()}
    assert out.count() == len(want) and got == {k: (c, pytest.approx(s)) for k, (c, s) in want.items()}
    if not options:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Join")[0]
