"""Operators whose work is spread so that no class, group, hub or score bucket fills a task, against plain loops."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.operators import curves, evaluation, logistic, ml, ordered, procrustes, ranked, retrieval, stats, vector, walks

rng = np.random.default_rng(23)


# ---- logistic regression ------------------------------------------------------------------------


@pytest.mark.parametrize("held", [256 << 20, 1])
def test_all_fits_equal_the_plain_ones(spark, held):
    n, d = 240, 4
    x = rng.normal(size=(n, d))
    fold = rng.integers(0, 3, n)
    y = {0: x[:, 0] > 0.2, 1: x @ [1, -1, 0, 2] + rng.normal(size=n) > 1.5, 2: np.zeros(n, bool), 3: fold == 1, 4: np.ones(n, bool)}
    rows = [(i, int(fold[i]), x[i].tolist(), [(c, float(v[i])) for c, v in y.items() if not (c == 1 and i % 7 == 0)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold int, x array<double>, labels array<struct<class:int,y:double>>").repartition(5)
    found = logistic.fits(df, [0, 1, 2], c=0.7, held_bytes=held)
    assert found.constants == {(f, c): v for f in range(3) for c, v in ((2, 0.0), (4, 1.0))} | {(1, 3): 0.0}
    for (f, c), w in found.weights.items():
        use = (fold != f) & ((np.arange(n) % 7 != 0) | (c != 1))
        assert np.abs(w - ml.fit_logistic(x[use], y[c][use].astype(float), 0.7)).max() < 1e-6
    assert len(found.weights) == 8
    got = {(r["id"], r["class"]): r["score"] for r in logistic.scores(df, found).collect()}
    assert len(got) == sum(len(r[3]) for r in rows)
    for i in (0, 1, 50):
        w = found.weights[fold[i], 0]
        assert got[i, 0] == pytest.approx(1 / (1 + np.exp(-(x[i] @ w[:-1] + w[-1]))))
    assert all(r["residual"] < 1e-6 for r in logistic.residuals(df, found, 0.7).collect())


def test_one_vs_rest_without_some_classes(spark):
    train = spark.createDataFrame([(0, 1, [1.0]), (0, 0, [-1.0]), (1, 1, [2.0])], "class int, y int, x array<double>")
    test = spark.createDataFrame([(c, "g", [0.5]) for c in range(3)], "class int, id string, x array<double>")
    got = {r["class"]: r["score"] for r in ml.one_vs_rest(train, test).collect()}
    assert got[0] > 0.5 and got[1] == 1.0 and got[2] == 0.0
    assert ml.one_vs_rest(train, test.limit(0)).count() == 0


# ---- sums and ranks by group --------------------------------------------------------------------


def test_groups_span_partitions(spark):
    rows = [(g, float(v), int(rng.integers(1, 5))) for g, n in ((None, 5), ("a", 300), ("b", 1), ("c", 80)) for v in rng.permutation(n)]
    df = spark.createDataFrame(rows, "g string, v double, k int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["v"]): r["below_k"] for r in ordered.sums_below(df, "v", ["k"], "g").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, v, _ in rows:
        assert got[g, v] == sum(k for h, u, k in rows if h == g and u < v)


def test_rank_correlation_and_curves_by_group(spark):
    rows = [(g, float(rng.integers(0, 9)), float(rng.integers(0, 9)), int(rng.integers(0, 2))) for g, n in (("a", 60), ("b", 12)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double, t int")
    rho = {r["g"]: r["rho"] for r in stats.spearman_by(df, "x", "y", "g").collect()}
    auc = {r["g"]: r["auc"] for r in curves.roc_auc(df.select("g", F.col("x").alias("score"), F.col("t").alias("y")), "g").collect()}
    for g in ("a", "b"):
        mine = [r for r in rows if r[0] == g]
        rank = lambda v: np.array([sum(o < t for o in v) + (sum(o == t for o in v) + 1) / 2 for t in v])
        assert rho[g] == pytest.approx(np.corrcoef(rank([r[1] for r in mine]), rank([r[2] for r in mine]))[0, 1])
        p, n = [r[1] for r in mine if r[3]], [r[1] for r in mine if not r[3]]
        assert auc[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))


# ---- pathway ROC --------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"bits": 3, "slab_bytes": 200}, {"block_bytes": 400, "digits": 2, "bits": 4}])
def test_pathway_area_is_exact(spark, options):
    n, d = 40, 3
    x = np.round(rng.normal(size=(n, d)), 1) + 0.05
    terms = [(i, f"t{t}") for i in range(n) for t in {int(v) for v in rng.integers(0, 6, 2)} if i % 9]
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = evaluation.pathway_auc(emb, spark.createDataFrame(terms, "gene long, term string"), **options).first()
    of = collections.defaultdict(set)
    for i, t in terms:
        of[i].add(t)
    s = np.round(procrustes.unit(x) @ procrustes.unit(x).T, options.get("digits", 9)) + 0.0
    p, q = ([s[i, j] for i in of for j in of if i < j and bool(of[i] & of[j]) == want] for want in (True, False))
    assert (got["n_pos"], got["n_neg"]) == (len(p), len(q))
    assert got["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in q]), abs=1e-12)


@pytest.mark.parametrize(("places", "options"), [(6, {"slab_bytes": 200}), (1, {"digits": 4}), (4, {"digits": 4, "block_bytes": 400})])
def test_pathway_area_is_sure_to_some_decimals(spark, places, options):
    """Few digits suffice for a few decimals, and where they do not all are taken; packs follow from the codes, not from the pairs."""
    x = np.round(rng.normal(size=(40, 3)), 1) + 0.05
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    members = spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)], "gene long, term string")
    want = evaluation.pathway_auc(emb, members, digits=options.get("digits", 9)).first()
    got = evaluation.pathway_auc(emb, members, places=places, **options).first()
    assert (round(got["auc"], places), got["n_pos"], got["n_neg"]) == (round(want["auc"], places), want["n_pos"], want["n_neg"])


def test_what_a_task_packs_does_not_grow_with_its_scores():
    codes, local = ranked.Codes(3, 4, 2), np.random.default_rng(1)
    size = []
    for slabs, wide in ((4, 1 << 26), (40, 1 << 26), (80, 0)):
        tally, packs = ranked.Tally(codes, wide), []
        for _ in range(slabs):
            packs += tally.add(codes.keys(local.uniform(-1, 1, 20_000), local.integers(0, 2, 20_000)))
        assert bool(packs) == (wide == 0)  # a byte holds no count above 255
        packs += tally.packed()
        assert sum(ranked.grown(c, n, 4).sum() for b in packs for n, c in zip(b.column("n").to_pylist(), b.column("counts").to_pylist(), strict=True)) == 20_000 * slabs
        size.append(sum(b.num_rows for b in packs))
    assert size[0] == size[1]


def test_pathway_area_without_both_labels(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    row = evaluation.pathway_auc(emb, spark.createDataFrame([(0, "a"), (1, "b")], "gene long, term string")).first()
    assert (row["auc"], row["n_pos"], row["n_neg"]) == (None, 0, 1)


def test_pathway_pairs_are_made_once(spark):
    """The jobs, each of which passed over all pairs, do not grow with the pairs that a slab cannot hold."""
    emb = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "id long, v array<double>")
    members = spark.createDataFrame([(i, f"t{i % 4}") for i in range(60)], "gene long, term string")
    jobs = []
    for slab in (1 << 20, 400):
        spark.sparkContext.setJobGroup(f"slab-{slab}", "")
        evaluation.pathway_auc(emb, members, slab_bytes=slab).first()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"slab-{slab}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[0]


@pytest.mark.parametrize(("digits", "bits", "n"), [(9, 9, 3000), (3, 4, 3000), (6, 1, 3_000_000)])
def test_packed_rank_sums_equal_plain_ranks(spark, digits, bits, n):
    codes = ranked.Codes(digits, bits, 3)
    weights = np.array([-1.0, 0.5, 2.0])

    def run(batches):
        for b in batches:
            for g in b.column(0).to_pylist():
                own = np.random.default_rng(g % 2)
                score, level = np.round(own.uniform(-1, 1, n), digits), own.integers(0, 3, n)
                for at in np.array_split(np.arange(n), 4):
                    yield from ranked.packed(codes.keys(score[at], level[at]), codes, g)

    got = ranked.sums(spark.range(2).repartition(2).mapInArrow(run, ranked.PACKED), codes, weights)
    for g in (0, 1):
        own = np.random.default_rng(g)
        score, w = np.round(own.uniform(-1, 1, n), digits), weights[own.integers(0, 3, n)]
        _, of, c = np.unique(score, return_inverse=True, return_counts=True)
        rank = (c.cumsum() - c + (c + 1) / 2)[of]
        t = got[g]
        assert (t.n, t.weight, t.by_rank, t.squares) == pytest.approx((n, w.sum(), w @ rank, rank @ rank), rel=1e-12, abs=1e-3)
        assert ranked.correlation(ranked.Ranked(n, 0.0, t.by_rank - w.mean() * rank.sum(), t.squares, []), n * w.var()) == pytest.approx(np.corrcoef(w, rank)[0, 1], abs=1e-9)


# ---- orthogroups --------------------------------------------------------------------------------


@pytest.mark.parametrize("vanilla", [False, True])
def test_orthogroup_sums_equal_sums_over_pairs(spark, vanilla):
    d = 3
    make = lambda n: [(int(rng.integers(0, 2)), None if i % 11 == 0 else int(rng.integers(0, 7)), rng.normal(size=d).tolist()) for i in range(n)]
    a, b = make(50), make(40)
    fa, fb = (spark.createDataFrame(t, "sp int, og int, v array<double>") for t in (a, b))
    got = procrustes.orthogroup_sums(fa, fb, "sp", vanilla)
    for sp in (0, 1):
        x, y, w = [], [], []
        for s, g, u in a:
            for t, h, v in b:
                if s == t == sp and g is not None and g == h:
                    x.append(u), y.append(v)
                    w.append(1.0 if vanilla else 1 / (sum(r[:2] == (s, g) for r in a) * sum(r[:2] == (s, g) for r in b)))
        want = procrustes.Sums.of(np.array(x), np.array(y), np.array(w))
        assert got[sp].n == want.n and all(np.allclose(getattr(got[sp], f), getattr(want, f)) for f in ("w", "sx", "sy", "m", "xx"))


@pytest.mark.parametrize(("block", "bits"), [(1024, 10), (4, 2)])
def test_orthogroup_cosines_in_blocks(spark, block, bits):
    n = 60
    rows = [(i, int(rng.integers(0, 3)), int(i % 4) if i % 13 else 9, rng.normal(size=3).tolist()) for i in range(n)]
    got = {r["og"]: r for r in vector.group_cosines(spark.createDataFrame(rows, "id long, species int, og int, v array<double>"), block=block, bits=bits).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    for og, mine in by.items():
        c = [(procrustes.unit(np.array([a[3]])) @ procrustes.unit(np.array([b[3]])).T).item() for a in mine for b in mine if a[0] < b[0] and a[1] != b[1]]
        if len({r[1] for r in mine}) < 2:
            assert og not in got
            continue
        r = got[og]
        assert (r["n_pairs"], r["size"]) == (len(c), len(mine))
        assert (r["mean_cos"], r["median_cos"], r["min_cos"]) == pytest.approx((np.mean(c), np.median(c), min(c)), abs=1e-6)


# ---- walks and skip-gram ------------------------------------------------------------------------


def test_alias_table():
    w = rng.random(30) ** 3
    prob, other = walks.alias_table(w)
    share = prob.copy()
    np.add.at(share, other, 1 - prob)
    assert np.allclose(share / 30, w / w.sum())


def graph(n, share):
    return [(i, j, float(rng.integers(1, 5))) for i in range(n) for j in range(i + 1, n) if rng.random() < share]


def test_both_ways_of_walking_agree(spark):
    df = spark.createDataFrame([*graph(10, 0.4), (None, 1, 1.0), (2, 3, 0.0)], "a long, b long, w double")
    one, two = ({r["walk"]: r["nodes"] for r in walks.biased_walks(df, walks=2, length=6, p=0.5, q=2.0, part=2, held_edges=h).collect()} for h in (10**6, 0))
    assert one == two and len(one) == 20 and {len(x) for x in one.values()} == {6}


@pytest.mark.parametrize(("p", "q"), [(0.5, 2.0), (1.0, 0.7), (3.0, 0.4), (0.2, 1.0)])
def test_walkers_that_move_between_blocks_walk_the_same(spark, p, q):
    df = spark.createDataFrame([*graph(14, 0.5), (20, 21, 1.0)], "a long, b long, w double")
    ways = ({"held_edges": 10**6}, {"held_edges": 0}, {"held_edges": 0, "block_edges": 6})
    got = [{r["walk"]: r["nodes"] for r in walks.biased_walks(df, walks=3, length=9, p=p, q=q, part=4, **way).collect()} for way in ways]
    assert all(g == got[0] for g in got) and {len(x) for x in got[0].values()} == {9}


def test_steps_follow_the_second_order_distribution(spark):
    edges = graph(9, 0.5)
    p, q = 0.5, 2.0
    near = collections.defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    names = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in edges], "a string, b string, w double")
    seen = collections.Counter()
    for r in walks.biased_walks(names, walks=2000, length=6, p=p, q=q, part=3).collect():
        nodes = [int(x[1:]) for x in r["nodes"]]
        seen.update(zip(nodes, nodes[1:], nodes[2:], strict=False))
    total = collections.Counter()
    for (a, b, _), k in seen.items():
        total[a, b] += k
    for (a, b), k in total.items():
        weigh = {c: w * (1 / p if c == a else 1.0 if c in near[a] else 1 / q) for c, w in near[b].items()}
        for c, w in weigh.items():
            share = w / sum(weigh.values())
            assert abs(seen[a, b, c] - k * share) <= 5 * (k * share * (1 - share)) ** 0.5 + 1e-6


def test_parts_of_a_hub_are_small(spark):
    star = spark.range(1, 3001).select(F.lit(0).cast("long").alias("cur"), F.col("id").alias("nxt"), F.lit(1.0).alias("w"))
    slots, nodes = walks.alias_rows(star, part=100)
    assert slots.count() == 3000 and slots.groupBy("cur", "part").count().agg(F.max("count")).first()[0] < 200
    assert len(nodes.first()["parts"]) == 30


def test_window_pairs_of_many_walks_at_once():
    import pyarrow as pa

    t = [[5, 6, 7, 8], [], [1], [2, 3]]
    w, i, j = walks._window_pairs(pa.array([11, 12, 13, 14]), pa.array(t, pa.list_(pa.int64())), 3, 42)
    want = [(k, x[s], x[o]) for k, x in zip((11, 12, 13, 14), t, strict=True) for s in range(len(x)) for o in range(len(x)) if 0 < abs(s - o) <= 1 + np.floor(walks.uniforms(42, 3, k, s) * 3)[0]]
    assert sorted(zip(w, i, j, strict=True)) == sorted(want)


def test_joined_walks_serve_hubs(spark):
    df = spark.createDataFrame(graph(8, 0.5), "a long, b long, w double")
    one, two = ({r["walk"]: r["nodes"] for r in walks.biased_walks(df, walks=1, length=4, part=2, **way).collect()} for way in ({}, {"held_edges": 0, "hub_edges": 0}))
    assert one == two


@pytest.mark.parametrize("options", [{}, {"block_nodes": 30, "cell_pairs": 8000, "epochs": 8}])
def test_skip_gram_recovers_planted_communities(spark, options):
    local = np.random.default_rng(3)
    edges = [(i, j, 1.0) for i in range(60) for j in range(i + 1, 60) if local.random() < (0.5 if i // 20 == j // 20 else 0.01)]
    w = walks.biased_walks(spark.createDataFrame(edges, "a long, b long, w double"), walks=10, length=20).cache()
    fit = lambda: {r["gene"]: r["v"] for r in walks.skip_gram(w, **{"dim": 16, "epochs": 5, "rate": 0.05} | options).collect()}
    v = fit()
    m = procrustes.unit(np.array([v[i] for i in range(60)]))
    s, same = m @ m.T, np.arange(60)[:, None] // 20 == np.arange(60)[None, :] // 20
    best = np.argsort(-(s - 2 * np.eye(60)), 1)[:, :5]
    assert np.mean([same[i, best[i]].mean() for i in range(60)]) > 0.9
    if not options:
        again = fit()
        assert all(v[g] == again[g] for g in v)


def test_a_batch_is_the_sum_over_its_pairs():
    """Tokens are read and added to once a chunk, whatever their pairs; the step is that of all pairs one by one."""
    import pyarrow as pa

    local = np.random.default_rng(4)
    t = pa.array([local.integers(0, 24, 30).tolist() for _ in range(3)], pa.list_(pa.int64()))
    w, token, s, other, one, two = walks._window_places(pa.array([5, 6, 7]), t, 4, 42, 2, 0, 1)
    ci, xi = token[s] // 2, token[other] // 2
    a, b, weight = local.normal(size=(12, 5)), local.normal(size=(12, 5)), np.ones(12)
    x, y = a.copy(), b.copy()
    walks._train(ci, xi, (one, two), x, y, weight, 0.1, 5, 9, shared=8, chunk=len(ci))
    neg = np.minimum((walks.uniforms(9, 7, np.arange(8), 0) * 12).astype(int), 11)
    p, q, sig = a.copy(), b.copy(), lambda v: 1 / (1 + np.exp(-v))
    assert len(one) > 40 and (ci[one] * 2 == token[s[one]]).all()
    for i, j in zip(ci[one], xi[two], strict=True):
        p[i] += 0.1 * (1 - sig(a[i] @ b[j])) * b[j]
        q[j] += 0.1 * (1 - sig(a[i] @ b[j])) * a[i]
        for k in neg[neg != j]:
            p[i] -= 0.1 * 5 / 8 * sig(a[i] @ b[k]) * b[k]
            q[k] -= 0.1 * 5 / 8 * sig(a[i] @ b[k]) * a[i]
    assert np.allclose(x, p) and np.allclose(y, q)


@pytest.mark.parametrize(("na", "nb", "k", "block"), [(60, 45, 3, 20), (5, 30, 10, 8), (300, 700, 2, 1000)])
def test_neighbours_both_ways_from_one_product(spark, na, nb, k, block):
    """Equal to plain loops, with ties, in cells and in strips of a cell; of unequal rounding in single precision nothing is lost."""
    local = np.random.default_rng(6)
    x, y = local.normal(size=(na, 5)), local.normal(size=(nb, 5))
    y[3] = y[4] = x[1]
    x[2] = x[1] + 1e-8
    frame = lambda m, at: spark.createDataFrame([(at + i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in vector.nearest_cells(frame(x, 0), frame(y, 1000), k, block).orderBy("side", "q", "rank").collect():
        got[r["side"], r["q"]].append((r["nbr"], r["sim"]))
    sim = np.round(procrustes.unit(x) @ procrustes.unit(y).T, 9)
    want = {(0, i): sorted(((1000 + j, sim[i, j]) for j in range(nb)), key=lambda t: (-t[1], t[0]))[:k] for i in range(na)}
    want |= {(1, 1000 + j): sorted(((i, sim[i, j]) for i in range(na)), key=lambda t: (-t[1], t[0]))[:k] for j in range(nb)}
    assert dict(got) == {key: [(n, pytest.approx(s, abs=1.1e-9)) for n, s in v] for key, v in want.items()}
    for rows, columns in ((7, 50), (128, 8192)):
        one, two = vector.best_each_way(procrustes.unit(x), procrustes.unit(y), k, rows, columns)
        assert [(i, 1000 + j) for i, j in zip(one[0], one[1], strict=True)] == [(i, n) for i in range(na) for n, _ in want[0, i]]
        assert [(j, i) for j, i in zip(two[0], two[1], strict=True)] == [(j, n) for j in range(nb) for n, _ in want[1, 1000 + j]]


def test_refinement_by_tables_searches_once_for_both_ways(spark, monkeypatch):
    local = np.random.default_rng(7)
    x = local.normal(size=(50, 4))
    y = x @ np.linalg.qr(local.normal(size=(4, 4)))[0] + 0.05 * local.normal(size=x.shape)
    side = lambda m, at: spark.createDataFrame([(f"g{i % 10}", at + i, v.tolist()) for i, v in enumerate(m)], "og string, id long, v array<float>")
    want, log = procrustes.refine_orthogroups(side(x, 0), side(y, 1000), threshold=0.0, k=3)
    monkeypatch.setattr(vector, "knn", None)
    rot, again = procrustes.refine_orthogroups(side(x, 0), side(y, 1000), held_bytes=0, threshold=0.0, k=3)
    assert np.allclose(rot.r, want.r, atol=1e-5) and [e["new"] for e in again] == [e["new"] for e in log]


@pytest.mark.parametrize("sizes", [{}, {"bin_pairs": 50, "cell": 7, "cell_pairs": 20}])
def test_dealt_pairs_are_no_rows(spark, monkeypatch, sizes):
    """Equal to plain loops and to pairs as rows, in one bin and cell and in many; no pair is placed as a row."""
    import hashlib

    local = np.random.default_rng(11)
    x, y = local.normal(size=(40, 3)), local.normal(size=(50, 3))
    truth = [(2 * i, 2 * j + 1, float(local.integers(1, 5)) / 4) for i in range(40) for j in range(50) if (i + j) % 3 == 0]
    frame = lambda m, odd: spark.createDataFrame([(2 * i + odd, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    pairs = spark.createDataFrame(truth, "u long, v long, s double").repartition(5).cache()

    def ranks(v):
        _, of, c = np.unique(v, return_inverse=True, return_counts=True)
        return (c.cumsum() - (c - 1) / 2)[of]

    s = ranks(np.array([t[2] for t in truth]))
    cos = lambda u, v: np.round((procrustes.unit(x)[np.array(u) // 2] * procrustes.unit(y)[np.array(v) // 2]).sum(1), 9)
    dealt = [t[1] for t in sorted(truth, key=lambda t: (hashlib.md5(f"{t[0]}_{t[1]}:1".encode()).hexdigest(), f"{t[0]}_{t[1]}"))]
    u, v = [t[0] for t in truth], [t[1] for t in truth]  # in order
    want = [np.corrcoef(ranks(cos(u, w)), s)[0, 1] for w in (v, dealt)]
    rows = retrieval.jaccard_spearman(pairs, frame(x, 0), frame(y, 1), 1, most_values=0).first()
    monkeypatch.setattr(retrieval, "positions", None)
    if sizes:
        boxed = retrieval._boxed_spearman
        monkeypatch.setattr(retrieval, "_boxed_spearman", lambda *a: boxed(*a, **sizes))
    got = retrieval.jaccard_spearman(pairs, frame(x, 0), frame(y, 1), 1).first()
    assert got["n"] == rows["n"] == len(truth)
    assert [got["rho"], got["rho_shuffled"]] == pytest.approx(want, abs=1e-9) == [rows["rho"], rows["rho_shuffled"]]


# ---- exact neighbours by pivots -----------------------------------------------------------------


@pytest.mark.parametrize(("k", "block"), [(3, 7), (60, 20), (1, 1)])
def test_pivot_search_skips_cells_and_loses_no_neighbour(spark, k, block):
    centres = procrustes.unit(rng.normal(size=(6, 5)))
    make = lambda n: np.concatenate([centres[rng.integers(0, 6, n)] + 0.02 * rng.normal(size=(n, 5)), np.zeros((1, 5))])
    c, q = make(80), make(30)
    c[3] = c[4] = c[5]  # ties
    frame = lambda x, at: spark.createDataFrame([(at + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    corpus, queries = frame(c, 1000), frame(q, 0)
    got = {(r["q"], r["rank"]): (r["nbr"], r["sim"]) for r in vector.knn(queries, corpus, k, broadcast_bytes=0, block=block).collect()}
    want = {(r["q"], r["rank"]): (r["nbr"], r["sim"]) for r in vector.knn(queries, corpus, k).collect()}
    assert got == want and len(got) == 31 * min(k, 81)
    visits = vector.pivot_search(queries, corpus, k, 81, block)[1].collect()
    assert len(visits) == 31
    if k < 10:  # tight clusters: most cells cannot hold a neighbour
        assert sum(r["visited"] for r in visits) < 0.6 * sum(r["cells"] for r in visits)
    assert vector.knn(queries, corpus.limit(0), k, broadcast_bytes=-1).count() == 0


def test_a_query_goes_once_to_a_shelf_of_cells(spark, monkeypatch):
    """Stored visits are queries by shelves, however many cells there are, and shelves that are cut lose no neighbour."""
    from orthoweave.sources import shared

    rows = {}

    def counted(df, name):
        out = shared.stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(vector, "stored", counted)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(90)], "id long, v array<double>")
    for shelf in (1 << 20, 400):
        found, report = vector.pivot_search(df, df, 4, 90, 3, shelf_bytes=shelf)
        ranked_ = found.withColumn("rank", F.row_number().over(vector.Window.partitionBy("q").orderBy(F.desc("sim"), "nbr"))).filter("rank <= 4")
        want = vector.knn(df, df, 4).select("q", "nbr", "sim", "rank")
        assert sorted(map(tuple, ranked_.select("q", "nbr", "sim", "rank").collect())) == sorted(map(tuple, want.collect()))
        if shelf > 400:
            assert rows["pivot-first-visits"] == 90 and rows["pivot-visits"] <= 90
            assert report.agg(F.sum("visited")).first()[0] > rows["pivot-first-visits"] + rows["pivot-visits"]


def test_rank_correlation_of_pairs_in_cells(spark, monkeypatch):
    """Equal to that of joined pairs by group, in many cells and slices; no vector is joined to a pair."""
    from orthoweave.operators import retrieval

    emb = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "id long, v array<double>")
    rows = sorted({(int(g), int(u), int(v), float(rng.integers(1, 6)) / 7) for g, u, v in zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), rng.integers(0, 40, 300), strict=True)})
    rows = [r for i, r in enumerate(rows) if not i or rows[i - 1][:3] != r[:3]]
    pairs = spark.createDataFrame(rows, "grp int, u long, v long, s double")
    cos = vector.pair_cosine(pairs.select("u", "v").distinct(), emb, emb).withColumn("cos", F.round("cos", 9))
    want = {r["grp"]: (r["n"], r["rho"]) for r in stats.spearman_by(pairs.join(cos, ["u", "v"]), "s", "cos", "grp").collect()}
    cells = vector.pair_cells
    monkeypatch.setattr(vector, "pair_cells", lambda p, a, b: cells(p, a, b, block=9, most=5))
    fewer = emb.filter("id < 30")
    joined = pairs.filter("u < 30 and v < 30").join(cos, ["u", "v"])
    less = {r["grp"]: (r["n"], r["rho"]) for r in stats.spearman_by(joined, "s", "cos", "grp").collect()}
    assert {g: pytest.approx(t) for g, t in less.items()} == retrieval.cosine_ranks(pairs, fewer, fewer)
    monkeypatch.setattr(vector, "pair_cosine", None)
    assert {g: pytest.approx(t) for g, t in want.items()} == retrieval.cosine_ranks(pairs, emb, emb)


# ---- contrastive encoders, mini-batch k-means, incremental outputs ------------------------------


def test_encoders_recover_a_planted_rotation(spark):
    from orthoweave.operators import contrastive

    d, n = 4, 150
    turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
    y = rng.normal(size=(n, d))
    rows = [(s, i, i, ((v - s) @ turn.T).tolist(), v.tolist(), 1.0 + i % 2) for s in (0, 1) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "species int, src long, ref long, x array<double>, y array<double>, w double").repartition(3)
    options = {"rate": 0.1, "steps": 120, "batch": 0.5, "patience": 200}
    found, losses = contrastive.train_encoders(df, **options)
    assert np.mean(losses[-5:]) < 0.7 * losses[0]
    for s, e in found.items():
        assert np.abs(e.a - turn).max() < 0.15 and np.abs(e.apply((y - s) @ turn.T) - y).mean() < 0.1
    again, _ = contrastive.train_encoders(df, **options)
    assert all(np.allclose(again[s].a, found[s].a, atol=1e-9) for s in found)


def test_gradient_of_the_margin_loss():
    from orthoweave.operators.contrastive import Encoder, loss_and_gradient

    x, y, w = rng.normal(size=(7, 3)), rng.normal(size=(7, 2)), rng.random(7)
    e = Encoder(rng.normal(size=(3, 2)), rng.normal(size=2))
    loss, ga, gb = loss_and_gradient(e, x, y, w, 0.3)
    assert loss == pytest.approx(sum(-b * np.log(1 / (1 + np.exp(-(0.3 - np.linalg.norm(d))))) for b, d in zip(w, e.apply(x) - y, strict=True)))
    h = 1e-6
    for i in range(3):
        for j in range(2):
            a = e.a.copy()
            a[i, j] += h
            assert (loss_and_gradient(Encoder(a, e.b), x, y, w, 0.3)[0] - loss) / h == pytest.approx(ga[i, j], rel=1e-3, abs=1e-5)
    assert gb == pytest.approx([(loss_and_gradient(Encoder(e.a, e.b + h * np.eye(2)[j]), x, y, w, 0.3)[0] - loss) / h for j in range(2)], rel=1e-3, abs=1e-5)


def test_clusters_find_planted_centres(spark):
    planted = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0], [8.0, 8.0], [4.0, 20.0]])
    at = rng.integers(0, 5, 400)
    rows = [(i, (planted[c] + 0.3 * rng.normal(size=2)).tolist(), int(c)) for i, c in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, x array<double>, true int").repartition(4)
    got = ml.clusters(df, 5, batch_rows=100).collect()
    names = collections.defaultdict(set)
    for r in got:
        names[r["true"]].add(r["cluster"])
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == 5
    assert sorted(got) == sorted(ml.clusters(df, 5, batch_rows=100).collect())
    assert ml.clusters(df.limit(0), 5).count() == 0 and {r["cluster"] for r in ml.clusters(df.limit(1), 5).collect()} == {0}


def test_outputs_count_when_committed(spark, tmp_path):
    from orthoweave.sources import manifest

    root = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(k, i) for k in ("a", "b", "c") for i in range(3)], "k string, v int")
    assert manifest.committed(spark, root, df.schema, "k").count() == 0
    assert manifest.materialise(df.filter("k = 'a'"), root, "k") == 1
    df.write.parquet(f"{root}/data/killed")  # written, never committed
    assert sorted(tuple(r) for r in manifest.committed(spark, root, df.schema, "k").collect()) == [("a", i) for i in range(3)]
    assert manifest.materialise(df.withColumn("v", F.col("v") + 10), root, "k") == 2
    assert sorted(tuple(r) for r in manifest.committed(spark, root, df.schema, "k").collect()) == [("a", i) for i in range(3)] + [(k, 10 + i) for k in "bc" for i in range(3)]
    assert manifest.materialise(df, root, "k") == 0 and manifest.swept(spark, root) == 1
    assert manifest.committed(spark, root, df.schema, "k").count() == 9


def test_orthogroup_pairs_meet_in_blocks(spark):
    """Weighted pairs and the contrast of cosines equal those of joined pairs, whatever the blocks; pairs come from rows dealt to more than one task a group."""
    from orthoweave.operators import graph, orthologs

    rng = np.random.default_rng(4)
    rows = lambda n, at: spark.createDataFrame([(int(i % 3) if i % 11 else None, at + i, at + i, rng.normal(size=5).tolist()) for i in range(n)], "og int, idx long, id long, v array<double>")
    a, b = rows(60, 0).cache(), rows(50, 1000).cache()
    pos = a.select(F.col("id").alias("u"), "og").join(b.select(F.col("id").alias("v"), "og"), "og").select("u", "v")
    neg = vector.pair_cosine(evaluation.hashed_pairs(a, b), a, b)
    want = evaluation.similarity_contrast(vector.pair_cosine(pos, a, b), neg).first().asDict()
    got = evaluation.orthogroup_contrast(a, b, neg, block=7).first().asDict()
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    n = {g: (a.filter(F.col("og") == g).count(), b.filter(F.col("og") == g).count()) for g in range(3)}
    pairs = orthologs.pairs(a, b).collect()
    assert sorted(map(tuple, orthologs.weighted_pairs(a, b).collect())) == sorted((r["og"], r["ia"], r["ib"], 1.0 / (n[r["og"]][0] * n[r["og"]][1])) for r in pairs)
    x, y, keys = graph.dealt_blocks(a.dropna().select(F.col("og").alias("grp"), "id"), b.dropna().select(F.col("og").alias("grp"), "id"), 7)
    assert x.select(keys).distinct().count() > 3 * 4


def test_residuals_are_summed_in_tasks(spark):
    """The gradient at any weights, as a plain sum; a row without a fold trains every fit. No coordinate of a row is a row."""
    own = np.random.default_rng(3)
    x, fold = own.normal(size=(60, 3)), [None if i % 9 == 0 else i % 2 for i in range(60)]
    y = (x[:, 0] + own.normal(size=60) > 0).astype(float)
    df = spark.createDataFrame([(i, fold[i], x[i].tolist(), [(5, float(y[i]))]) for i in range(60)], "id long, fold int, x array<double>, labels array<struct<class:int,y:double>>").repartition(4)
    found = logistic.fits(df, [0, 1])
    assert len(found.weights) == 2 and all(r["residual"] < 1e-6 for r in logistic.residuals(df, found).collect())
    found.weights = {k: w + 0.1 for k, w in found.weights.items()}
    out = logistic.residuals(df, found, 0.5)
    z = np.c_[x, np.ones(60)]
    got = {r["fold"]: r["residual"] for r in out.collect()}
    for (f, _), w in found.weights.items():
        use = np.array([g != f for g in fold])
        assert got[str(f)] == pytest.approx(np.abs(0.5 * z[use].T @ (logistic.sigmoid(z[use] @ w) - y[use]) + np.append(w[:-1], 0)).max())
