import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.functions import pvalues
from orthoweave.operators import ml, procrustes, retrieval, stats, vector, walks

rng = np.random.default_rng(5)


def rotation(d):
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    if np.linalg.det(q) < 0:
        q[:, 0] *= -1
    return q


@pytest.fixture(scope="module")
def planted(spark):
    d, n = 8, 120
    r = rotation(d)
    y = rng.normal(size=(n, d))
    x = y @ r.T
    src = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    ref = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, v array<double>")
    pairs = spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("ref"), F.lit(1.0).alias("w"))
    return r, x, y, src, ref, pairs


def test_recovers_a_planted_rotation(planted):
    r, *_, src, ref, pairs = planted
    rot = procrustes.fit(procrustes.anchors_of(pairs, src, ref))
    assert np.abs(rot.r - r).max() < 1e-5 and procrustes.orthogonality(rot) < 1e-5 and np.linalg.det(rot.r) == pytest.approx(1, abs=1e-5)


def test_equal_weights_are_no_weights(planted):
    *_, src, ref, pairs = planted
    a = procrustes.anchors_of(pairs.withColumn("w", F.lit(3.0)), src, ref)
    assert np.allclose(procrustes.fit(a).r, procrustes.fit(a, vanilla=True).r)


def test_too_few_anchors(planted):
    *_, src, ref, pairs = planted
    with pytest.raises(ValueError, match="fewer than 2"):
        procrustes.fit(procrustes.anchors_of(pairs.filter("src = 0"), src, ref))


def test_refinement_finds_the_other_pairs_and_stops(planted):
    r, *_, src, ref, pairs = planted
    rot, log = procrustes.refine(pairs.filter("src < 20"), src, ref, k=5, threshold=0.2)
    assert log[0]["new"] > 50 and np.abs(rot.r - r).max() < 1e-3
    _, log = procrustes.refine(pairs, src, ref, k=5)
    assert log == [{"round": 1, "new": 0, "moved": 0.0}]


def test_centre_and_scale(spark, planted):
    r, x, y, *_ , pairs = planted
    src = spark.createDataFrame([(i, (2 * v + 1).tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    ref = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, v array<double>")
    rot = procrustes.fit(procrustes.anchors_of(pairs, src, ref), center=True, scale=True)
    assert rot.scale == pytest.approx(0.5, abs=1e-4) and np.abs(rot.apply(2 * x + 1) - y).max() < 1e-4


def test_two_stage_reports_species_without_anchors(spark):
    rows = [(s, i, i, rng.normal(size=4).tolist()) for s in range(3) for i in range(5)]
    emb = spark.createDataFrame(rows, "species int, id long, idx long, v array<double>")
    pairs = spark.createDataFrame([(1, 0, i, i, 1.0) for i in range(5)] + [(2, 1, 0, 0, 1.0)], "sp_src int, sp_ref int, src long, ref long, w double")
    out = procrustes.two_stage(emb, pairs, 0, [0, 1], spark.createDataFrame([(2, 1)], "species int, seed int")).collect()
    assert {(r["species"], r["status"]) for r in out} == {(0, "reference"), (1, "seed"), (2, "fewer than 2 anchor pairs")}


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_knn_in_both_ways_matches_brute_force(planted, limit):
    _, x, y, src, ref, _ = planted
    got = {(r["q"], r["rank"]): r["nbr"] for r in vector.knn(src, ref, 5, broadcast_bytes=limit, block=16).collect()}
    sim = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    want = {(q, k + 1): int(n) for q in range(len(x)) for k, n in enumerate(np.lexsort((np.arange(len(y)), -np.round(sim[q], 9)))[:5])}
    assert got == want


def test_knn_clamps_k(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert vector.knn(e, e, 50).count() == 4 and vector.knn(e, e, 50, exclude_self=True).count() == 2


def test_within_metrics_do_not_change_under_rotation(spark, planted):
    _, x, _, src, ref, pairs = planted
    nbrs = spark.createDataFrame([(i, (i + 1) % 120) for i in range(120)], "gene long, nbr long")
    rot = procrustes.fit(procrustes.anchors_of(pairs, src, ref))
    a = retrieval.within(vector.knn(src, src, 10, exclude_self=True), nbrs, 10).first()
    moved = procrustes.transform(src, rot)
    b = retrieval.within(vector.knn(moved, moved, 10, exclude_self=True), nbrs, 10).first()
    assert a["precision_at_k"] == pytest.approx(b["precision_at_k"]) and a["n_eval"] == 120


def test_published_wilcoxon_p():
    assert pvalues.wilcoxon_greater(12561, 158) == pytest.approx(5.5804e-28, rel=1e-4)


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 4.0)], "x double, y double")
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(0.7378647873726218)
    w = stats.wilcoxon(df, "y", "x").first()
    assert (w["n"], w["w_plus"]) == (2, 3.0)
    assert pvalues.spearman_two_sided(0.5, 20) == pytest.approx(0.024769, rel=1e-3)


def test_logistic_separates(spark):
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] > 0).astype(float)
    w = ml.fit_logistic(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 1.0)], "a long, b long, w double")
    got = [r["nodes"] for r in walks.biased_walks(e, walks=3, length=12).collect()]
    ok = {frozenset(p) for p in ((1, 2), (2, 3), (3, 4), (1, 4))}
    assert len(got) == 12 and all(len(n) == 12 and all(frozenset(p) in ok for p in zip(n, n[1:])) for n in got)
    assert sorted(got) == sorted(r["nodes"] for r in walks.biased_walks(e, walks=3, length=12).collect())


def test_edge_stream(spark, tmp_path):
    from orthoweave.streaming import edges

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("s\td\tw\nb\ta\t1.0\na\tb\t2.0\n")
    q = edges.running_max(edges.edge_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("edge_max").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("edge_max").collect()] == [("a", "b", 2.0)]
