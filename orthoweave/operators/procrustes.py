"""Procrustes alignment: d by d sums are made by the cluster, the SVD of one small matrix a group on the driver.

Anchors are (x, y, w): source vector, reference vector, weight. Sums may be kept by group (a species each), so that any number of
species is fitted in one pass; all fits go through `solve`, with the same options.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dropped, stored
from . import vector
from .ordered import sums_below


@dataclass
class Rotation:
    """y ~ scale (x - mu_src) r + mu_ref."""

    r: np.ndarray
    mu_src: np.ndarray
    mu_ref: np.ndarray
    scale: float = 1.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.scale * (x - self.mu_src) @ self.r + self.mu_ref


@dataclass
class Sums:
    """Sums over anchors: their number, weight, weighted vectors, cross products and source norms."""

    n: int
    w: float
    sx: np.ndarray
    sy: np.ndarray
    m: np.ndarray
    xx: float

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
        return cls(len(w), float(w.sum()), w @ x, w @ y, (x * w[:, None]).T @ y, float((w * (x * x).sum(1)).sum()))

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.n + o.n, self.w + o.w, self.sx + o.sx, self.sy + o.sy, self.m + o.m, self.xx + o.xx)


vectors = vector.vectors_of


def sums_by(anchors: DataFrame, by: str) -> dict:
    """Sums of anchors (x, y, w) for each value of `by`."""

    def of(b: pa.RecordBatch, at: np.ndarray) -> Sums:
        x, y, w = vectors(b.column("x")), vectors(b.column("y")), b.column("w").to_numpy(zero_copy_only=False).astype(float)
        return Sums.of(x[at], y[at], w[at])

    return _summed(anchors.select(F.col(by).alias("g"), "x", "y", F.col("w").cast("double").alias("w")), of, anchors.schema[by].dataType.simpleString())


def orthogroup_sums(src: DataFrame, ref: DataFrame, by: str | None = None, vanilla: bool = False) -> dict:
    """The same sums over all pairs of a gene of `src` and one of `ref` (og, v, and the group `by` in both) in one orthogroup, without any pair: a pair weighs 1 / (n_src n_ref) of
    its orthogroup (1 if vanilla), so sums over pairs are products of sums over genes, which are made map-side."""
    key = [*([by] if by else []), "og"]
    a, b = vector.element_sums(src, *key), vector.element_sums(ref, *key)
    rows = a.select(*key, F.col("n").alias("na"), F.col("s").alias("x"), "q").join(b.select(*key, F.col("n").alias("nb"), F.col("s").alias("y")), key)
    rows = rows.select((F.col(by) if by else F.lit(0)).alias("g"), "na", "nb", "x", "y", "q")

    def of(b: pa.RecordBatch, at: np.ndarray) -> Sums:
        na, nb, q = (b.column(c).to_numpy(zero_copy_only=False)[at].astype(float) for c in ("na", "nb", "q"))
        x, y = vectors(b.column("x"))[at], vectors(b.column("y"))[at]
        w = np.ones(len(na)) if vanilla else 1 / (na * nb)
        return Sums(int((na * nb).sum()), float((w * na * nb).sum()), (w * nb) @ x, (w * na) @ y, (x * w[:, None]).T @ y, float((w * nb * q).sum()))

    return _summed(rows, of, rows.schema["g"].dataType.simpleString())


def _emitted(acc: dict, g_type: pa.DataType):
    """One batch of sums by g, if there are any."""
    if acc:
        s = list(acc.values())
        cols = [pa.array(list(acc), g_type), pa.array([x.n for x in s], pa.int64()), pa.array([x.w for x in s]), pa.array([x.xx for x in s])]
        cols += [pa.array([getattr(x, c).ravel().tolist() for x in s], pa.list_(pa.float64())) for c in ("sx", "sy", "m")]
        yield pa.RecordBatch.from_arrays(cols, ["g", "n", "w", "xx", "sx", "sy", "m"])


def _added(acc: dict, g, part: Sums) -> None:
    acc[g] = acc[g] + part if g in acc else part


def _summed(rows: DataFrame, of: Callable, kind: str) -> dict:
    """Sums by g. A task keeps one sum a group, and partial sums of a group are merged on the cluster."""

    def run(batches):
        acc, kind = {}, None
        for b in batches:
            kind = b.schema.field("g").type
            if b.num_rows:
                groups = b.column("g").dictionary_encode()
                codes = groups.indices.to_numpy()
                for i, g in enumerate(groups.dictionary.to_pylist()):
                    _added(acc, g, of(b, np.flatnonzero(codes == i)))
        yield from _emitted(acc, kind)

    return _merged(rows.mapInArrow(run, _SUMS.format(kind)), kind)


_SUMS = "g {}, n long, w double, xx double, sx array<double>, sy array<double>, m array<double>"


def _merged(parts: DataFrame, kind: str, merged: int = 16) -> dict:
    def merge(batches):
        acc, kind = {}, None
        for b in batches:
            kind = b.schema.field("g").type
            for g, n, w, xx, sx, sy, m in zip(*[c.to_pylist() for c in b.columns], strict=True):
                _added(acc, g, Sums(n, w, np.array(sx), np.array(sy), np.array(m).reshape(len(sx), len(sy)), xx))
        yield from _emitted(acc, kind)

    found = parts.repartition(merged, "g").mapInArrow(merge, _SUMS.format(kind)).collect()
    return {r["g"]: Sums(r["n"], r["w"], np.array(r["sx"]), np.array(r["sy"]), np.array(r["m"]).reshape(len(r["sx"]), len(r["sy"])), r["xx"]) for r in found}


def solve(s: Sums | None, allow_reflection: bool = False, center: bool = False, scale: bool = False) -> Rotation:
    """The rotation that minimises the weighted squared distance; the determinant is made +1 unless reflections are allowed."""
    if s is None or s.n < 2:
        raise ValueError("fewer than 2 anchor pairs")
    m, mx, my, var = s.m / s.w, s.sx / s.w, s.sy / s.w, s.xx / s.w
    if center:
        m, var = m - np.outer(mx, my), var - mx @ mx
    else:
        mx, my = np.zeros(len(mx)), np.zeros(len(my))
    u, sigma, vt = np.linalg.svd(m)
    flip = np.ones(len(sigma))
    if not allow_reflection and np.linalg.det(u @ vt) < 0:
        flip[-1] = -1
    r = (u * flip) @ vt
    return Rotation(r.astype(np.float32).astype(float), mx, my, float((sigma * flip).sum() / var) if scale and var > 0 else 1.0)


def _weighted(anchors: DataFrame, vanilla: bool) -> DataFrame:
    return anchors.withColumn("w", F.lit(1.0)) if vanilla else anchors


def fit(anchors: DataFrame, vanilla: bool = False, **options) -> Rotation:
    """The map of one set of anchors; vanilla: without their weights."""
    return solve(sums_by(_weighted(anchors, vanilla).withColumn("_all", F.lit(0)), "_all").get(0), **options)


def fit_each(anchors: DataFrame, by: str, vanilla: bool = False, **options) -> tuple[dict, dict]:
    """(maps, reasons why there is none) by group, all groups in one pass."""
    return solve_each(sums_by(_weighted(anchors, vanilla), by), **options)


def solve_each(sums: dict, **options) -> tuple[dict, dict]:
    """(maps, reasons why there is none) by group."""
    maps, failed = {}, {}
    for g, s in sums.items():
        try:
            maps[g] = solve(s, **options)
        except ValueError as e:
            failed[g] = str(e)
    return maps, failed


def legacy_fit(source: DataFrame, reference: DataFrame, pairs: DataFrame, **options) -> Rotation:
    """Alignment of the rows of two factor tables (id, v) that pairs (src, ref) put side by side, unweighted, reflections allowed."""
    return fit(anchors_of(pairs.withColumn("w", F.lit(1.0)), source, reference), **{"allow_reflection": True} | options)


def _listed(y: np.ndarray) -> pa.ListArray:
    y = y.astype(np.float32)
    return pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32)[: len(y) + 1], pa.array(y.ravel()))


def transform(emb: DataFrame, rot: Rotation) -> DataFrame:
    """The table with `v` mapped, in Arrow batches; a rotation is d by d, whatever the table."""
    return transform_each(emb.withColumn("_all", F.lit(0)), "_all", {0: rot}).drop("_all")


def transform_each(emb: DataFrame, by: str, maps: dict) -> DataFrame:
    """The table with `v` mapped by the map of its group, null where the group has none. Broadcasts one small matrix a group."""
    held = emb.sparkSession.sparkContext.broadcast(maps)
    names = list(emb.columns)
    at, by_at = names.index("v"), names.index(by)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            groups = b.column(by_at).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            x = vectors(b.column(at))
            y, known = np.zeros(x.shape), np.zeros(len(x), bool)
            for i, g in enumerate(groups.dictionary.to_pylist()):
                if g in held.value:
                    rows = codes == i
                    y[rows], known[rows] = held.value[g].apply(x[rows]), True
            out = _listed(y)
            if not known.all():
                out = out.take(pa.array(np.where(known, np.arange(len(x)), -1), mask=~known))
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(b.columns)], names)

    schema = ", ".join(f"`{c}` {'array<float>' if c == 'v' else t}" for c, t in emb.dtypes)
    return emb.mapInArrow(run, schema)


def anchors_of(pairs: DataFrame, src: DataFrame, ref: DataFrame) -> DataFrame:
    """Anchors of (src, ref, w) id pairs; unknown ids drop out."""
    a, b = src.select(F.col("id").alias("src"), F.col("v").alias("x")), ref.select(F.col("id").alias("ref"), F.col("v").alias("y"))
    return pairs.join(a, "src").join(b, "ref").select("src", "ref", "x", "y", "w")


# ---- refinement ---------------------------------------------------------------------------------

Near = tuple[np.ndarray, np.ndarray, np.ndarray]  # nearest, its similarity, mean of the top similarities


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)


def nearest(q: np.ndarray, c: np.ndarray, k: int) -> Near:
    """Of unit vectors in order of their ids: each query's nearest in c, by similarity rounded to 9 digits, ties to the smaller id."""
    parts, block = [], vector.rows_at_once(len(c))
    for lo in range(0, len(q), block):
        _, nbr, sim = vector.best_of(np.arange(len(q[lo : lo + block])), np.arange(len(c)), q[lo : lo + block] @ c.T, k)
        rows = len(q[lo : lo + block])
        nbr, sim = nbr.reshape(rows, -1), sim.reshape(rows, -1)
        parts.append((nbr[:, 0], sim[:, 0], sim.mean(1)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _rounds(x: np.ndarray, y: np.ndarray, base: Sums, known: np.ndarray | Callable, both: Callable, rounds: int = 5, threshold: float = 0.5, csls: bool = True, k: int = 10, new_weight: float = 1.0, tol: float = 1e-5, vanilla: bool = False, **options) -> tuple[Rotation, list[dict]]:
    """The rounds of `refine` over two matrices in order of ids; `known` holds sorted codes i * len(y) + j of the anchors, or is a function of i and j
    that tells anchors, and both(a, b, k) gives the neighbours of a in b and of b in a."""
    rot, log, ref = solve(base, **options), [], unit(y)
    mean = base.w / base.n
    for i in range(rounds):
        moved = unit(rot.apply(x).astype(np.float32).astype(float))
        (nbr, sim, ra), (back, _, rb) = both(moved, ref, k if csls else 1)
        at = np.flatnonzero(back[nbr] == np.arange(len(x)))
        score = 2 * sim[at] - ra[at] - rb[nbr[at]] if csls else sim[at]
        at = at[score >= threshold]
        at = at[~(known(at, nbr[at]) if callable(known) else np.isin(at * len(y) + nbr[at], known, assume_unique=False))]
        if not len(at):
            log.append({"round": i + 1, "new": 0, "moved": 0.0})
            break
        nxt = solve(base + Sums.of(x[at], y[nbr[at]], np.full(len(at), 1.0 if vanilla else mean * new_weight)), **options)
        step = float(np.linalg.norm(nxt.r - rot.r))
        rot = nxt
        log.append({"round": i + 1, "new": len(at), "moved": step})
        if step < tol:
            break
    return rot, log


def refine(pairs: DataFrame, src: DataFrame, ref: DataFrame, held_bytes: int = 64 << 20, held_pairs: int = 2_000_000, **options) -> tuple[Rotation, list[dict]]:
    """Iterative refinement: mutual nearest neighbours above the threshold join the original anchors, and the map is fitted again.

    Neighbours are chosen by cosine; CSLS only scores them. New pairs weigh `new_weight` times the mean anchor weight. Ends when
    no pair is new or the rotation moves by less than `tol`. Returns the map and a log of rounds. While both tables have at
    most `held_bytes` and the anchors at most `held_pairs` rows, the driver holds them, and a round is one job that searches blocks of
    both sides against broadcast matrices; beyond, neighbours and new pairs are tables, and two blocks meet once for both ways. Both ways give the same map.
    """
    vanilla = options.get("vanilla", False)
    pairs = pairs.select("src", "ref", F.col("w").cast("double").alias("w"))
    a, b = (d.select(F.col("id").cast("long").alias("id"), "v") for d in (src, ref))
    anchors = stored(anchors_of(_weighted(pairs, vanilla), a, b).withColumn("all", F.lit(0)), "refine-anchors")
    try:
        base = sums_by(anchors, "all").get(0)
        sizes = [d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first() for d in (a, b)]
        if base is not None and all(s["n"] * (s["d"] or 0) * 8 <= held_bytes for s in sizes) and base.n <= held_pairs:
            return _held(anchors, a, b, base, **options)
        return _tables(anchors, a, b, base, **options)
    finally:
        dropped(anchors)


def refine_orthogroups(src: DataFrame, ref: DataFrame, held_bytes: int = 64 << 20, **options) -> tuple[Rotation, list[dict]]:
    """`refine` with all pairs of an orthogroup as anchors; src and ref are (og, id, v), an id in one row. Their sums come from `orthogroup_sums`, and a pair is
    known if its orthogroups are the same, so no anchor is ever a row."""
    base = orthogroup_sums(src, ref, vanilla=options.get("vanilla", False)).get(0)
    a, b = (d.select(F.col("id").cast("long").alias("id"), "v", "og") for d in (src, ref))
    sizes = [d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first() for d in (a, b)]
    if base is not None and all(s["n"] * (s["d"] or 0) * 8 <= held_bytes for s in sizes):
        return _held(None, a, b, base, **options)
    return _tables(None, a, b, base, **options)


def _group_codes(p: pa.ChunkedArray, q: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the orthogroups of both sides, -1 for null."""
    codes = pa.chunked_array([*p.chunks, *q.chunks], p.type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return codes[: len(p)], codes[len(p) :]


def _same_group(p: pa.ChunkedArray, q: pa.ChunkedArray) -> Callable:
    """Whether the i-th of p and the j-th of q are one orthogroup; null is none."""
    of_p, of_q = _group_codes(p, q)
    return lambda i, j: (of_p[i] == of_q[j]) & (of_p[i] >= 0)


def _held(anchors: DataFrame | None, a: DataFrame, b: DataFrame, base: Sums, **options) -> tuple[Rotation, list[dict]]:
    """Without `anchors` they are all pairs with one `og`."""
    spark = a.sparkSession
    ta, tb = (t.take(pa.compute.sort_indices(t, [("id", "ascending")])) for t in (d.toArrow() for d in (a, b)))
    (ia, x), (ib, y) = _in_order(ta), _in_order(tb)
    if anchors is None:
        known = _same_group(ta.column("og"), tb.column("og"))
    else:
        known = anchors.select(F.col("src").cast("long").alias("src"), F.col("ref").cast("long").alias("ref")).toArrow()
        known = np.unique(np.searchsorted(ia, known.column("src").to_numpy()) * len(ib) + np.searchsorted(ib, known.column("ref").to_numpy()))
    cores = spark.sparkContext.defaultParallelism

    def both(p: np.ndarray, q: np.ndarray, k: int) -> tuple[Near, Near]:
        held = spark.sparkContext.broadcast((p, q))
        step = max(256, -(-(len(p) + len(q)) // max(1, cores)))
        jobs = [(side, lo) for side, m in ((0, p), (1, q)) for lo in range(0, len(m), step)]

        def run(batches):
            for t in batches:
                for i in t.column(0).to_pylist():
                    side, lo = jobs[i]
                    mine, other = held.value[side], held.value[1 - side]
                    nbr, sim, mean = nearest(mine[lo : lo + step], other, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nbr), side)), pa.array(np.arange(lo, lo + len(nbr))), pa.array(nbr), pa.array(sim), pa.array(mean)], ["side", "q", "nbr", "sim", "mean"])

        got = spark.range(0, len(jobs), 1, min(len(jobs), max(1, cores))).mapInArrow(run, "side long, q long, nbr long, sim double, mean double").toArrow()
        held.destroy()
        cols = [got.column(c).to_numpy() for c in ("side", "q", "nbr", "sim", "mean")]
        out = []
        for side in (0, 1):
            at = np.flatnonzero(cols[0] == side)
            at = at[np.argsort(cols[1][at])]
            out.append(tuple(c[at] for c in cols[2:]))
        return out[0], out[1]

    return _rounds(x, y, base, known, both, **options)


def _in_order(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, v = t.column("id").to_numpy(), vectors(t.column("v"))
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def _tables(anchors: DataFrame | None, a: DataFrame, b: DataFrame, base: Sums | None, rounds: int = 5, threshold: float = 0.5, csls: bool = True, k: int = 10, new_weight: float = 1.0, tol: float = 1e-5, vanilla: bool = False, **options) -> tuple[Rotation, list[dict]]:
    rot, log = solve(base, **options), []
    weight = 1.0 if vanilla else base.w / base.n * new_weight
    for i in range(rounds):
        moved = stored(transform(a.select("id", "v"), rot), "refine-moved")
        near = stored(vector.nearest_cells(moved, b.select("id", "v"), k if csls else 1), "refine-near")
        ab, ba = (near.filter(F.col("side") == side).drop("side") for side in (0, 1))
        scores = vector.csls(ab, ba) if csls else ab.filter("rank = 1").select(F.col("q").alias("src"), F.col("nbr").alias("ref"), F.col("sim").alias("score"))
        found = vector.mutual(ab, ba).join(scores, ["src", "ref"]).filter(F.col("score") >= threshold).select("src", "ref")
        if anchors is None:
            own = [d.select(F.col("id").alias(c), F.col("og").alias(f"_{c}")) for d, c in ((a, "src"), (b, "ref"))]
            found = found.join(own[0], "src").join(own[1], "ref").filter(~F.coalesce(F.col("_src") == F.col("_ref"), F.lit(False))).select("src", "ref")
        else:
            found = found.join(anchors.select("src", "ref"), ["src", "ref"], "left_anti")
        new = stored(anchors_of(found.withColumn("w", F.lit(weight)), a, b).withColumn("all", F.lit(0)), "refine-new")
        more = sums_by(new, "all").get(0)
        dropped(moved, near, new)
        if more is None:
            log.append({"round": i + 1, "new": 0, "moved": 0.0})
            break
        nxt = solve(base + more, **options)
        step = float(np.linalg.norm(nxt.r - rot.r))
        rot = nxt
        log.append({"round": i + 1, "new": more.n, "moved": step})
        if step < tol:
            break
    return rot, log


# ---- all species --------------------------------------------------------------------------------


def fit_orthogroups(src: DataFrame, ref: DataFrame, vanilla: bool = False, **options) -> Rotation:
    """The map whose anchors are all pairs of an orthogroup; src and ref are (og, v)."""
    return solve(orthogroup_sums(src, ref, vanilla=vanilla).get(0), **options)


def two_stage_orthogroups(emb: DataFrame, reference, seeds: list, groups: DataFrame, vanilla: bool = False, **options) -> DataFrame:
    """`two_stage` without refinement, the anchors being all pairs of an orthogroup: emb is (species, id, idx, og, v). No pair is made."""
    vec_type = emb.withColumn("v", F.col("v").cast("array<float>"))
    of = vec_type.filter(F.col("species") == reference)
    first = [s for s in seeds if s != reference]
    own = vec_type.filter(F.col("species").isin(first))
    each = of.withColumn("species", F.explode(F.array(*[F.lit(s) for s in first]).cast(f"array<{emb.schema['species'].dataType.simpleString()}>")))
    sums = orthogroup_sums(own, each, "species", vanilla)
    maps = {s: solve(sums.get(s), **options) for s in first}  # seeds fail loudly
    done = of.withColumn("status", F.lit("reference")).unionByName(transform_each(own, "species", maps).withColumn("status", F.lit("seed")))
    aligned = stored(done.select("species", "id", "idx", "og", "v", "status"), "aligned-seeds")
    rest = vec_type.join(groups.select("species"), "species", "left_semi")
    theirs = groups.join(aligned.withColumnRenamed("species", "seed"), "seed").select("species", "og", "v")
    maps, failed = solve_each(orthogroup_sums(rest, theirs, "species", vanilla), **options)
    moved = transform_each(rest.select("species", "id", "idx", "og", "v"), "species", maps)
    return aligned.unionByName(moved.withColumn("status", _status(failed))).drop("og")


def _status(failed: dict):
    why = F.create_map(*[F.lit(x) for kv in failed.items() for x in kv])[F.col("species")] if failed else F.lit(None).cast("string")
    return F.when(F.col("v").isNotNull(), "aligned").otherwise(F.coalesce(why, F.lit("fewer than 2 anchor pairs")))


def two_stage(emb: DataFrame, pairs: DataFrame | None, reference, seeds: list, groups: DataFrame, refinement: dict | None = None, local_genes: int = 200_000, **options) -> DataFrame:
    """(species, id, idx, v, status): the reference as it is, seeds aligned to it, the others to their nearest aligned seed.

    emb is (species, id, idx, v); pairs (sp_src, sp_ref, src, ref, w), or None: all pairs of an orthogroup, emb having og, without any pair
    as a row; groups (species, seed). `options` (vanilla, center, scale,
    allow_reflection) and `refinement` (the options of `refine`; None: no refinement) hold for seeds and all other species alike. Seeds
    fail loudly; another species that cannot be fitted keeps no vectors and says why. Without refinement all species of the second
    stage are fitted from grouped sums in one pass. With it each of them is a task of its own while it and its seed have at most
    `local_genes` genes; larger ones are refined one after another on the whole cluster, with the same result.
    """
    if pairs is None and refinement is None:
        return two_stage_orthogroups(emb, reference, seeds, groups, **options)
    own = lambda s: emb.filter(F.col("species") == s)
    og = ["og"] if pairs is None else []
    vec_type = emb.withColumn("v", F.col("v").cast("array<float>"))
    out = vec_type.filter(F.col("species") == reference).withColumn("status", F.lit("reference"))
    for s in seeds:
        if s != reference and pairs is None:
            rot = refine_orthogroups(own(s), own(reference), **options, **refinement)[0]
            out = out.unionByName(transform(vec_type.filter(F.col("species") == s), rot).withColumn("status", F.lit("seed")))
        elif s != reference:
            p = pairs.filter((F.col("sp_src") == s) & (F.col("sp_ref") == reference)).select("src", "ref", "w")
            rot = fit(anchors_of(p, own(s), own(reference)), **options) if refinement is None else refine(p, own(s), own(reference), **options, **refinement)[0]
            out = out.unionByName(transform(vec_type.filter(F.col("species") == s), rot).withColumn("status", F.lit("seed")))
    aligned = stored(out.select("species", "id", "idx", *og, "v", "status"), "aligned-seeds")
    a = None
    if pairs is not None:
        p = pairs.join(groups.select(F.col("species").alias("sp_src"), F.col("seed").alias("sp_ref")), ["sp_src", "sp_ref"])
        a = p.join(emb.select(F.col("species").alias("sp_src"), F.col("id").alias("src"), F.col("v").alias("x")), ["sp_src", "src"])
        a = a.join(aligned.select(F.col("species").alias("sp_ref"), F.col("id").alias("ref"), F.col("v").alias("y")), ["sp_ref", "ref"]).select(F.col("sp_src").alias("species"), "src", "ref", "x", "y", "w")
    rest = vec_type.join(groups.select("species"), "species", "left_semi")
    if refinement is None:
        maps, failed = fit_each(a, "species", **options)
    else:
        maps, failed = _refined_each(emb, aligned, groups, a, refinement, local_genes, options)
    moved = transform_each(rest.select("species", "id", "idx", "v"), "species", maps)
    return aligned.drop(*og).unionByName(moved.withColumn("status", _status(failed)))


def _sums_of_groups(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray, vanilla: bool) -> Sums:
    """`orthogroup_sums` of two matrices and the numbers of their rows' groups (below 0: none)."""
    n = max(of_x.max(initial=-1), of_y.max(initial=-1)) + 1
    sums = []
    for m, of in ((x, of_x), (y, of_y)):
        on = of >= 0
        s = np.zeros((n, m.shape[1]))
        np.add.at(s, of[on], m[on])
        sums.append((s, np.bincount(of[on], minlength=n).astype(float)))
    (sx, na), (sy, nb) = sums
    w = np.ones(n) if vanilla else 1 / np.maximum(na * nb, 1)
    q = np.bincount(of_x[of_x >= 0], (x[of_x >= 0] ** 2).sum(1), minlength=n)
    return Sums(int((na * nb).sum()), float((w * na * nb).sum()), (w * nb) @ sx, (w * na) @ sy, (sx * w[:, None]).T @ sy, float((w * nb * q).sum()))


def _refined_each(emb: DataFrame, aligned: DataFrame, groups: DataFrame, anchors: DataFrame, refinement: dict, local_genes: int, options: dict) -> tuple[dict, dict]:
    """(maps, reasons) of the species in `groups` (species, seed), refined against their aligned seeds."""
    og = F.col("og") if anchors is None else F.lit(None).cast("string")
    none = [F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("w")]
    own = emb.join(groups, "species").select("species", F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), *none, F.col("v").cast("array<float>").alias("v"), og.alias("og"))
    seed = aligned.withColumnRenamed("species", "seed").join(groups, "seed").select("species", F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), *none, "v", og.alias("og"))
    links = None
    if anchors is not None:
        links = anchors.select("species", F.lit(2).alias("kind"), F.col("src").cast("long").alias("id"), F.col("ref").cast("long").alias("other"), F.col("w").cast("double").alias("w"), F.lit(None).cast("array<float>").alias("v"), og.alias("og"))
    sizes = own.unionByName(seed).groupBy("species").agg(F.max(F.col("kind")).alias("_k"), F.sum((F.col("kind") == 0).cast("long")).alias("mine"), F.sum((F.col("kind") == 1).cast("long")).alias("theirs")).collect()  # a row a species
    large = [r["species"] for r in sizes if max(r["mine"], r["theirs"]) > local_genes]
    kind = emb.schema["species"].dataType
    local = [c for c in (own, seed, links) if c is not None]
    if large:
        local = [c.filter(~F.col("species").isin(large)) for c in local]

    anchors_given = anchors is not None

    def one(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_numpy()
        x, y, pairs = (t.filter(pa.array(kinds == i)) for i in range(3))
        flat, why = None, None
        try:
            if anchors_given and pairs.num_rows < 2:
                raise ValueError("fewer than 2 anchor pairs")
            vanilla = options.get("vanilla", False)
            both = lambda p, q, k: (nearest(p, q, k), nearest(q, p, k))
            x, y = (t.take(pa.compute.sort_indices(t, [("id", "ascending")])) for t in (x, y))
            (ia, a), (ib, b) = _in_order(x), _in_order(y)
            if anchors_given:
                i, j = np.searchsorted(ia, pairs.column("id").to_numpy()), np.searchsorted(ib, pairs.column("other").to_numpy())
                base, known = Sums.of(a[i], b[j], np.ones(len(i)) if vanilla else pairs.column("w").to_numpy()), np.unique(i * len(ib) + j)
            else:
                codes = _group_codes(x.column("og"), y.column("og"))
                base, known = _sums_of_groups(a, codes[0], b, codes[1], vanilla), _same_group(x.column("og"), y.column("og"))
            rot, _ = _rounds(a, b, base, known, both, **options, **refinement)
            flat = np.concatenate([[len(rot.mu_src), len(rot.mu_ref), rot.scale], rot.mu_src, rot.mu_ref, rot.r.ravel()]).tolist()
        except ValueError as e:
            why = str(e)
        return pa.table({"species": t.column("species").slice(0, 1), "map": pa.array([flat], pa.list_(pa.float64())), "why": pa.array([why], pa.string())})

    schema = T.StructType([T.StructField("species", kind), T.StructField("map", T.ArrayType(T.DoubleType())), T.StructField("why", T.StringType())])
    every = local[0].unionByName(local[1])
    rows = (every.unionByName(local[2]) if anchors_given else every).groupBy("species").applyInArrow(one, schema).collect()
    maps, failed = {}, {}
    for r in rows:
        if r["map"] is None:
            failed[r["species"]] = r["why"]
            continue
        f = np.array(r["map"])
        d, e = int(f[0]), int(f[1])
        maps[r["species"]] = Rotation(f[3 + d + e :].reshape(d, e), f[3 : 3 + d], f[3 + d : 3 + d + e], float(f[2]))
    for s in large:
        seed_of = groups.filter(F.col("species") == s).first()["seed"]
        try:
            if not anchors_given:
                maps[s] = refine_orthogroups(emb.filter(F.col("species") == s), aligned.filter(F.col("species") == seed_of), **options, **refinement)[0]
                continue
            maps[s] = refine(anchors.filter(F.col("species") == s).select("src", "ref", "w"), emb.filter(F.col("species") == s), aligned.filter(F.col("species") == seed_of), **options, **refinement)[0]
        except ValueError as e:
            failed[s] = str(e)
    return maps, failed


def subsampled(pairs: DataFrame, rate: float, replicate: int) -> DataFrame:
    """max(2, round(rate n)) of the pairs (each once), the smallest by a stable hash of pair and replicate."""
    n = pairs.count()
    cut = _cuts(pairs, [replicate], [max(2, round(rate * n))], n)
    return pairs.filter(_level(replicate, cut[replicate]) > 0)


def _key(replicate):
    """What orders the pairs of a replicate."""
    ends = [F.col(c).cast("string") for c in ("src", "ref")]
    return F.concat_ws(":", F.md5(F.concat_ws(":", *ends, replicate.cast("string"))), *ends)


def _level(replicate: int, cuts: list):
    """How many of the cuts (keys; None: beyond all pairs) lie above a pair's key."""
    key = _key(F.lit(replicate))
    return sum(((key < cut).cast("tinyint") if cut is not None else F.lit(1).cast("tinyint") for cut in cuts), F.lit(0).cast("tinyint")).cast("tinyint")


def _cuts(pairs: DataFrame, replicates: list[int], places: list[int], n: int, digits: int = 3) -> dict:
    """For each replicate the keys at the given places of the n pairs' order; None beyond the last. The pairs are only counted, by the first digits of their keys, and those
    that share them with a key in question are put in order: a few in 16^digits."""
    within = sorted({p for p in places if p < n})
    found = {}
    if within:
        keyed = pairs.select("src", "ref", F.explode(F.array(*[F.lit(r) for r in replicates])).alias("_rep")).select("_rep", _key(F.col("_rep")).alias("_key"))
        keyed = keyed.withColumn("_bin", F.substring("_key", 1, digits))
        counts = keyed.groupBy("_rep", "_bin").agg(F.count(F.lit(1)).alias("n")).collect()  # 16^digits rows a replicate
        bins, below = [], dict.fromkeys(replicates, 0)
        for r in sorted(counts, key=lambda r: (r["_rep"], r["_bin"])):
            start = below[r["_rep"]]
            below[r["_rep"]] += r["n"]
            if any(start <= p < below[r["_rep"]] for p in within):
                bins.append((r["_rep"], r["_bin"], start))
        near = keyed.join(F.broadcast(pairs.sparkSession.createDataFrame(bins, "_rep int, _bin string, _start long")), ["_rep", "_bin"])
        placed = sums_below(near.withColumn("_one", F.lit(1)), "_key", ["_one"], "_rep", "_bin").withColumn("_at", F.col("_start") + F.col("below__one"))
        found = {(r["_rep"], r["_at"]): r["_key"] for r in placed.filter(F.col("_at").isin(within)).select("_rep", "_at", "_key").collect()}  # a row a cut
    return {rep: [found.get((rep, p)) for p in places] for rep in replicates}


def _level_sums(anchors: DataFrame, src: DataFrame, ref: DataFrame, n_levels: int) -> dict:
    """Sums by replicate * n_levels + level - 1 of anchors (u, v, w, levels: a level from 0 for each replicate, 0 in none). They meet their vectors in cells."""
    left, right, keys = vector.pair_cells(anchors, src, ref)

    def meet(key, p: pa.Table, q: pa.Table) -> pa.Table:
        acc: dict = {}
        if p.num_rows and q.num_rows:
            rows, i, j, x, y = vector.cell_vectors(p, q)
            w = p.column("w").to_numpy()[rows]
            levels = p.column("levels").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(p.num_rows, -1)[rows]
            for rep in range(levels.shape[1]):
                for level in np.unique(levels[:, rep]):
                    at = np.flatnonzero(levels[:, rep] == level) if level else []
                    for lo in range(0, len(at), 65536):
                        part = at[lo : lo + 65536]
                        _added(acc, rep * n_levels + int(level) - 1, Sums.of(x[i[part]], y[j[part]], w[part]))
        out = list(_emitted(acc, pa.int32()))
        many = pa.list_(pa.float64())
        kinds = pa.schema([("g", pa.int32()), ("n", pa.int64()), ("w", pa.float64()), ("xx", pa.float64()), ("sx", many), ("sy", many), ("m", many)])
        return pa.Table.from_batches(out) if out else kinds.empty_table()

    return _merged(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _SUMS.format("int")), "int")


def anchor_robustness(pairs: DataFrame, src: DataFrame, ref: DataFrame, truth: DataFrame, rates: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25, 0.1), replicates: int = 5, vanilla: bool = False, **options) -> DataFrame:
    """(rate, replicate, n_anchors, rho): for subsamples of the anchors (each pair once), the Spearman correlation of truth (u, v, s; u in ref, v in src)
    with the cosine after alignment. All subsamples are fitted in one pass and scored in another: a pair is one row, whatever the number of trials, and has no vectors."""
    from . import retrieval

    spark = src.sparkSession
    rates = tuple(sorted(set(rates), reverse=True))
    total = pairs.count()
    cuts = _cuts(pairs, list(range(replicates)), [max(2, round(rate * total)) for rate in rates], total)
    levels = F.array(*[_level(rep, cuts[rep]) for rep in range(replicates)])  # a smaller share is the beginning of a larger one
    chosen = pairs.select(F.col("src").alias("u"), F.col("ref").alias("v"), (F.lit(1.0) if vanilla else F.col("w").cast("double")).alias("w"), levels.alias("levels"))
    by_level = _level_sums(chosen, src, ref, len(rates))
    trials, maps = [], []
    for rep in range(replicates):
        s = None
        for i in reversed(range(len(rates))):
            own = by_level.get(rep * len(rates) + i)
            s = own if s is None else s if own is None else s + own
            try:
                maps.append(solve(s, **options))
                trials.append((rates[i], rep, s.n))
            except ValueError:
                continue
    flat = truth.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
    rho = retrieval.mapped_ranks(flat, src, ref, maps) if maps else {}
    return spark.createDataFrame([(*t, rho[g][1]) for g, t in enumerate(trials) if g in rho], "rate double, replicate int, n_anchors long, rho double")


def orthogonality(rot: Rotation) -> float:
    """The largest deviation of r'r from the identity."""
    return float(np.abs(rot.r.T @ rot.r - np.eye(len(rot.r))).max())
