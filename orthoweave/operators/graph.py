"""Network operators: cleaning, neighbour sets, statistics, set-Jaccard joins, ego networks.

A network is a DataFrame (a, b, w) with one row per undirected edge and a <= b; a raw one is (src, dst, w).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..sources.shared import stored
from .ordered import positions
from .vector import best_of


def dedup_max(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per undirected edge with its largest weight; in `parts` partitions, so that what a task groups is bounded by whoever knows the size."""
    a, b = ids.edge_key(F.col("src"), F.col("dst"))
    rows = raw.select(a.alias("a"), b.alias("b"), "w")
    return (rows.repartition(parts, "a", "b") if parts else rows).groupBy("a", "b").agg(F.max("w").alias("w"))


def int_scores(edges: DataFrame, top: int = 1000) -> DataFrame:
    """Weights as whole numbers up to `top`, truncated; 0 everywhere if no weight is positive."""
    most = edges.agg(F.greatest(F.max("w"), F.lit(0.0)).alias("_m"))  # one row
    score = F.when(F.col("_m") > 0, (F.col("w") / F.col("_m") * top).cast("int")).otherwise(0)
    return edges.join(F.broadcast(most)).select("a", "b", score.alias("score"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(gene, nbr) in both directions, distinct as edges are; each edge is read once."""
    both = F.array_distinct(F.array(F.struct(F.col("a").alias("gene"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("gene"), F.col("a").alias("nbr"))))
    return edges.select(F.explode(both).alias("_e")).select("_e.gene", "_e.nbr")


def neighbour_sets(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """gene, nbrs (sorted set); grouped in `parts` partitions."""
    both = symmetric(edges)
    return (both.repartition(parts, "gene") if parts else both).groupBy("gene").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))


def og_neighbours(edges: DataFrame, gene_og: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (gene, og) of the orthogroups of a gene's neighbours; genes without any drop out. gene_og is (gene, og). In `parts` partitions by gene."""
    og = gene_og.filter(F.col("og").isNotNull()).select(F.col("gene").alias("nbr"), "og").distinct()
    both = symmetric(edges)
    found = (both.repartition(parts, "nbr") if parts else both).join(og, "nbr").select("gene", "og")
    return (found.repartition(parts, "gene") if parts else found).distinct()


def stats_distinct(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean degree over distinct undirected edges."""
    degree = symmetric(edges).groupBy("gene").count()
    n, e = F.count(F.lit(1)), F.floor(F.sum("count") / 2)
    return degree.agg(n.alias("n_nodes"), e.cast("long").alias("n_edges"), F.when(n > 1, e / (n * (n - 1) / 2)).otherwise(0.0).alias("density"), F.when(n > 0, 2 * e / n).otherwise(0.0).alias("avg_degree"))


def stats_raw(raw: DataFrame) -> DataFrame:
    """The same over rows as they are: 2e/(n(n-1)) and 2e/n."""
    ends = raw.select(F.explode(F.array("src", "dst")).alias("gene")).groupBy("gene").count()
    n, e = F.count(F.lit(1)), F.sum("count") / 2
    return ends.agg(n.alias("n_nodes"), e.cast("long").alias("n_edges"), F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * e / n).otherwise(0.0).alias("mean_degree"))


def dense_index(nodes: DataFrame, column: str = "gene") -> DataFrame:
    """(column, idx): 0-based position in sorted order."""
    return positions(nodes.select(column).distinct(), column).select(column, F.col("idx").cast("long").alias("idx"))


def set_jaccard_self(members: DataFrame, parts: int | None = None, carried: int = 64, hub: int = 2048) -> DataFrame:
    """All i < j that share an element of (gene, el): inter and jaccard. Sets of at most `carried` elements go whole to each of their elements, and a pair is made once, at its
    smallest common element: no pair is shuffled. Pairs with a larger set are counted from one row an element. An element of more than `hub` sets (2^20 such at most) is
    dealt over many tasks. In `parts` partitions by element."""
    gone = F.max(F.col("el").isNull().cast("int"))  # counts as an element, but is shared with none
    sets = stored(members.groupBy("gene").agg(F.array_sort(F.collect_set("el")).alias("els"), gone.alias("_gone")).filter(F.size("els") > 0).select("gene", "els", (F.size("els") + F.col("_gone")).cast("long").alias("n")), "element-sets")
    size = sets.agg(F.coalesce(F.sum(F.size("els")), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("els")), F.lit(0)).alias("most")).first()
    hub = max(hub, size["n"] >> 20)
    hubs = sets.select(F.explode("els").alias("el")).groupBy("el").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > hub).select("el", F.ceil(F.col("_d") / hub).cast("int").alias("_parts"))
    m = sets.select(F.explode("els").alias("el"), "gene", "n", F.when(F.size("els") <= carried, F.col("els")).alias("els"))
    m = m.join(F.broadcast(hubs), "el", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = m.select("el", F.pmod(F.xxhash64("gene"), F.col("_parts")).cast("int").alias("_part"), F.col("gene").alias("i"), F.col("n").alias("ni"), F.col("els").alias("_x"))
    right = m.select("el", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("gene").alias("j"), F.col("n").alias("nj"), F.col("els").alias("_y"))
    met = lambda a, b: (a.repartition(parts, "el", "_part") if parts else a).join(b.repartition(parts, "el", "_part") if parts else b, ["el", "_part"])
    small = met(left.filter("_x is not null"), right.filter("_y is not null")).filter("i < j").select("i", "j", "ni", "nj", "el", F.array_intersect("_x", "_y").alias("_both"))
    pairs = small.filter(F.col("_both")[0] == F.col("el")).select("i", "j", "ni", "nj", F.size("_both").cast("long").alias("inter"))
    if size["most"] > carried:
        large = met(left.withColumn("_x", F.col("_x").isNull()), right.withColumn("_y", F.col("_y").isNull())).filter("i < j and (_x or _y)")
        pairs = pairs.unionByName(large.groupBy("i", "j", "ni", "nj").agg(F.count(F.lit(1)).alias("inter")))
    return pairs.select("i", "j", "inter", (F.col("inter") / (F.col("ni") + F.col("nj") - F.col("inter"))).alias("jaccard"))


def _common(a: pa.ChunkedArray, b: pa.ChunkedArray, columns: int = 4096) -> np.ndarray:
    """How many elements each set of a (a list column) shares with each of b, by products of 0/1 matrices over some columns at a time."""
    a, b = a.combine_chunks(), b.combine_chunks()
    x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (a, b))
    of_x, of_y = (np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy())) for c in (a, b))
    both = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), columns):
        part = both[lo : lo + columns]
        m = []
        for n, el, of in ((len(a), x, of_x), (len(b), y, of_y)):
            at = np.minimum(np.searchsorted(part, el), len(part) - 1)
            on = part[at] == el
            m.append(np.zeros((n, len(part)), np.float32))
            m[-1][of[on], at[on]] = 1
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _coded(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both (gene, el) with whole-number elements: as they are, or by their place among all."""
    if all(isinstance(d.schema["el"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for d in (left, right)):
        return tuple(d.select("gene", F.col("el").cast("long").alias("el")) for d in (left, right))
    place = positions(left.select("el").union(right.select("el")).dropna().distinct(), "el")
    return tuple(d.join(place, "el").select("gene", F.col("idx").cast("long").alias("el")) for d in (left, right))


def dealt_blocks(a: DataFrame, b: DataFrame, block: int = 1024) -> tuple[DataFrame, DataFrame, list[str]]:
    """(a, b, keys): rows of a and b (grp, id, ...) such that every a meets every b of its group once under equal keys, at most about `block` rows
    of each side at a time. Rows of a have n, the number of pairs of their group."""
    sizes = [d.groupBy("grp").agg(F.count(F.lit(1)).alias(f"_c{s}"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"_n{s}")) for d, s in ((a, "a"), (b, "b"))]
    sizes = sizes[0].join(sizes[1], "grp").select("grp", "_na", "_nb", (F.col("_ca") * F.col("_cb")).alias("n"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = a.join(sizes, "grp").withColumn("_pa", own("_na")).withColumn("_pb", every("_nb")).drop("_na", "_nb")
    y = b.join(sizes, "grp").withColumn("_pb", own("_nb")).withColumn("_pa", every("_na")).drop("_na", "_nb", "n")
    keys = ["grp", "_pa", "_pb"]
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given: few bytes make many pairs
    return x.repartition(parts, *keys), y.select(*[F.col(c).alias(c) for c in y.columns]).repartition(parts, *keys), keys


def group_jaccard(a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame, most: int | None = None, every: bool = False, block: int = 1024) -> DataFrame:
    """(u, v, n, jaccard): Jaccard of the element sets of all pairs of an id of a and one of b (grp, id) in one group
    of n pairs. left and right are (gene, el).

    Pairs without a common element drop out, and a pair that shares groups comes once, with the smallest; with `every` they all stay, with 0, and come
    once a group. `most`: at least the `most` best v of each u by falling Jaccard, then v. No row of the shuffle is a pair or an element: the sets of a
    group are dealt into blocks, and each two blocks are multiplied in a task of their own."""
    a, b = (d.dropna().distinct() for d in (a, b))
    left, right = _coded(left.distinct(), right.distinct())
    sides = []
    for d, s in ((a, left), (b, right)):
        own = s.groupBy(F.col("gene").alias("id")).agg(F.collect_list("el").alias("els"))
        d = d.join(d.groupBy("id").agg(F.collect_list("grp").alias("grps")), "id").join(own, "id", "left" if every else "inner")
        sides.append(d.select("grp", "id", "grps", F.coalesce("els", F.array().cast("array<bigint>")).alias("els")))
    x, y, keys = dealt_blocks(*sides, block)

    def meet(key, p: pa.Table, q: pa.Table) -> pa.Table:
        n, m = (t.column("els").combine_chunks().value_lengths().to_numpy() for t in (p, q))
        inter = _common(p.column("els"), q.column("els")) if p.num_rows and q.num_rows else np.zeros((p.num_rows, q.num_rows), np.int64)
        s = inter / np.maximum(n[:, None] + m[None, :] - inter, 1)
        groups = [t.column("grps").combine_chunks().value_lengths().to_numpy().max(initial=0) for t in (p, q)]
        if not every and min(groups) > 1:
            grp = key[0].as_py()
            earlier = [pa.chunked_array([pa.array([[g for g in gs if g < grp] for gs in t.column("grps").to_pylist()], t.schema.field("grps").type)]) for t in (p, q)]
            s[_common(*earlier) > 0] = 0
        u, v = p.column("id").to_numpy(), q.column("id").to_numpy()
        if most is not None and len(v):
            u, v, s = best_of(u, v, s, most, digits=None)
            on = np.flatnonzero(s > 0)
            u, v, s = u[on], v[on], s[on]
        else:
            i, j = np.nonzero(np.ones_like(s) if every else s)
            u, v, s = u[i], v[j], s[i, j]
        return pa.table({"u": u, "v": v, "n": np.full(len(u), p.column("n")[0].as_py() if len(u) else 0), "jaccard": s})

    kinds = [d.schema["id"].dataType.simpleString() for d in (a, b)]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(meet, f"u {kinds[0]}, v {kinds[1]}, n long, jaccard double")


def set_jaccard_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Jaccard of the element sets of given pairs (u, v); pairs without a common element drop out. left and right are (gene, el)."""
    nl, nr = left.groupBy(F.col("gene").alias("u")).agg(F.count(F.lit(1)).alias("nu")), right.groupBy(F.col("gene").alias("v")).agg(F.count(F.lit(1)).alias("nv"))
    el = pairs.join(left.select(F.col("gene").alias("u"), "el"), "u").join(right.select(F.col("gene").alias("v"), "el"), ["v", "el"])
    inter = el.groupBy("u", "v").agg(F.count(F.lit(1)).alias("inter")).join(nl, "u").join(nr, "v")
    return inter.select("u", "v", (F.col("inter") / (F.col("nu") + F.col("nv") - F.col("inter"))).alias("jaccard"))


def ego(edges: DataFrame, center, k: int = 15) -> DataFrame:
    """Induced edges among a node and its k heaviest neighbours (ties: smaller id)."""
    near = edges.filter(F.col("a") == center).select(F.col("b").alias("node"), "w").union(edges.filter(F.col("b") == center).select("a", "w"))
    near = near.groupBy("node").agg(F.max("w").alias("w")).orderBy(F.desc("w"), "node").limit(k).select("node")
    nodes = F.broadcast(near.union(near.sparkSession.range(1).select(F.lit(center).cast(near.schema["node"].dataType).alias("node"))).distinct())  # k + 1 rows
    return edges.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "w")


def scaled_weights(edges: DataFrame) -> DataFrame:
    """Adds w01: weights scaled to 0..1 over the whole table (a range of 0 counts as 1)."""
    ends = edges.agg(F.min("w").alias("_lo"), F.max("w").alias("_hi"))  # one row
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    return edges.join(F.broadcast(ends)).withColumn("w01", (F.col("w") - F.col("_lo")) / width).drop("_lo", "_hi")


def resolve_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node): exact match, else without suffix, else without version; of several the smallest."""
    base = wanted.select("id").distinct()
    tries = [(F.col("id"), F.col("node")), (ids.node_key(F.col("id")), ids.node_key(F.col("node"))), (ids.node_key_unversioned(F.col("id")), ids.node_key_unversioned(F.col("node")))]
    out = base
    for i, (left, right) in enumerate(tries):
        keyed = nodes.select(right.alias("_k"), "node").groupBy("_k").agg(F.min("node").alias(f"_n{i}"))
        out = out.withColumn("_k", left).join(keyed, "_k", "left").drop("_k")
    return out.select("id", F.coalesce("_n0", "_n1", "_n2").alias("node"))


def first_with_prefix(lines: DataFrame, prefix: str) -> DataFrame:
    """The first node, in file order, that equals or starts with `prefix`; lines is (line_no, node)."""
    return lines.filter(F.col("node").startswith(prefix)).agg(F.min_by("node", "line_no").alias("node"))
