"""Second-order biased random walks and skip-gram embeddings with negative sampling.

A step draws a neighbour by edge weight and accepts it with probability bias / largest bias (return 1/p, common neighbour 1, else 1/q), which gives the
second-order distribution without ever weighing all neighbours of a node. Draws come from alias tables, which are plain rows (cur,
part, slot, nxt, prob, other): the neighbours of a node are dealt by hash into parts of about `part`, a part is picked by its weight, then a slot of
its table. So neither building nor using a table brings the neighbours of a hub together. Uniform numbers are hashes of walk, step and attempt:
walks are reproducible, and both ways of walking give the same ones.

Skip-gram parameters lie in blocks of nodes. Pairs of centre and context are dealt to cells (block of the centre, block of the context), a round trains
the cells of one diagonal, each task with its two blocks to itself, and writes the blocks back; after as many rounds as there are blocks every
pair has been used. Negative samples are drawn from the cell's context block by count^0.75, from hashed numbers. A cell with more
than `cell_pairs` pairs (a hub's) is cut into slices of walks, which train copies whose changes are averaged. Pairs are made from the walks where they are used, and the
slices of a cell share a bounded number of tasks, so neither pairs nor a copy for each slice are rows. Centres that follow each other in walks are multiplied with all
their contexts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dropped, stored
from .ordered import positions
from .procrustes import _listed, vectors
from .ranked import grown, shrunk

_M1, _M2, _ADD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniforms(seed: int, which: int, *keys) -> np.ndarray:
    """Hashed numbers in [0, 1), one for each row of the keys (whole numbers or arrays of them)."""
    with np.errstate(over="ignore"):
        h = np.uint64(seed) * _M1 + np.uint64(which) * _ADD + _ADD
        for k in keys:
            h = _mix(np.atleast_1d(h) + _ADD + np.asarray(k).astype(np.int64).view(np.uint64) * _M2)
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def alias_table(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the slot's own item, the other item) by Vose's method."""
    n = len(w)
    scaled = (w * n / w.sum()).tolist()
    prob, other = [1.0] * n, list(range(n))
    less, more = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while less and more:
        i, j = less.pop(), more[-1]
        prob[i], other[i] = scaled[i], j
        scaled[j] -= 1 - scaled[i]
        if scaled[j] < 1:
            less.append(more.pop())
    return np.array(prob), np.array(other)


def alias_rows(adj: DataFrame, part: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(alias rows; nodes with their parts) of adj (cur, nxt, w), w > 0. A task never has more than a part of a node's neighbours."""
    degree = adj.groupBy("cur").agg(F.count(F.lit(1)).alias("n"))
    dealt = adj.join(degree, "cur").withColumn("part", F.pmod(F.xxhash64("nxt"), F.ceil(F.col("n") / part).cast("long")).cast("int"))
    kept = dealt.groupBy("cur", "part").agg(F.array_sort(F.collect_list(F.struct("nxt", F.col("w").cast("double").alias("w")))).alias("to"))

    def run(batches):
        for b in batches:
            cur, at, to = b.column("cur").to_pylist(), b.column("part").to_pylist(), b.column("to")
            for i in range(b.num_rows):
                each = to[i].values
                nxt, w = each.field("nxt"), each.field("w").to_numpy(zero_copy_only=False)
                prob, other = alias_table(w)
                k = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([cur[i]] * k, pa.int64()), pa.array([at[i]] * k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), nxt, pa.array(prob), nxt.take(pa.array(other)), pa.array(np.full(k, w.sum()))], ["cur", "part", "slot", "nxt", "prob", "other", "whole"])

    slots = stored(kept.mapInArrow(run, "cur long, part int, slot int, nxt long, prob double, other long, whole double"), "alias-rows")
    nodes = slots.groupBy("cur", "part").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("whole").alias("whole"))
    nodes = nodes.groupBy("cur").agg(F.array_sort(F.collect_list(F.struct("part", "n", "whole"))).alias("parts"))
    return slots, stored(nodes, "alias-nodes")


def biased_walks(edges: DataFrame, walks: int = 20, length: int = 50, p: float = 1.0, q: float = 0.7, seed: int = 42, part: int = 1024, held_edges: int = 2_000_000, tries: int = 4, cut: int = 4, block_edges: int = 1_000_000, hub_edges: int = 4_000_000) -> DataFrame:
    """(walk, nodes): `walks` walks of `length` nodes from every node of the undirected graph (a, b, w), w > 0; edges with a null end or weight are left out.

    While the graph has at most `held_edges` edges (counted both ways) its alias tables are broadcast and a walk is one task's work. Beyond, nodes lie in
    blocks of about `block_edges` edges, whose tables are packed once, and walkers move between the blocks (`_moved_walks`). Where a node has more than `hub_edges` neighbours, walkers
    advance by joins with the tables instead, `tries` draws a round, and what they have walked is stored every `cut` rounds.
    """
    given = edges.dropna(subset=["a", "b", "w"]).filter("w > 0")
    whole = isinstance(given.schema["a"].dataType, (T.IntegerType, T.LongType, T.ShortType))
    if whole:
        coded = given.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w")
    else:
        names = stored(positions(given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct(), "node"), "walk-names")
        coded = given.join(names.select(F.col("node").alias("a"), F.col("idx").cast("long").alias("_a")), "a").join(names.select(F.col("node").alias("b"), F.col("idx").cast("long").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w")
    adj = stored(coded.select(F.col("a").alias("cur"), F.col("b").alias("nxt"), "w").unionByName(coded.select(F.col("b").alias("cur"), F.col("a").alias("nxt"), "w")), "walk-edges")
    slots, nodes = alias_rows(adj, part)
    start = nodes.select("cur", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("_r")).select((F.col("cur") * walks + F.col("_r")).alias("walk"), "cur")
    n = adj.count()
    if n <= held_edges:
        out = _held_walks(start, adj, slots, nodes, length, p, q, seed)
    elif nodes.agg(F.max(F.aggregate("parts", F.lit(0), lambda s, x: s + x["n"]))).first()[0] <= hub_edges:
        out = _moved_walks(start, slots, n, length, p, q, seed, block_edges)
    else:
        out = _joined_walks(start, adj, slots, nodes, length, p, q, seed, tries, cut)
    if whole:
        return out.withColumn("nodes", F.col("nodes").cast(T.ArrayType(given.schema["a"].dataType)))
    each = out.select("walk", F.posexplode("nodes").alias("at", "idx")).join(names, "idx")
    return each.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("_n")).select("walk", F.transform("_n", lambda x: x["node"]).alias("nodes"))


def _held_walks(start: DataFrame, adj: DataFrame, slots: DataFrame, nodes: DataFrame, length: int, p: float, q: float, seed: int) -> DataFrame:
    t = slots.toArrow()  # at most held_edges rows
    cur, at, slot, nxt, prob, other = (t.column(c).to_numpy() for c in ("cur", "part", "slot", "nxt", "prob", "other"))
    order = np.lexsort((slot, at, cur))
    cur, at, nxt, prob, other = (x[order] for x in (cur, at, nxt, prob, other))
    ids = np.unique(cur)
    pairs = adj.select("cur", "nxt").toArrow()
    known = np.unique(np.searchsorted(ids, pairs.column("cur").to_numpy()) * len(ids) + np.searchsorted(ids, pairs.column("nxt").to_numpy()))
    first = np.flatnonzero(np.append(True, (cur[1:] != cur[:-1]) | (at[1:] != at[:-1]))) if len(cur) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(cur)))
    weights = {(r["cur"], x["part"]): x["whole"] for r in nodes.toLocalIterator() for x in r["parts"]}
    whole = np.array([weights[c, a] for c, a in zip(cur[first].tolist(), at[first].tolist(), strict=True)])
    owner = np.searchsorted(ids, cur[first])
    begin = np.searchsorted(owner, np.arange(len(ids) + 1))
    graph = adj.sparkSession.sparkContext.broadcast((ids, np.searchsorted(ids, nxt), prob, np.searchsorted(ids, other), first, size, whole, begin, known))
    most = max(1.0, 1 / p, 1 / q)

    def run(batches):
        ids, nxt, prob, other, first, size, whole, begin, known = graph.value
        cum = whole.cumsum()
        for b in batches:
            walk = b.column("walk").to_numpy()
            path = np.zeros((len(walk), length), np.int64)
            path[:, 0] = np.searchsorted(ids, b.column("cur").to_numpy())
            for step in range(1, length):
                todo, attempt = np.arange(len(walk)), 0
                while len(todo):
                    c, w = path[todo, step - 1], walk[todo]
                    u, v, x, y = (uniforms(seed, k, w, step, attempt) for k in range(4))
                    low = np.where(begin[c] > 0, cum[begin[c] - 1], 0.0)
                    one = np.minimum(np.maximum(np.searchsorted(cum, low + u * (cum[begin[c + 1] - 1] - low), "right"), begin[c]), begin[c + 1] - 1)
                    place = first[one] + np.minimum((v * size[one]).astype(np.int64), size[one] - 1)
                    to = np.where(x < prob[place], nxt[place], other[place])
                    if step == 1:
                        bias = np.full(len(to), most)
                    else:
                        prev = path[todo, step - 2]
                        code = prev * len(ids) + to
                        near = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
                        bias = np.where(to == prev, 1 / p, np.where(near, 1.0, 1 / q))
                    ok = y * most < bias
                    path[todo[ok], step] = to[ok]
                    todo, attempt = todo[~ok], attempt + 1
            yield pa.RecordBatch.from_arrays([pa.array(walk), pa.ListArray.from_arrays(pa.array(np.arange(len(walk) + 1, dtype=np.int32) * length), pa.array(ids[path].ravel()))], ["walk", "nodes"])

    return start.repartition("walk").mapInArrow(run, "walk long, nodes array<long>")


def _block_tables(slots: DataFrame, blocks: int) -> DataFrame:
    """(blk, and packed arrays): the alias tables of a block of nodes in one row. Nodes, their first part; parts, their first slot and weight; slots."""
    names = ["ids", "begin", "first", "whole", "nxt", "prob", "apart"]

    def run(t: pa.Table) -> pa.Table:
        cur, at, slot, nxt, prob, other, whole = (t.column(c).to_numpy() for c in ("cur", "part", "slot", "nxt", "prob", "other", "whole"))
        order = np.lexsort((slot, at, cur))
        cur, at, nxt, prob, other, whole = (x[order] for x in (cur, at, nxt, prob, other, whole))
        first = np.flatnonzero(np.append(True, (cur[1:] != cur[:-1]) | (at[1:] != at[:-1])))
        ids = np.unique(cur)
        begin = np.searchsorted(np.searchsorted(ids, cur[first]), np.arange(len(ids) + 1))
        cols = [ids, begin, np.append(first, len(cur)), whole[first], nxt, prob, other - nxt]
        return pa.table({"blk": t.column("blk").slice(0, 1), **{n: pa.array([shrunk(x)], pa.binary()) for n, x in zip(names, cols, strict=True)}, "n": pa.array([[len(x) for x in cols]], pa.list_(pa.int64()))})

    dealt = slots.withColumn("blk", F.pmod(F.xxhash64("cur"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("blk").applyInArrow(run, f"blk int, {', '.join(f'{n} binary' for n in names)}, n array<bigint>"), "walk-blocks")


def _moved_walks(start: DataFrame, slots: DataFrame, edges: int, length: int, p: float, q: float, seed: int, block_edges: int) -> DataFrame:
    """A walker goes on in a block until it leaves it. Whether a draw is a neighbour of the node before is asked only if acceptance depends on it, and where the
    draw lies, as edges run both ways: if it is turned down, the walker goes back for its next attempt. So a round moves each walker once, with six numbers."""
    spark = start.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as given: walkers are few bytes
    blocks = max(-(-edges // block_edges), min(parts, 2 * spark.sparkContext.defaultParallelism, edges))
    tables = _block_tables(slots, blocks)
    most, least, larger = max(1.0, 1 / p, 1 / q), min(1.0, 1 / q), max(1.0, 1 / q)
    state = ["walk", "at", "cur", "prev", "step", "attempt", "pending"]

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        walk, at, cur, prev, step, attempt, pending = (left.column(c).to_numpy().copy() for c in state)
        names = ("ids", "begin", "first", "whole", "nxt", "prob", "apart")
        kinds = (np.int64, np.int64, np.int64, float, np.int64, float, np.int64)
        sizes = right.column("n")[0].as_py() if right.num_rows else [0] * 7
        ids, begin, first, whole, nxt, prob, apart = (grown(right.column(c)[0].as_py(), n, 8).view(k) if right.num_rows else np.zeros(0, k) for c, n, k in zip(names, sizes, kinds, strict=True))
        cum = whole.cumsum()
        found = []

        def here(i):
            return ids[np.minimum(np.searchsorted(ids, at[i]), len(ids) - 1)] == at[i]

        def accept(i, to):
            found.append((i, step[i].copy(), to))
            prev[i], cur[i], at[i] = cur[i], to, to
            step[i] += 1
            attempt[i], pending[i] = 0, False

        def neighbours(node, other):
            """Whether `other` is among the neighbours of each node; they are sorted within a part."""
            n, out = np.searchsorted(ids, node), np.zeros(len(node), bool)
            one, last = begin[n], begin[n + 1]
            while (todo := np.flatnonzero((one < last) & ~out)).size:
                lo, hi = first[one[todo]], first[one[todo] + 1]
                end = hi
                while (lo < hi).any():
                    mid = (lo + hi) // 2
                    less = (lo < hi) & (nxt[np.minimum(mid, len(nxt) - 1)] < other[todo])
                    lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
                out[todo] = (lo < end) & (nxt[np.minimum(lo, len(nxt) - 1)] == other[todo])
                one = one + 1
            return out

        live = np.arange(len(walk))
        while len(live):
            asked = live[pending[live]]
            if len(asked):
                ok = neighbours(at[asked], prev[asked]) == (1.0 > 1 / q)
                accept(asked[ok], at[asked[ok]])
                back = asked[~ok]
                at[back], pending[back] = cur[back], False
                attempt[back] += 1
            live = live[(step[live] < length) & here(live)]
            c = np.searchsorted(ids, at[live])
            u, v, x, y = (uniforms(seed, k, walk[live], step[live], attempt[live]) if len(live) else np.zeros(0) for k in range(4))
            low = np.where(begin[c] > 0, cum[begin[c] - 1], 0.0)
            one = np.minimum(np.maximum(np.searchsorted(cum, low + u * (cum[begin[c + 1] - 1] - low), "right"), begin[c]), begin[c + 1] - 1)
            size = first[one + 1] - first[one]
            place = first[one] + np.minimum((v * size).astype(np.int64), size - 1)
            to = np.where(x < prob[place], nxt[place], nxt[place] + apart[place])
            level = y * most
            back = (to == prev[live]) & (step[live] > 1)
            ok = np.where(step[live] == 1, True, np.where(back, level < 1 / p, level < least))
            ask = ~ok & ~back & (level < larger)
            attempt[live[~ok & ~ask]] += 1
            at[live[ask]], pending[live[ask]] = to[ask], True
            accept(live[ok], to[ok])
            live = live[(step[live] < length) & here(live)]
        i, s, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((s, i))
        tail = pa.ListArray.from_arrays(np.append(0, np.bincount(i, minlength=len(walk)).cumsum()).astype(np.int32), pa.array(n[order], pa.int64()))
        return pa.table({**dict(zip(state, (walk, at, cur, prev, step, attempt, pending), strict=True)), "tail": tail})

    kinds = "walk long, at long, cur long, prev long, step int, attempt int, pending boolean"
    front = start.select("walk", F.col("cur").alias("at"), "cur", F.lit(0).cast("long").alias("prev"), F.lit(1).alias("step"), F.lit(0).alias("attempt"), F.lit(False).alias("pending"))
    done, n = start.select("walk", F.lit(0).alias("leg"), F.array("cur").alias("tail")), 0
    right = tables.repartition(parts, "blk")
    while front.take(1):
        n += 1
        left = front.withColumn("blk", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")).repartition(parts, "blk")
        moved = stored(left.groupBy("blk").cogroup(right.groupBy("blk")).applyInArrow(meet, f"{kinds}, tail array<bigint>"), "walk-front")
        done = done.unionByName(moved.filter(F.size("tail") > 0).select("walk", F.lit(n).alias("leg"), "tail"))
        front = moved.filter(F.col("step") < length).drop("tail")
    legs = done.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("leg", "tail"))).alias("parts"))
    return legs.select("walk", F.flatten(F.transform("parts", lambda x: x["tail"])).alias("nodes"))


def _joined_walks(start: DataFrame, adj: DataFrame, slots: DataFrame, nodes: DataFrame, length: int, p: float, q: float, seed: int, tries: int, cut: int) -> DataFrame:
    most = max(1.0, 1 / p, 1 / q)
    near = adj.select(F.col("cur").alias("prev"), "nxt", F.lit(True).alias("common")).distinct()
    front = start.select("walk", "cur", F.lit(None).cast("long").alias("prev"), F.lit(1).alias("step"), F.lit(0).alias("attempt"), F.array("cur").alias("tail"))

    def drawn(batches):
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            walk, step, attempt = (cols[c].to_numpy(zero_copy_only=False) for c in ("walk", "step", "attempt"))
            for k in range(tries):
                us = [pa.array(uniforms(seed, i, walk, step, attempt + k)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(np.full(len(walk), k, np.int32)), *us], [*cols, "k", "u", "v", "x", "y"])

    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["whole"])
    sums = F.aggregate("parts", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x["whole"])))
    done, n = None, 0
    while True:
        active = front.filter(F.col("step") < length)
        c = active.mapInArrow(drawn, "walk long, cur long, prev long, step int, attempt int, tail array<long>, k int, u double, v double, x double, y double")
        c = c.join(nodes, "cur").withColumn("_cum", sums).withColumn("_at", F.least(F.size(F.filter("_cum", lambda s: s <= F.col("u") * total)), F.size("parts") - 1))
        c = c.withColumn("_part", F.col("parts")[F.col("_at")]).withColumns({"part": F.col("_part.part"), "slot": F.least(F.floor(F.col("v") * F.col("_part.n")).cast("int"), F.col("_part.n") - 1)})
        c = c.drop("parts", "_cum", "_at", "_part", "u", "v").join(slots, ["cur", "part", "slot"]).withColumn("nxt", F.when(F.col("x") < F.col("prob"), F.col("nxt")).otherwise(F.col("other")))
        c = c.join(near, ["prev", "nxt"], "left")
        bias = F.when(F.col("prev").isNull(), most).when(F.col("nxt") == F.col("prev"), 1.0 / p).when(F.col("common"), 1.0).otherwise(1.0 / q)
        first = F.min(F.when(F.col("y") * most < bias, F.struct("k", "nxt")))
        moved = c.groupBy("walk", "cur", "prev", "step", "attempt").agg(first.alias("_to"), F.first("tail").alias("tail"))
        ok = F.col("_to").isNotNull()
        moved = moved.select("walk", F.when(ok, F.col("_to.nxt")).otherwise(F.col("cur")).alias("cur"), F.when(ok, F.col("cur")).otherwise(F.col("prev")).alias("prev"), F.when(ok, F.col("step") + 1).otherwise(F.col("step")).alias("step"), F.when(ok, 0).otherwise(F.col("attempt") + tries).alias("attempt"), F.when(ok, F.concat("tail", F.array("_to.nxt"))).otherwise(F.col("tail")).alias("tail"))
        front = moved.unionByName(front.filter(F.col("step") >= length))
        n += 1
        if n % cut == 0 or n >= length - 1:
            front = stored(front, "walk-front")
            part = front.select("walk", F.lit(n).alias("leg"), "tail")
            done = part if done is None else done.unionByName(part)
            front = front.filter(F.col("step") < length).withColumn("tail", F.array().cast("array<long>"))
            if not front.take(1):
                break
    parts = done.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("leg", "tail"))).alias("parts"))
    return parts.select("walk", F.flatten(F.transform("parts", lambda x: x["tail"])).alias("nodes"))


# ---- skip-gram ----------------------------------------------------------------------------------


def _add_at(m: np.ndarray, at: np.ndarray, rows: np.ndarray, rounds: int = 24) -> None:
    """Adds rows to m at places that may repeat: first comers, then second ones; where a place comes often, sums by place."""
    order = np.argsort(at, kind="stable")
    of = at[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    times = np.diff(np.append(first, len(of)))
    if times.max(initial=0) > rounds:
        m[of[first]] += np.add.reduceat(rows[order], first, axis=0)
        return
    for r in range(times.max(initial=0)):
        mine = order[first[times > r] + r]
        m[at[mine]] += rows.take(mine, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * x.dtype.type(0.5))
    x += 1
    x *= x.dtype.type(0.5)
    return x


def _train(centre: np.ndarray, context: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, weight: np.ndarray, rate: float, negative: int, seed: int, batch: int = 4096, shared: int = 64, chunk: int = 64) -> None:
    """Steps of the negative-sampling loss, in place, over pairs (places in centre, rising, and in context) of tokens (places in a and b). `chunk`
    centres share `shared` negatives, which count as `negative` a pair, and are multiplied with all contexts that one of them has, so a token's row is read and added to once
    a chunk, whatever its pairs. Where a token is frequent, batches have fewer pairs."""
    if not len(pairs[0]):
        return
    one, other = pairs
    cum, kind = weight.cumsum(), a.dtype.type
    batch = int(min(batch, max(128, 4 * len(one) / max(np.bincount(centre[one]).max(), np.bincount(context[other]).max()))))
    many = np.bincount(one, minlength=len(centre))
    upto = many.cumsum()
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], batch), "right"), len(centre)))
    is_neg = np.zeros(len(b), bool)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        begin, end = upto[lo] - many[lo], upto[hi - 1]
        if begin == end:
            continue
        p, q = one[begin:end], other[begin:end]
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        i, m = centre[p[first]], np.diff(np.append(first, len(p)))
        p = np.repeat(np.arange(len(first)), m)
        part, row = p // chunk, p % chunk
        key = part * len(context) + q
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        own, j = key[starts] // len(context), context[key[starts] % len(context)]  # contexts by chunk
        place = np.arange(len(own)) - np.searchsorted(own, np.arange(part[-1] + 1))[own]
        col = np.empty(len(p), np.int64)
        col[order] = place[new.cumsum() - 1]
        x, y = np.zeros((part[-1] + 1, chunk, a.shape[1]), a.dtype), np.zeros((part[-1] + 1, place.max() + 1, a.shape[1]), a.dtype)
        flat = x.reshape(-1, a.shape[1])[: len(i)]
        flat[:] = a.take(i, axis=0)
        y[own, place] = b.take(j, axis=0)
        score = x @ y.transpose(0, 2, 1)
        g = np.zeros_like(score)
        g[part, row, col] = _sigmoid(-score[part, row, col]) * kind(rate)
        parts = len(x)
        neg = np.minimum(np.searchsorted(cum, uniforms(seed, 7, np.arange(parts * shared), begin) * cum[-1], "right"), len(cum) - 1).reshape(parts, shared)
        z = b.take(neg, axis=0)
        h = _sigmoid(x @ z.transpose(0, 2, 1))
        each = h.reshape(-1, shared)
        each[: len(i)] *= (m * (-rate * negative / shared)).astype(a.dtype)[:, None]
        is_neg[neg] = True
        same = np.flatnonzero(is_neg[context[q]])  # a context is no negative of itself
        is_neg[neg] = False
        if len(same):
            rows, of = np.unique(p[same], return_inverse=True)
            met = np.zeros((len(rows), shared))
            np.add.at(met, of, context[q[same], None] == neg[p[same] // chunk])
            each[rows] *= (1 - met / m[rows, None]).astype(a.dtype)
        da, db, dz = g @ y + h @ z, (g.transpose(0, 2, 1) @ x)[own, place], h.transpose(0, 2, 1) @ x
        _add_at(a, i, da.reshape(-1, a.shape[1])[: len(i)])
        _add_at(b, np.append(j, neg), np.concatenate([db, dz.reshape(-1, a.shape[1])]))


def _window_places(walk: pa.Array, t: pa.ListArray, window: int, seed: int, blocks: int = 1, bi: int = 0, bj: int = 0) -> tuple[np.ndarray, ...]:
    """(walk, token, s, other, one, two): of all tokens of all walks, the places s of those in block bi that have contexts and the places `other` of those in block bj, and the
    pairs of centre and context as places in these two, by rising centre; the window of a centre is drawn from 1 to `window`, as is usual."""
    n = t.value_lengths().to_numpy(zero_copy_only=False)
    token, w = t.flatten().to_numpy(zero_copy_only=False), np.repeat(walk.to_numpy(zero_copy_only=False), n)
    at = np.arange(len(token)) - np.repeat(n.cumsum() - n, n)
    left = np.repeat(n, n) - at
    s, on = np.flatnonzero(token % blocks == bi), token % blocks == bj
    reach = 1 + np.floor(uniforms(seed, 3, w[s], at[s]) * window).astype(np.int64) if len(s) else s
    far, back = np.minimum(reach, left[s] - 1), np.minimum(reach, at[s])
    offsets = [o for d in range(1, window + 1) for o in (d, -d)]
    mask = np.empty((len(s), len(offsets)), bool)
    for k, o in enumerate(offsets):
        mask[:, k] = ((far if o > 0 else back) >= abs(o)) & on[np.clip(s + o, 0, max(0, len(on) - 1))] if len(s) else False
    one, k = np.nonzero(mask)
    return w, token, s, np.flatnonzero(on), one, (on.cumsum() - 1)[s[one] + np.array(offsets)[k]]


def _window_pairs(walk: pa.Array, t: pa.ListArray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(walk, centre, context) of all pairs of all walks."""
    w, token, s, other, one, two = _window_places(walk, t, window, seed)
    return w[s[one]], token[s[one]], token[other[two]]


def _cell_step(at: int, rate: float, negative: int, seed: int, window: int, blocks: int, bundles: int):
    """The function that trains a bundle of slices of a cell, walks in hashed order: left their walks, right the two blocks of parameters. Every slice trains a copy; the bundle gives
    its share of the mean over all slices."""

    def trained(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bi, bj, bundle = (k.as_py() for k in key)
        side, no, c = (right.column(x).to_numpy() for x in ("side", "no", "c"))
        v = vectors(right.column("v")).astype(np.float32)
        parts = []
        for s in (0, 1):
            on = np.flatnonzero(side == s)
            parts.append(on[np.argsort(no[on])])
        a, b, place = v[parts[0]], v[parts[1]], np.zeros((2, no.max(initial=0) + 1), np.int64)
        for s in (0, 1):
            place[s, no[parts[s]]] = np.arange(len(parts[s]))
        n_slices = right.column("n_slices")[0].as_py() if right.num_rows else 1
        slices, mean = left.column("slice").to_numpy(), [np.zeros_like(a), np.zeros_like(b)]
        for s in range(bundle, n_slices, bundles):
            x, y, mine = a.copy(), b.copy(), left.take(pa.array(np.flatnonzero(slices == s))).combine_chunks()
            if mine.num_rows:
                walk = mine.column("walk").to_numpy()
                mine = mine.take(pa.array(np.lexsort((walk, uniforms(seed, 5, walk, at))))).combine_chunks()
                _, token, ones, others, one, two = _window_places(mine.column("walk").combine_chunks(), mine.column("t").combine_chunks(), window, seed, blocks, bi, bj)
                _train(place[0, token[ones] // blocks], place[1, token[others] // blocks], (one, two), x, y, c[parts[1]] ** 0.75, rate, negative, seed + at)
            mean[0] += x / n_slices
            mean[1] += y / n_slices
        return pa.table({"side": np.repeat([0, 1], [len(a), len(b)]).astype(np.int32), "no": np.concatenate([no[parts[0]], no[parts[1]]]), "v": _listed(np.concatenate(mean))})

    return trained


def _coded_walks(walks: DataFrame, code: DataFrame, most: int) -> DataFrame:
    """(walk, t): walks by the codes (gene, no) of their nodes, which are below `most`."""
    t = code.toArrow().sort_by("gene")
    known = walks.sparkSession.sparkContext.broadcast((t.column("gene").to_numpy(), t.column("no").to_numpy().astype(np.int32 if most < 1 << 31 else np.int64)))

    def run(batches):
        genes, no = known.value
        for b in batches:
            t = b.column("nodes")
            yield pa.RecordBatch.from_arrays([b.column("walk"), pa.ListArray.from_arrays(np.append(0, t.value_lengths().to_numpy().cumsum()).astype(np.int32), pa.array(no[np.searchsorted(genes, t.flatten().to_numpy())]))], ["walk", "t"])

    return walks.select(F.xxhash64("walk").alias("walk"), F.filter("nodes", lambda x: x.isNotNull()).alias("nodes")).mapInArrow(run, f"walk long, t array<{'int' if most < 1 << 31 else 'bigint'}>")


def skip_gram(walks: DataFrame, dim: int = 128, window: int = 5, epochs: int = 10, negative: int = 5, seed: int = 42, rate: float = 0.025, cell_pairs: int = 2_000_000, block_nodes: int = 100_000, held_bytes: int = 64 << 20) -> DataFrame:
    """(gene, v) from walks of nodes (walk, nodes), deterministic by seed. Whole-number nodes of up to `held_bytes` are coded by a broadcast table, others by a join."""
    kind = walks.schema["nodes"].dataType.elementType
    counts = stored(walks.select(F.explode("nodes").alias("gene")).groupBy("gene").agg(F.count(F.lit(1)).alias("c")), "gram-counts")
    genes = counts.count()
    blocks = max(1, -(-genes // block_nodes))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = stored(positions(counts, "gene").withColumn("blk", block(F.col("gene"))), "gram-nodes").withColumnRenamed("idx", "no")
    code = placed.select("gene", (F.col("no") * blocks + F.col("blk")).cast("long").alias("no"))
    if 16 * genes <= held_bytes and isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        coded = _coded_walks(walks, code, genes * blocks)
    else:
        tokens = walks.select("walk", F.posexplode("nodes").alias("at", "gene")).join(code, "gene")
        coded = tokens.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("at", "no"))).alias("t")).select(F.xxhash64("walk").alias("walk"), F.transform("t", lambda x: x["no"]).alias("t"))
    coded = stored(coded, "gram-walks")

    def counted(batches):
        n = np.zeros((blocks, blocks), np.int64)
        for b in batches:
            _, i, j = _window_pairs(b.column("walk"), b.column("t"), window, seed)
            n += np.bincount(i % blocks * blocks + j % blocks, minlength=blocks**2).reshape(blocks, blocks)
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[i, j])], ["bi", "bj", "n"])

    cells = {(r["bi"], r["bj"]): r["n"] for r in coded.mapInArrow(counted, "bi int, bj int, n long").groupBy("bi", "bj").agg(F.sum("n").alias("n")).collect()}  # blocks^2
    slices = {k: max(1, -(-n // cell_pairs)) for k, n in cells.items()}
    most = max(slices.values(), default=1)
    n_slices = F.coalesce(*[F.when((F.col("bi") == i) & (F.col("bj") == j), F.lit(s)) for (i, j), s in slices.items() if s > 1], F.lit(1)) if most > 1 else F.lit(1)
    bundles = max(1, -(-2 * walks.sparkSession.sparkContext.defaultParallelism // blocks))  # tasks of a cell, each with its slices one after the other

    def begun(batches):
        for b in batches:
            no = b.column("no").to_numpy()
            a = np.stack([uniforms(seed, 11, no, i) for i in range(dim)], 1) - 0.5 if len(no) else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([b.column("no"), b.column("blk"), b.column("c"), _listed(a / dim), _listed(np.zeros((len(no), dim)))], ["no", "blk", "c", "a", "b"])

    params = stored(placed.select(F.col("no").cast("long").alias("no"), "blk", "c").mapInArrow(begun, "no long, blk int, c long, a array<float>, b array<float>"), "gram-params")
    kinds = "side int, no long, v array<float>"
    for epoch in range(epochs):
        for shift in range(blocks):
            at = epoch * blocks + shift
            lr = max(rate * 1e-2, rate * (1 - at / (epochs * blocks)))
            mine = coded.withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("bj", F.pmod(F.col("bi") + shift, F.lit(blocks)))
            mine = mine.withColumn("slice", F.pmod(F.xxhash64("walk"), n_slices.cast("long")).cast("int")).withColumn("bundle", F.pmod("slice", F.lit(bundles)))
            copies = F.explode(F.sequence(F.lit(0), F.least(n_slices, F.lit(bundles)) - 1))
            ins = params.select(F.col("blk").alias("bi"), F.pmod(F.col("blk") + shift, F.lit(blocks)).alias("bj"), F.lit(0).alias("side"), "no", "c", F.col("a").alias("v"))
            outs = params.select(F.pmod(F.col("blk") - shift, F.lit(blocks)).alias("bi"), F.col("blk").alias("bj"), F.lit(1).alias("side"), "no", "c", F.col("b").alias("v"))
            both = ins.unionByName(outs).withColumns({"n_slices": n_slices, "bundle": copies})

            keys, parts = ["bi", "bj", "bundle"], 4 * blocks * bundles  # more than keys, so that few share a task
            left, right = mine.select(*keys, "slice", "walk", "t").repartition(parts, *keys), both.repartition(parts, *keys)
            new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cell_step(at, lr, negative, seed, window, blocks, bundles), kinds)
            if most > 1:
                new = new.groupBy("side", "no").agg(*[F.sum(F.col("v")[i]).alias(f"_v{i}") for i in range(dim)]).select("side", "no", F.array(*[f"_v{i}" for i in range(dim)]).cast("array<float>").alias("v"))
            new = stored(new, "gram-new")
            a, b = new.filter("side = 0").select("no", F.col("v").alias("a")), new.filter("side = 1").select("no", F.col("v").alias("b"))
            nxt = stored(params.drop("a", "b").join(a, "no").join(b, "no"), "gram-params")
            dropped(params, new)
            params = nxt
    out = params.select("no", F.col("a").cast("array<float>").alias("v")).join(placed.select(F.col("no").cast("long").alias("no"), F.col("gene").cast(kind).alias("gene")), "no").select("gene", "v")
    return out
