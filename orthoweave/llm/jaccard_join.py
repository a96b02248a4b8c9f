"""N-gram Jaccard join by parity sketches.

A document's set of word shingles (64-bit hashes) is XOR-hashed into a bit sketch: every shingle flips one bit, so the Hamming
distance of two sketches is a lower bound of the sets' symmetric difference. For sizes x and y and similarity J the difference of
a linked pair is at most D = (x+y)(1-J)/(1+J). Sketches are cut into chunks (kept sparse, 2^32 bits each, so that only equal
parities are equal chunks), and a pair that differs in D bits differs in at most D chunks.

Size bands: sets of 64 to 256 shingles share one number of chunks, those up to 1024 the next, and so on by factors of 4; a
scheme around each border serves pairs that straddle it, and sets below 80 use one chunk a shingle. Within its scheme a set
emits, in chunk order, its first d+1+c chunks that are not empty, d being D for its largest possible partner and
c = x/20. Of a linked pair, the set whose prefix ends first differs from the other in at most D of these chunks, so at least
c(min)+1 keys of the pair agree (the pigeonhole). Small sets emit all chunks, and as many keys agree as shingles must.
Hence a set that shares fewer keys than this with anything has no partner; this drops nearly all sets, common passages
included, before any pair is formed.

For the sets that remain, shingles that no other of them has are counted: a set with t of them shares at most x-t with any
partner, which has to be enough for the pair's sizes. This drops distant copies, however many there are of a text.
Of the sets that still remain, each is verified against the most central set of its buckets (the one whose keys are shared most), and
then, in buckets that still hold several components, against a few members drawn by a hash: this connects groups of near
copies in linear time. Last, every pair that shares a bucket and still lies in different components is formed, on each set's
rarer keys: if m keys must agree, the m-1 commonest keys of a set can be left out. The Hamming distance of whole bit sketches
(2 to 8 bits a shingle, one length a scheme) is a condition of that join, so that it gives only pairs within D; an exact
intersection of the shingle sets verifies them.

Equal sets are one node (a 64-bit hash of the set), so copies are never expanded into pairs.

Defined results: null and empty texts, and texts of white space, have n_shingles 0 and link with nothing (equal ones
neither); texts of fewer than five words have one shingle, the whole sequence; repeated ids are rows of their own that share their
component; an empty table gives an empty result; other columns are ignored. Hash collisions (of 64-bit shingles within a pair, or
of two sets among all) are the only inexactness.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, discard, small, stash, text_batches, trimmed
from .components import components

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(64)], np.uint64)
FLAT = 1 << 32  # chunks of the scheme for small sets: one for each shingle


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words: _Words, n: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    # bytes.lower and bytes.split act on A-Z and on the six ASCII white-space bytes only
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array([words[w] for w in tokens], np.uint64)
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc += mix(h[i : len(h) - k + 1 + i] + _POS[i]) * _POS[i]
    return np.unique(mix(acc))


def reach(x: int, num: int, den: int) -> int:
    """The largest symmetric difference of a set of x with any set that links with it."""
    return (x + x * den // num) * (den - num) // (den + num)


def emitted(x: int, chunks: int, num: int, den: int) -> tuple[int, int]:
    """(keys that a set of x emits in a scheme, keys that it shares with any set that it links with)."""
    small = -(-x * num // den)  # its smallest partner
    if chunks == FLAT:
        return x, -(-num * (x + small) // (num + den))
    return reach(x, num, den) + 1 + x // 20, small // 20 + 1


def schemes(x: int, num: int, den: int) -> list[tuple[int, int]]:
    """(tag, chunks) of the one or two schemes that a set of x takes part in: 0 flat, 1 band, 2 edge; none is both flat and on an edge."""
    out = []
    if x * num < 64 * den:
        out.append((0, FLAT))
    top = 64
    if x >= 64:
        while top <= x:
            top *= 4
        out.append((1, -(-top * 2 // 5)))
        for edge in (top // 4, top):
            if edge > 64 and num * edge <= den * x and num * x < den * edge:
                out.append((2, edge * den // num * 2 // 5))
    return out


def sketch_keys(s: np.ndarray, tag: int, chunks: int, limit: int) -> np.ndarray:
    """Keys of the first `limit` chunks of the parity sketch that are not empty."""
    chunk = s >> np.uint64(32) if chunks == FLAT else ((s >> np.uint64(32)) * np.uint64(chunks)) >> np.uint64(32)
    bit = s & np.uint64(0xFFFFFFFF)
    order = np.argsort(chunk, kind="stable")
    chunk, code = chunk[order], mix((chunk[order] << np.uint64(32) | bit[order]) + np.uint64(77))
    starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    parity = np.bitwise_xor.reduceat(code, starts)
    full = parity != 0
    parity, at = parity[full][:limit], chunk[starts][full][:limit]
    return mix(parity ^ mix(at * _POS[5] + np.uint64(tag * 1_000_003 + chunks)))


def texts_of(column: pa.Array, step: int = 256):
    """The texts of a column, a few at a time in Python."""
    for lo in range(0, len(column), step):
        yield from column.slice(lo, step).to_pylist()
    pa.default_memory_pool().release_unused()


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Combiner:
    """Values of sets on their way to a count of those that no other set has. A flush gives a row for each bucket of values: the sets
    seen, and for each distinct value 48 bits of it and which of these sets has it (SEVERAL: more than one), so a value that many
    sets share crosses the network once a flush. Values that agree in 48 bits count as one, which only ever keeps more sets alive."""

    SEVERAL, LOW = 65535, np.uint64(2**48 - 1)
    SCHEMA = "bucket int, sids binary, owner binary, vals binary"

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.sids, self.values, self.n = {}, [], 0

    def add(self, sid: int, values: np.ndarray) -> None:
        if sid not in self.sids:  # a copy adds nothing
            self.sids[sid] = len(self.sids)
            self.values.append(values.view(np.uint64))
            self.n += len(values)

    def full(self) -> bool:
        return self.n > 400_000 or len(self.sids) >= self.SEVERAL

    def flush(self) -> list[list]:
        """Columns of SCHEMA."""
        out = [[], [], [], []]
        if self.n:
            sids = np.fromiter(self.sids, np.int64, len(self.sids))
            v = np.concatenate(self.values) & self.LOW
            owner = np.repeat(np.arange(len(sids)), [len(x) for x in self.values])
            order = np.argsort(v)
            v, owner = v[order], owner[order]
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            several = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
            v, owner = v[starts], np.where(several, -1, owner[starts])
            bucket = ((v >> np.uint64(16)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)  # rises with the value
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            low, high = v.astype("<u4"), (v >> np.uint64(32)).astype("<u2")
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(v)], strict=True):
                seen, at = np.unique(owner[lo:hi], return_inverse=True)
                if seen[0] < 0:
                    seen, at = seen[1:], np.where(at == 0, self.SEVERAL, at - 1)
                out[0].append(int(bucket[lo]))
                out[1].append(sids[seen].tobytes()), out[2].append(at.astype("<u2").tobytes()), out[3].append(low[lo:hi].tobytes() + high[lo:hi].tobytes())
        self.clear()
        return out


def _single(held: list[tuple]) -> Counts:
    """Of a bucket's rows (sids, owner, vals): each set with how many even and odd values only it has."""
    vals, owners, several = [], [], []
    for sids, owner, raw in held:
        ids, at = np.frombuffer(sids, np.int64), np.frombuffer(owner, "<u2")
        n = len(at)
        vals.append(np.frombuffer(raw[4 * n :], "<u2").astype(np.uint64) << np.uint64(32) | np.frombuffer(raw[: 4 * n], "<u4").astype(np.uint64))
        several.append(at == Combiner.SEVERAL)
        owners.append(ids[np.where(several[-1], 0, at)] if len(ids) else np.zeros(n, np.int64))
    v, sid, many = np.concatenate(vals), np.concatenate(owners), np.concatenate(several)
    order = np.argsort(v)
    v, sid, many = v[order], sid[order], many[order]
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    lo, hi = np.minimum.reduceat(sid, starts), np.maximum.reduceat(sid, starts)
    alone = (lo == hi) & ~np.logical_or.reduceat(many, starts)
    odd = (v[starts][alone] & np.uint64(1)).astype(np.int64)
    ids, at = np.unique(lo[alone], return_inverse=True)
    return ids, np.bincount(at, 1 - odd, len(ids)).astype(np.int64), np.bincount(at, odd, len(ids)).astype(np.int64)


COUNTED = ["bucket", "sids", "lone0", "lone1"]


def lone_values(packed: DataFrame, buckets: int, carried: str = "") -> DataFrame:
    """How many values, by their lowest bit, no other set has, of rows of Combiner.SCHEMA: rows of COUNTED, in which a task has packed its
    sums by bucket of the set (for `lone_sums`). Rows that have no vals bring their `carried` columns instead. A task holds one bucket of
    values at a time."""
    names = [c.split()[0].strip("`") for c in carried.split(", ")] if carried else []
    buckets = max(1, buckets * 3 // 8)  # of sets: every task has a row for each

    def run(batches):
        held, bucket, found, n, schema = [], None, [], 0, None
        for b in batches:
            schema = b.schema
            for x, *row in zip(*[b.column(c).to_pylist() for c in PACKED], strict=True):
                if row[2] is not None:
                    if x != bucket and held:
                        found.append(_single(held))
                        n += len(found[-1][0])
                        held = []
                    bucket = x
                    held.append(row)
            if n > 1_000_000:  # a set has values in many buckets
                found = [_added(found)]
                n = len(found[0][0])
                if n > 500_000:
                    yield _counted(found[0], buckets, schema, names)
                    found, n = [], 0
            if names:
                docs = b.filter(b.column("vals").is_null()) if b.column("vals").null_count else b.slice(0, 0)
                none = [pa.nulls(docs.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*[docs.column(c) for c in names], *none], [*names, *COUNTED])
        if held:
            found.append(_single(held))
        if found:
            yield _counted(_added(found), buckets, schema, names)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(run), (carried + ", " if carried else "") + "bucket int, sids binary, lone0 binary, lone1 binary")


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # sid, lone0, lone1


def _added(found: list[Counts]) -> Counts:
    ids, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return ids, *(np.bincount(at, np.concatenate([f[i] for f in found]), len(ids)).astype(np.int64) for i in (1, 2))


def _counted(found: Counts, buckets: int, schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    at = found[0] % buckets
    order = np.argsort(at, kind="stable")
    at, (sid, zero, one) = at[order], (x[order] for x in found)
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() if len(at) else []
    spans = list(zip(cuts, [*cuts[1:], len(at)], strict=True))
    columns = [pa.array([int(at[lo]) for lo, _ in spans], pa.int32()), *[pa.array([x[lo:hi].astype(t).tobytes() for lo, hi in spans], pa.binary()) for x, t in ((sid, "<i8"), (zero, "<u4"), (one, "<u4"))]]
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(spans), schema.field(c).type) for c in names], *columns], [*names, *COUNTED])


def lone_sums(counted: DataFrame) -> DataFrame:
    """sid, lone0, lone1, one row a set, of rows of COUNTED."""

    def run(batches):
        held, bucket = [], None

        def out():
            ids, zero, one = _added(held)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(zero), pa.array(one)], ["sid", "lone0", "lone1"])

        for b in batches:
            for x, *row in zip(*[b.column(c).to_pylist() for c in COUNTED], strict=True):
                if x != bucket and held:
                    yield out()
                    held = []
                bucket = x
                held.append(tuple(np.frombuffer(v, t) for v, t in zip(row, ("<i8", "<u4", "<u4"), strict=True)))
        if held:
            yield out()

    return counted.select(*COUNTED).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), "sid long, lone0 long, lone1 long")


def buckets_of(df: DataFrame) -> int:
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sketches(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, n: int) -> DataFrame:
    """A row for each document: _id, n_shingles, sid (hash of the set), need0 and need1 (how many keys of either scheme a link has in
    common; 0: not in that scheme), k0 and k1 (keys emitted), and rows of COUNTED alone, which add up to the keys of a set that no
    other set has."""
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = buckets_of(docs)
    carried = f"_id {kind}, n_shingles long, sid long, need0 int, need1 int, k0 int, k1 int"
    names = [c.split()[0] for c in carried.split(", ")]

    def run(batches):
        words, keys, seen = _Words(), Combiner(buckets), 0
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]

        def packed(rows, ids):
            m = len(rows[0])
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]], *[pa.nulls(m, t) for t in (ids.type, *types)]], [*PACKED, *names])

        for b in batches:
            rows = []
            with np.errstate(over="ignore"):
                for text in texts_of(b.column(1)):
                    s = shingles(text, words, n)
                    x = len(s)
                    sid = set_id(s) if x else 0
                    own, least = keys_of(s, num, den)
                    if x:
                        keys.add(sid, own)
                    k1 = int((own & 1).sum())
                    seen += 1
                    rows.append((seen % buckets, x, sid, *least, len(own) - k1, k1))
                    if keys.full():
                        yield packed(keys.flush(), b.column(0))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            none = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), none, none, none, b.column(0), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], [*PACKED, *names])
        if keys.n:
            yield packed(keys.flush(), b.column(0))

    return lone_values(docs.select(id_col, text_col).mapInArrow(trimmed(run), f"{Combiner.SCHEMA}, {carried}"), buckets, carried)


PACKED = ["bucket", "sids", "owner", "vals"]


def keys_of(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """The keys that a set emits (lowest bit: its scheme's, the same for all sets), and how many of either scheme a link has in common."""
    got, least = [], [0, 0]
    for tag, chunks in schemes(len(s), num, den) if len(s) else []:
        limit, least[tag & 1] = emitted(len(s), chunks, num, den)
        got.append(sketch_keys(s, tag, chunks, limit) & np.uint64(2**64 - 2) | np.uint64(tag & 1))
    return np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64), least


def shingle_sets(docs: DataFrame, wanted: DataFrame, unique: bool, id_col: str, text_col: str, num: int, den: int, n: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """sid, keys, set (bytes of the sorted hashes), sketch0 and sketch1 (parity bits for its schemes) of the documents in `wanted`
    (id, sid); unique: no id occurs twice in docs."""
    wanted = small(wanted.select(F.col(id_col).alias("_wanted"), "sid"), broadcast_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, F.col("_id").eqNullSafe(F.col("_wanted"))).select("sid", "_text")

    def run(batches):
        words = _Words()
        for b in batches:
            sids, keys, sets, bits = [], [], [], []
            with np.errstate(over="ignore"):
                for sid, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                    s = shingles(text, words, n)
                    if set_id(s) == sid:  # else another text under the same id
                        sids.append(sid), keys.append(keys_of(s, num, den)[0]), sets.append(s.tobytes())
                        own = {tag & 1: parity_bits(s, tag, chunks) for tag, chunks in schemes(len(s), num, den)}
                        bits.append([own.get(0), own.get(1)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(keys, longs), pa.array(sets, pa.binary()), *[pa.array([x[i] for x in bits], longs) for i in (0, 1)]], ["sid", "keys", "set", "sketch0", "sketch1"])

    out = rows.mapInArrow(trimmed(run), "sid long, keys array<long>, set binary, sketch0 array<long>, sketch1 array<long>")
    return out if unique else out.dropDuplicates(["sid"])


def parity_bits(s: np.ndarray, tag: int, chunks: int) -> np.ndarray:
    """A set's dense bit sketch for a scheme, as 64-bit words."""
    m = 256 if chunks == FLAT else 1 << (5 * chunks // 2 - 1).bit_length()  # a bit or more a shingle of the scheme's largest set
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def own_shingles(sets: DataFrame) -> DataFrame:
    """sid, own: how many shingles of each set no other of the sets has (no row: none)."""
    buckets = buckets_of(sets)

    def run(batches):
        values = Combiner(buckets)
        for b in batches:
            for sid, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values.add(sid, np.frombuffer(raw.as_buffer(), np.uint64))
                if values.full():
                    yield batch(values)
        if values.n:
            yield batch(values)

    def batch(values):
        rows = values.flush()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], PACKED)

    lone = lone_sums(lone_values(sets.select("sid", "set").mapInArrow(trimmed(run), Combiner.SCHEMA), buckets))
    return lone.select("sid", (F.col("lone0") + F.col("lone1")).alias("own"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b; a stored table), those whose sets link. Pairs that share one set may lie in a skewed partition, which adaptive
    execution splits."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = sets.select("sid", "set").join(small(wanted), "sid", "left_semi")
    left = sets.select(F.col("sid").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(u, v)
                at[at == len(u)] = 0
                common = int((u[at] == v).sum())
                ok.append(den * common >= num * (len(u) + len(v) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(trimmed(run), "a long, b long")


def _open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components and sets small enough for the row's set; a stored table."""
    marked = stash(rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "marked-rows")
    mixed = stash(marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).filter("lo <> hi").select("key", "least"), "mixed-keys")
    out = stash(marked.join(mixed, "key").filter("top >= least").drop("least"), "open-rows")
    discard(marked, mixed, roots)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, n: int = 5, draws: int = 8, turns: int = 1) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable over links of similarity num/den or more."""
    text_batches(docs.sparkSession)
    sk = stash(sketches(docs, id_col, text_col, num, den, n), "sketches")
    # keys of one set only find no partner; their number decides which sets may have any
    lone = lone_sums(sk.filter("n_shingles is null"))
    alive = sk.filter("n_shingles > 0").groupBy("sid").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("n_shingles", "need0", "need1", "k0", "k1")])
    alive = alive.join(lone, "sid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lone0", "lone1")})
    # how many of its shared keys, rarest first, a set needs in order to meet each of its partners on one
    use = [F.when(F.col(f"need{i}") > 0, F.col(f"k{i}") - F.col(f"lone{i}") - F.col(f"need{i}") + 1).otherwise(0).alias(f"use{i}") for i in (0, 1)]
    sids = stash(alive.select("sid", "first_id", "copies", F.col("n_shingles").alias("n"), *use), "set-ids")
    named_rows = stash(sk.filter("n_shingles is not null").select(F.col("_id").alias(id_col), "n_shingles", "sid"), "document-sets")
    discard(sk)
    living = stash(sids.filter("use0 > 0 or use1 > 0").drop("copies"), "living")

    # shingles that only one of the living sets has bound what it can share
    unique = not named_rows.groupBy(id_col).count().filter("count > 1").take(1)
    sets = stash(shingle_sets(docs, living.select(F.col("first_id").alias(id_col), "sid"), unique, id_col, text_col, num, den, n), "shingle-sets")
    all_living = living
    living = living.join(own_shingles(sets), "sid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    living = living.withColumn("top", F.floor((F.col("n") - F.col("own")) * (num + den) / num) - F.col("n"))  # its largest possible partner
    first, living = all_living, stash(living.filter(F.col("top") * den >= F.col("n") * num), "still-living")
    discard(first)

    # buckets of the living sets
    rows = sets.select("sid", "keys").join(small(living.select("sid", "n", "top", "use0", "use1")), "sid").select("sid", "n", "top", "use0", "use1", F.explode("keys").alias("key"))
    rows = rows.withColumn("use", F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("use0")).otherwise(F.col("use1"))).filter("use > 0").drop("use0", "use1")
    rows = stash(rows, "bucket-rows")
    buckets = stash(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    total = buckets.agg(F.sum("size")).first()[0] or 0
    shared = attach(rows, buckets, ["key"], "size", total, "sid").filter("size is not null")
    of_set = Window.partitionBy("sid")
    rarest = Window.partitionBy("sid", F.col("key").bitwiseAND(F.lit(1))).orderBy("size", "key")
    shared = stash(shared.withColumns({"weight": F.sum("size").over(of_set), "_r": F.row_number().over(rarest)}).withColumn("rare", F.col("_r") <= F.col("use")).drop("use", "_r"), "shared-rows")
    discard(rows, buckets, living)

    # each set against the most central set that it shares a bucket with
    center = F.max(F.struct(F.col("weight"), F.col("sid"), F.col("n"), F.col("top")))
    centers = stash(shared.groupBy("key").agg(center.alias("c"), F.max("size").alias("size")).select("key", F.col("c.weight").alias("c_weight"), F.col("c.sid").alias("c_sid"), F.col("c.n").alias("c_n"), F.col("c.top").alias("c_top"), "size"), "centers")

    def fits(x, top_x, y, top_y):
        return (F.least(x, y) * den >= F.greatest(x, y) * num) & (F.col(top_x) >= F.col(y)) & (F.col(top_y) >= F.col(x))

    star = attach(shared.drop("size"), centers, ["key"], "size", total, "sid").filter("sid <> c_sid").filter(fits("n", "top", "c_n", "c_top"))
    star = stash(star.groupBy("sid").agg(F.max(F.struct("c_weight", "c_sid")).alias("c")).select(F.col("sid").alias("a"), F.col("c.c_sid").alias("b")), "star")
    links = stash(verified(star, sets, num, den), "star-links")
    discard(centers, star)
    rare = shared.filter("rare").select("key", "sid", "n", "top")

    # each set of a bucket with several components against members drawn by a hash
    for turn in range(turns):
        open_rows = _open_rows(rare, components(links))
        drawn = stash(open_rows.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key", "sid").alias("h"), F.col("sid"), F.col("n"), F.col("top"), F.col("root"))).alias("d")).select("key", F.col("d.sid").alias("b"), F.col("d.n").alias("nb"), F.col("d.top").alias("top_b"), F.col("d.root").alias("rb")), "drawn")
        tries = open_rows.join(drawn, "key").filter(F.col("root") != F.col("rb")).filter(fits("n", "top", "nb", "top_b")).select(F.col("sid").alias("a"), "b").distinct()
        tries = tries.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))).filter(F.col("_r") <= draws).select("a", "b")
        tries = stash(tries, "tries")
        more = stash(links.unionByName(verified(tries, sets, num, den)), "drawn-links")
        discard(open_rows, drawn, tries, links)
        links = more

    # all pairs of a bucket that still lie in different components
    open_rows = _open_rows(rare, components(links))
    bits = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("sketch0")).otherwise(F.col("sketch1"))
    sketched = stash(open_rows.join(sets.select("sid", "sketch0", "sketch1"), "sid").withColumn("bits", bits).drop("sketch0", "sketch1"), "sketched-rows")
    left, right = (sketched.select("key", *[F.col(c).alias(c + x) for c in ("sid", "n", "top", "root", "bits")]) for x in "ab")
    far = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    near = far <= F.floor((F.col("na") + F.col("nb")) * (den - num) / (den + num))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("sida") < F.col("sidb")) & (F.col("roota") != F.col("rootb")) & fits("na", "topa", "nb", "topb") & near)
    pairs = stash(pairs.select(F.col("sida").alias("a"), F.col("sidb").alias("b")).distinct(), "cross-pairs")
    discard(open_rows, sketched, shared)
    more = stash(verified(pairs, sets, num, den), "cross-links")
    discard(pairs, sets)
    roots = components(links.unionByName(more))

    # back to documents
    named = sids.select("sid", "first_id", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = stash(named, "named")
    least_id = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    least_id = stash(least_id, "component-ids")
    n_sets = least_id.agg(F.sum("sets")).first()[0] or 0
    by_set = stash(attach(named, least_id, ["root"], "sets", n_sets, "sid").select("sid", "component_id", "copies"), "set-components")
    n_docs = by_set.agg(F.sum("copies")).first()[0] or 0
    discard(links, more, roots, named, least_id, sids)
    out = attach(named_rows, by_set, ["sid"], "copies", n_docs, id_col)
    return out.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))


def op6_jaccard_join(spark, sf_dir):
    from .common import table

    return near_components(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i : hash(array_to_string(w[i:i+4], ' '))))) AS s FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 80 * (x.n + y.n - o.c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON e.a = r.b
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
