"""Phrase collocation mining by merged count tries.

Texts are cut at punctuation and line ends into pieces, and those into words; phrases of up to `depth` words are counted by group
(language). A phrase that occurs `least` times has only parts that occur as often, so passes over the texts go from short phrases to long ones:

1. Words, the first level of the tries, are counted in each task, then by group and word. Frequent words go into a sieve (a Bloom filter of fixed size,
   whatever their number: a false positive costs rows, never a phrase).
2. Pairs of such words, then triples of frequent pairs, and so on below `depth`, are counted by 32 bits of their hash, packed by ranges of these; cells that reach `least`
   go into a sieve for each length. Phrases that share a cell only let more through.
3. Each shard (a run of texts with at most `shard_words` words) builds a count trie of depth `depth` over the paths that the sieves admit, which is merged with those of its task and
   serialised in the order of paths: for every prefix range (a hash of the first two words) one row with the hashes of the nodes' words, their last words and
   counts.

The serialised runs of a prefix range meet in one task, which merges them and drops nodes below `least`. What lies below a frequent first word spans all
ranges. A walk over the merged trie in the order of paths, in ranges of the first two words, gives
each node the counts of its left parts, which are its ancestors, and its text, word by word. Suffix links (the path without its first
word) give the right parts: the link of a node, the link of that, and so on. A cut after k words has l = the left part, r = the right
part and score floor(scale a / (l + r)) in exact decimals; the lowest-scoring cut counts, the smallest k among equal ones. A candidate goes if a longer one
that holds its words contiguously has num/den of its count or more. Phrases rank by score, count and UTF-8 bytes.

Defined results: null and empty texts have no words; a null group is `und`, one with rows that say `und`; rows that repeat are counted as often as they
occur; ids are not used; groups without candidates give no rows; an empty table gives an empty result; other columns are ignored.
Two different words with one 63-bit hash would be counted together: at 10^8 different words the chance is about one in 2000.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, small, stash, table, text_batches, trimmed
from .jaccard_join import _Words, mix
from .words import _M, Sieve, byte_table, first_of, grams_at, hashes, sieve_of, text_blocks

PIECES = byte_table(b".,;:!?\n\x0b\x0c\r")
STOP = b"."


def piece_words(raw: bytes | None) -> list[bytes]:
    """The words of a text; a full stop stands for every end of a piece."""
    return raw.translate(PIECES).replace(STOP, b" . ").split() if raw else []


def _group_blocks(batch: pa.RecordBatch):
    """(group, words of its texts, each text ended by a full stop) of slices of a batch of (grp, text)."""
    groups = batch.column(0).to_pylist()
    for lo, texts in text_blocks(batch, 1):
        of: dict[str, list] = {}
        for i, raw in enumerate(texts):
            if raw:
                of.setdefault(groups[lo + i], []).append(raw)
        for group, raws in of.items():
            yield group, [*piece_words(b".".join(raws)), STOP]


def _columns(group: str, words: list[bytes], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["grp", "word", "c"])


def word_counts(texts: DataFrame, held_words: int = 300_000) -> DataFrame:
    """(grp, word, c) of texts (grp, text); a task holds at most about `held_words` words."""

    def run(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for group, words in _group_blocks(b):
                counts.setdefault(group, Counter()).update(words)
            if sum(map(len, counts.values())) > held_words:
                for g, c in counts.items():
                    c.pop(STOP, None)
                    yield _columns(g, list(c), list(c.values()))
                counts.clear()
        for g, c in counts.items():
            c.pop(STOP, None)
            yield _columns(g, list(c), list(c.values()))

    return texts.mapInArrow(trimmed(run), "grp string, word string, c long").groupBy("grp", "word").agg(F.sum("c").alias("c"))


def _seed(group: str) -> np.uint64:
    return np.uint64(_Words()[group.encode()])


def _keys(h: np.ndarray, group: str) -> np.ndarray:
    return mix(h * _M + _seed(group))


def _word_keys(words: DataFrame) -> DataFrame:
    """Keys of (grp, word) rows in the sieve of words."""

    def run(batches):
        known = _Words()
        with np.errstate(over="ignore"):
            for b in batches:
                groups = b.column(0).to_pylist()
                h = hashes(b.column(1).cast(pa.binary()).to_pylist(), known)
                key = np.zeros(len(h), np.uint64)
                for g in set(groups):
                    on = np.array([x == g for x in groups])
                    key[on] = _keys(h[on], g)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return words.select("grp", "word").mapInArrow(run, "key long")


def _cells(h: np.ndarray, at: np.ndarray, k: int, group: str) -> np.ndarray:
    """The 32-bit cells of the phrases of k words at some places."""
    return _keys(grams_at(h, k, at), group) >> np.uint64(32)


def _admitted(h: np.ndarray, stop: np.uint64, group: str, sieves: list[Sieve]) -> list[np.ndarray]:
    """For 1, 2, .. words, where phrases begin that the sieves of their and all shorter lengths admit; one length more than there are sieves."""
    on = sieves[0].has(_keys(h, group)) & (h != stop)
    out = [np.flatnonzero(on)]
    for k in range(2, len(sieves) + 2):
        on = on[:-1] & on[1:]
        at = np.flatnonzero(on)
        if k <= len(sieves) and len(at):
            ok = sieves[k - 1].has(_cells(h, at, k, group))
            on[at[~ok]] = False
            at = at[ok]
        out.append(at)
    return out


#: Cells are dealt into so many ranges, of 2^22 cells each.
RANGES = 1024


def frequent_cells(texts: DataFrame, sieves: list[Sieve], least: int, held_grams: int = 2_000_000) -> DataFrame:
    """(key) of the cells that phrases with one word more than there are sieves fill `least` times; a task holds at most about `held_grams` of them."""
    held, k = texts.sparkSession.sparkContext.broadcast(sieves), len(sieves) + 1
    kind = np.uint8 if least < 256 else np.uint32

    def packed(parts):
        cells, c = np.unique(np.concatenate(parts), return_counts=True)
        c = np.minimum(c, least).astype(kind)
        cells = cells.astype(np.int64)
        edges = np.searchsorted(cells, np.arange(RANGES + 1) * (2**32 // RANGES))
        full = np.flatnonzero(np.diff(edges))
        # differences as planes of bytes, of which the upper ones are mostly zeros
        gaps = [np.diff(cells[edges[r] : edges[r + 1]], prepend=r * (2**32 // RANGES)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for r in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(gaps, pa.binary()), pa.array([c[edges[r] : edges[r + 1]].tobytes() for r in full], pa.binary())], ["rng", "gaps", "c"])

    def run(batches):
        known, parts, n = _Words(), [], 0
        with np.errstate(over="ignore"):
            for b in batches:
                for group, flat in _group_blocks(b):
                    h = hashes(flat, known)
                    parts.append(_cells(h, _admitted(h, np.uint64(known[STOP]), group, held.value)[-1], k, group))
                    n += len(parts[-1])
                    if n > held_grams:
                        yield packed(parts)
                        parts, n = [], 0
        if n:
            yield packed(parts)

    def live(rng: int, count: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count >= least) + rng * (2**32 // RANGES))], ["key"])

    def summed(batches):
        last, count = None, np.zeros(0, np.uint32)
        for b in batches:
            for rng, gaps, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if rng != last:
                    if last is not None:
                        yield live(last, count)
                    last, count = rng, np.zeros(2**32 // RANGES, np.uint32)
                at = np.frombuffer(gaps.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64).cumsum()
                count[at] = np.minimum(count[at] + np.frombuffer(c.as_buffer(), kind), 2**31)
        if last is not None:
            yield live(last, count)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(trimmed(run), "rng int, gaps binary, c binary").repartition(parts, "rng").sortWithinPartitions("rng")
    return rows.mapInArrow(trimmed(summed), "key long")


def _path_hash(path: np.ndarray) -> np.ndarray:
    acc = path[:, 0].copy()
    for i in range(1, path.shape[1]):
        acc = acc * _M + path[:, i]
    return mix(acc)


def _path(depth: int) -> list[str]:
    return [f"w{i + 1}" for i in range(depth)]


#: Prefix ranges, at least: by a hash of a path's first two words, so that what lies below a frequent first word spans all of them.
PREFIXES = 64
#: Words of the corpus for each range, at most, so that what a range holds does not grow with the corpus.
RANGE_WORDS = 1 << 20


def prefix_ranges(words: int) -> int:
    return max(PREFIXES, -(-words // RANGE_WORDS))


class _Trie:
    """Counts of paths of two or more words in the order of (range, path): what a shard adds is sorted and merged with what there is."""

    def __init__(self, depth: int):
        self.path, self.c, self.words = np.zeros((0, depth), np.uint64), np.zeros(0, np.int64), {}

    def __len__(self) -> int:
        return len(self.c)

    def merge(self, path: np.ndarray, c: np.ndarray) -> None:
        path, c = np.concatenate([self.path, path]), np.concatenate([self.c, c])
        if len(c):
            order = np.argsort(h := _path_hash(path), kind="stable")  # equal paths are found by one hash of their words
            first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            self.path, self.c = path[order[first]], np.add.reduceat(c[order], first)

    def add(self, h: np.ndarray, runs: list[np.ndarray]) -> None:
        """runs[d]: where in h paths of d + 2 words begin."""
        new = []
        for d, at in enumerate(runs):
            path = np.zeros((len(at), self.path.shape[1]), np.uint64)
            for i in range(d + 2):
                path[:, i] = h[at + i] >> np.uint64(1)  # no negative number as a long, so that a path comes before those below it
            new.append(path)
        every = np.concatenate(new)
        self.merge(every, np.ones(len(every), np.int64))

    def serialised(self, group: str, prefixes: int):
        """A row for each prefix range: columns of hashes and counts as bytes, in the order of paths, and the last words."""
        depth = self.path.shape[1]
        if not len(self.c):
            return
        rng = (_path_hash(self.path[:, :2]) % np.uint64(prefixes)).astype(np.int64)
        order = np.lexsort([*self.path.T[::-1], rng])
        path, c, rng = self.path[order], self.c[order], rng[order]
        length = (path != 0).sum(1)
        last = path[np.arange(len(path)), length - 1]
        names, back = np.unique(last, return_inverse=True)
        text = pa.array([self.words[int(x)] for x in names], pa.binary()).cast(pa.string()).take(pa.array(back))
        edges = np.searchsorted(rng, np.arange(prefixes + 1))
        full = np.flatnonzero(np.diff(edges))
        ends = pa.array(np.append(edges[full], len(c)).astype(np.int32))
        blobs = [pa.array([path[edges[r] : edges[r + 1], i].tobytes() for r in full], pa.binary()) for i in range(depth)]
        counts = pa.array([c[edges[r] : edges[r + 1]].tobytes() for r in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(full), pa.string()), pa.array(full.astype(np.int32)), *blobs, counts, pa.ListArray.from_arrays(ends, text)], ["grp", "rng", *_path(depth), "c", "words"])


def shard_tries(texts: DataFrame, sieves: list[Sieve], prefixes: int = PREFIXES, shard_words: int = 500_000, held_nodes: int = 2_000_000) -> DataFrame:
    """(grp, rng, w1.., c, words): the serialised tries, below their first level. A task merges its shards, and gives out what it has at `held_nodes` nodes."""
    held, depth = texts.sparkSession.sparkContext.broadcast(sieves), len(sieves) + 1

    def run(batches):
        known, tries, shards = _Words(), {}, {}

        def closed():
            for g, s in shards.items():
                tries.setdefault(g, _Trie(depth)).add(np.concatenate(s["h"]), [np.concatenate(x) for x in s["runs"]])
                tries[g].words.update(s["words"])
            shards.clear()

        def given():
            for g, t in tries.items():
                yield from t.serialised(g, prefixes)
            tries.clear()

        with np.errstate(over="ignore"):
            for b in batches:
                for group, flat in _group_blocks(b):
                    h = hashes(flat, known)
                    runs = _admitted(h, np.uint64(known[STOP]), group, held.value)[1:depth]
                    s = shards.setdefault(group, {"h": [], "runs": [[] for _ in runs], "n": 0, "words": {}})
                    for d, at in enumerate(runs):
                        s["runs"][d].append(at + s["n"])
                        # a node is labelled with its last word
                        last, first = np.unique(h[at + d + 1], return_index=True)
                        s["words"].update((int(x) >> 1, flat[at[i] + d + 1]) for x, i in zip(last, first, strict=True))
                    s["h"].append(h)
                    s["n"] += len(h)
                if sum(s["n"] for s in shards.values()) > shard_words:
                    closed()
                    if sum(map(len, tries.values())) > held_nodes:
                        yield from given()
            closed()
            yield from given()

    return texts.mapInArrow(trimmed(run), f"grp string, rng int, {', '.join(f'{w} binary' for w in _path(depth))}, c binary, words array<string>")


def merged(tries: DataFrame, depth: int, least: int, held_nodes: int = 1_000_000) -> DataFrame:
    """(grp, w1.., f, word): the nodes that all shards together count `least` times or more; the runs of a prefix range meet in one task, which sums them as
    they come and holds the range's different nodes and at most `held_nodes` more."""
    path = _path(depth)

    def run(batches):
        def kept(group, trie, names):
            on = trie.c >= least
            words = pa.array([names[int(x)] for x in trie.path[on][np.arange(int(on.sum())), (trie.path[on] != 0).sum(1) - 1]], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([group] * len(words), pa.string()), *[pa.array(trie.path[on][:, i].view(np.int64)) for i in range(depth)], pa.array(trie.c[on]), words], ["grp", *path, "f", "word"])

        key, trie, names, parts, n = None, None, {}, [], 0

        def joined():
            nonlocal parts, n
            if parts:
                trie.merge(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
            parts, n = [], 0

        with np.errstate(over="ignore"):
            for b in batches:
                groups, rngs = b.column("grp").to_pylist(), b.column("rng").to_pylist()
                for i in range(b.num_rows):
                    if (groups[i], rngs[i]) != key:
                        if key is not None:
                            joined()
                            yield kept(key[0], trie, names)
                        key, trie, names = (groups[i], rngs[i]), _Trie(depth), {}
                    p = np.stack([np.frombuffer(b.column(w)[i].as_buffer(), np.uint64) for w in path], 1)
                    last = p[np.arange(len(p)), (p != 0).sum(1) - 1]
                    words = b.column("words")[i].values
                    for x, at in zip(*np.unique(last, return_index=True), strict=True):
                        if int(x) not in names:
                            names[int(x)] = words[int(at)].as_py()
                    parts.append((p, np.frombuffer(b.column("c")[i].as_buffer(), np.int64)))
                    n += len(p)
                    if n > held_nodes:
                        joined()
            if key is not None:
                joined()
                yield kept(key[0], trie, names)

    parts = int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tries.repartition(parts, "grp", "rng").sortWithinPartitions("grp", "rng")
    return rows.mapInArrow(trimmed(run), f"grp string, {', '.join(f'{w} long' for w in path)}, f long, word string")


def first_level(words: DataFrame, depth: int) -> DataFrame:
    """The nodes of one word, of (grp, word, c)."""

    def run(batches):
        known = _Words()
        for b in batches:
            h = (hashes(b.column(1).cast(pa.binary()).to_pylist(), known) >> np.uint64(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h), b.column(2), b.column(1)], ["grp", "w1", "f", "word"])

    rows = words.select("grp", "word", "c").mapInArrow(run, "grp string, w1 long, f long, word string")
    return rows.select("grp", "w1", *[F.lit(0).cast("long").alias(w) for w in _path(depth)[1:]], "f", "word")


def walked(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of two or more words with `left` (counts of the first 1, 2, .. words) and `phrase`; a stored table.

    The first word comes from its own node; the walk has the other ancestors on its way, in ranges of the first two words."""
    path = _path(depth)
    firsts = nodes.filter("w2 = 0").select("grp", "w1", F.col("f").alias("f1"), F.col("word").alias("word1"))
    longer = nodes.filter("w2 <> 0")
    fan = stash(longer.groupBy("grp", "w1").agg(F.count(F.lit(1)).alias("fan")).join(firsts, ["grp", "w1"]), "trie-firsts")
    total = fan.agg(F.sum("fan")).first()[0] or 0
    rows = attach(longer.withColumn("_place", F.xxhash64(*path)), fan, ["grp", "w1"], "fan", total, "_place").drop("_place", "fan")

    def run(batches):
        stack: list = []  # of (path so far, count, text)
        for b in batches:
            left, phrase = [], []
            cols = [b.column(c).to_pylist() for c in ("grp", *path, "f", "word", "f1", "word1")]
            for row in zip(*cols, strict=True):
                words = tuple(w for w in row[1 : depth + 1] if w)
                f, word, f1, word1 = row[depth + 1 :]
                while stack and stack[-1][0] != (row[0], *words[:-1]):
                    stack.pop()
                above = stack[-1] if stack else ((row[0], words[0]), [f1], word1)
                text = f"{above[2]} {word}"
                left.append(above[1]), phrase.append(text)
                stack.append(((row[0], *words), [*above[1], f], text))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("grp", *path, "f")], pa.array(left, pa.list_(pa.int64())), pa.array(phrase, pa.string())], ["grp", *path, "f", "left", "phrase"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stash(rows, "trie-rows")
    out = ordered.repartitionByRange(parts, "grp", "w1", "w2").sortWithinPartitions("grp", *path)
    out = stash(out.mapInArrow(run, f"grp string, {', '.join(f'{w} long' for w in path)}, f long, left array<long>, phrase string"), "trie-walk")
    discard(fan, ordered)
    return out


def linked(nodes: DataFrame, walk: DataFrame, depth: int) -> DataFrame:
    """The walked nodes with `right` (counts of the last n-1, .., 1 words), by suffix links of one depth after another."""
    path = _path(depth)
    link = nodes.filter("w2 = 0").select("grp", F.col("w1").alias("s1"), *[F.lit(0).cast("long").alias(f"s{i}") for i in range(2, depth)], F.array("f").alias("right"))
    out = None
    for d in range(2, depth + 1):
        rows = walk.filter(f"{path[d - 1]} <> 0" + (f" and {path[d]} = 0" if d < depth else ""))
        keys = [f"s{i}" for i in range(1, depth)]
        rows = rows.withColumns({f"s{i}": F.col(path[i]) for i in range(1, depth)})
        fan = stash(rows.groupBy("grp", *keys).agg(F.count(F.lit(1)).alias("fan")).join(link, ["grp", *keys]), "suffix-links")
        total = fan.agg(F.sum("fan")).first()[0] or 0
        got = attach(rows.withColumn("_place", F.xxhash64(*path)), fan, ["grp", *keys], "fan", total, "_place").drop("_place", "fan", *keys)
        got = stash(got, "trie-linked")
        discard(fan)
        out = got if out is None else out.unionByName(got)
        link = got.select("grp", *[F.col(path[i - 1]).alias(f"s{i}") for i in range(1, depth)], F.concat(F.array("f"), "right").alias("right"))
    return out


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = 30, depth: int = 4, first: int = 2000, num: int = 80, den: int = 100, scale: int = 2_000_000, sieve_bits: int = 1 << 26) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the first `first` phrases of 2 to `depth` words of each group."""
    text_batches(docs.sparkSession)
    path = _path(depth)
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), F.col(text_col).alias("text"))
    counts = stash(word_counts(texts), "word-counts")
    totals = stash(counts.groupBy("grp").agg(F.sum("c").alias("n")), "group-words")
    words = totals.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("c") >= least)
    sieves = [sieve_of(_word_keys(often), sieve_bits)]
    for _ in range(2, depth):
        sieves.append(sieve_of(frequent_cells(texts, sieves, least), sieve_bits))
    tries = stash(shard_tries(texts, sieves, prefix_ranges(words)), "shard-tries", "zstd")
    nodes = stash(merged(tries, depth, least).unionByName(first_level(often, depth)), "trie")
    discard(counts, tries)
    walk = walked(nodes, depth)
    rows = linked(nodes, walk, depth)
    # the longest count of a longer candidate that holds a phrase: every longer one names its inner paths
    inner = []
    for d in range(3, depth + 1):
        inner += [(d, at, k) for k in range(2, d) for at in range(d - k + 1)]
    parts = [F.when(F.col(path[d - 1]).eqNullSafe(0) | (F.lit(False) if d == depth else F.col(path[d]) != 0), None).otherwise(F.struct(*[F.col(path[at + i]).alias(f"w{i + 1}") if i < k else F.lit(0).cast("long").alias(f"w{i + 1}") for i in range(depth)])) for d, at, k in inner]
    over = walk.filter("w3 <> 0").select("grp", "f", F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("grp", "p").agg(F.max("f").alias("longer")) if depth > 2 else None
    kept = rows
    if over is not None:
        kept = rows.join(over.select("grp", *[F.col("p")[w].alias(w) for w in path], "longer"), ["grp", *path], "left").filter(F.col("longer").isNull() | (den * F.col("longer") < num * F.col("f")))
    exact = "cast(element_at(left, i) as decimal(19, 0)) + cast(element_at(right, i) as decimal(19, 0))"
    cut = F.array_min(F.expr(f"transform(sequence(1, size(left)), i -> struct({scale} * cast(f as decimal(28, 0)) div ({exact}) as score, i as k, element_at(left, i) as l, element_at(right, i) as r))"))
    best = kept.select("grp", "phrase", F.col("f").alias("a"), cut.alias("cut")).select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = stash(first_of(best, ["grp"], [F.desc("score"), F.desc("a"), F.asc("phrase")], first, "phrase"), "phrases")
    return ranked.join(small(totals), "grp").select(F.col("grp").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p), s AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, w[i:i+k-1] AS ph FROM s CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
), c AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30), t AS (SELECT lang, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT lang, k, ph, f AS a, unnest(range(1, k)) AS cut FROM c WHERE k >= 2), y AS (
  SELECT x.lang, x.ph, x.k, x.a, x.cut, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * x.a) // (l.f + r.f) AS BIGINT) AS score
  FROM x JOIN c l ON l.lang = x.lang AND l.ph = x.ph[1:cut] JOIN c r ON r.lang = x.lang AND r.ph = x.ph[cut+1:]
), b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
i AS (SELECT lang, f, k, ph, unnest(range(2, k)) AS m FROM c WHERE k >= 3), j AS (SELECT lang, f, k, ph, m, unnest(range(1, k - m + 2)) AS pos FROM i),
o AS (SELECT lang, ph[pos:pos+m-1] AS ph, max(f) AS longer FROM j GROUP BY 1, 2), z AS (
  SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, b.l, b.r, t.n, b.score FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.ph = b.ph
  WHERE o.longer IS NULL OR 100 * o.longer < 80 * b.a
), q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z)
SELECT * FROM q WHERE rank <= 2000
"""
