"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of `window` words (an item of fewer words is one window). A window is the set of its shingles (of `n` words,
or of all its words if there are fewer); it occurs in a text where an item-sized window of the text holds num/den of its shingles at the
same places, all of them by default. The corpus' document frequencies order the shingles of a window by rarity: of its m shingles
only the m - ceil(m num/den) + 1 rarest, its prefix, have to be joined, since one of them must occur. A shingle that no document has
drops out of the prefix, so windows that cannot occur are dropped before any join. Joined prefix tokens give the place of the
window in the text; the positional bound (the window may not start before the text) and the length bound (nor end after it) come first, then
the words themselves are compared.

The prefix table is bounded: windows are dealt by hash to as many shards as keep each below `max_entries` distinct shingles, which is what a task
holds. With one shard a text is read, joined and verified in one task step, and nothing is shuffled; with more, every shard passes over the texts and
the spans found are united by row. A hot passage costs its own length in each text that holds it, no pairs of texts.

Defined results: null and empty texts have no words and no spans; a null item text has no window; items with a null id are left out, rows that repeat
an item id are one item; null and repeated document ids are rows of their own; an empty table of items marks nothing, an empty table of documents gives
an empty result; other columns are ignored. Hashes only propose places: what is returned has been compared word by word.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, table, text_batches, trimmed
from .jaccard_join import _Words
from .line_dedup import _row_key
from .words import alnum_words, gram_hashes, grams_at, hashes, room, text_blocks

SPANS = "array<struct<start:int,end:int>>"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item, win): the distinct windows of every item, words joined by blanks."""

    def run(batches):
        for b in batches:
            for lo, texts in text_blocks(b, 1):
                for i, raw in enumerate(texts):
                    words = alnum_words(raw)
                    found = sorted({b" ".join(words[j : j + window]) for j in range(max(1, len(words) - window + 1))}) if words else []
                    if found:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + i] * len(found))), pa.array(found, pa.binary())], ["item", "win"])

    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = items.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"item {kind}, win binary").distinct()


def window_shingles(win: bytes, known: _Words, n: int) -> np.ndarray:
    words = win.split(b" ")
    return gram_hashes(hashes(words, known), min(n, len(words)))


class _Tokens:
    """Sorted shingle hashes by their number of words, with a table that rules out most others in one lookup, and the hashes of the windows' words."""

    def __init__(self, found: dict[int, np.ndarray], words: dict[bytes, int]):
        self.words = words
        self.of = {k: np.unique(v) for k, v in found.items() if len(v)}
        self.live = {}
        for k, v in self.of.items():
            self.live[k] = np.zeros(1 << 20, bool)
            self.live[k][v & np.uint64((1 << 20) - 1)] = True

    def find(self, h: np.ndarray, left: np.ndarray):
        """(k, places of words, numbers of shingles) of the known shingles that lie within their text."""
        for k, v in self.of.items():
            on = h != 0  # words of windows
            full = on[: max(0, len(h) - k + 1)]
            for i in range(1, k):
                full = full & on[i : len(full) + i]
            at = np.nonzero(full & (left[: len(full)] >= k))[0]
            g = grams_at(h, k, at)
            maybe = np.nonzero(self.live[k][g & np.uint64((1 << 20) - 1)])[0]
            at, g = at[maybe], g[maybe]
            no = np.minimum(np.searchsorted(v, g), len(v) - 1)
            same = v[no] == g
            yield k, at[same], no[same]

    def block(self, texts: list):
        """Of texts: their words, their numbers of words, the words' hashes (0: in no window), and the words left from each on."""
        words = [alnum_words(x) for x in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        return flat, sizes, np.fromiter(map(self.words.get, flat, repeat(0)), np.uint64, len(flat)), room(sizes)


def document_frequencies(docs: DataFrame, tokens: _Tokens) -> DataFrame:
    """(k, no, df) of the given shingles, summed in each task first. docs: (text)."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        t = held.value
        seen = {k: np.zeros(len(v), np.int64) for k, v in t.of.items()}
        with np.errstate(over="ignore"):
            for b in batches:
                for _, texts in text_blocks(b, 0):
                    _, sizes, h, left = t.block(texts)
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    for k, at, no in t.find(h, left):
                        pairs = np.unique(doc[at] * len(t.of[k]) + no)
                        seen[k] += np.bincount(pairs % len(t.of[k]), minlength=len(t.of[k]))
        for k, c in seen.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(c[at])], ["k", "no", "df"])

    return docs.mapInArrow(trimmed(run), "k int, no long, df long").groupBy("k", "no").agg(F.sum("df").alias("df"))


class _Prefixes:
    """The prefix tokens of a shard's windows, and the windows they stand for."""

    def __init__(self, wins: list[bytes], items: list[list], tokens: _Tokens, df: dict[int, np.ndarray], n: int, num: int, den: int):
        known = _Words()
        rows: dict[int, list] = {}
        self.wins, self.items, self.need = [], [], []
        with np.errstate(over="ignore"):
            for win, ids in zip(wins, items, strict=True):
                words = win.split(b" ")
                k = min(n, len(words))
                g = window_shingles(win, known, n)
                need = -(-len(g) * num // den)
                often = df[k][np.searchsorted(tokens.of[k], g)]
                order = np.lexsort((g, often))[: len(g) - need + 1]
                order = order[often[order] > 0]
                if len(order):
                    rows.setdefault(k, []).extend((g[o], len(self.wins), o) for o in order)
                    self.wins.append(words), self.items.append(ids), self.need.append(need)
        self.tokens = _Tokens({k: np.array([r[0] for r in v], np.uint64) for k, v in rows.items()}, {w: known[w] for words in self.wins for w in words} if num == den else tokens.words)
        self.first, self.win, self.off = {}, {}, {}
        for k, v in rows.items():
            v.sort(key=lambda r: r[0])
            self.first[k] = np.append(np.searchsorted(np.array([r[0] for r in v], np.uint64), self.tokens.of[k]), len(v))
            self.win[k], self.off[k] = np.array([r[1] for r in v], np.int64), np.array([r[2] for r in v], np.int64)
        self.length = np.array([len(w) for w in self.wins], np.int64)

    def places(self, flat: list[bytes], h: np.ndarray, left: np.ndarray, sizes: np.ndarray):
        """Sorted distinct (first word, window) where a window occurs."""
        total = np.repeat(sizes, sizes)
        out = set()
        for k, at, no in self.tokens.find(h, left):
            many = self.first[k][no + 1] - self.first[k][no]
            place = np.repeat(at, many)
            entry = np.repeat(self.first[k][no], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            win = self.win[k][entry]
            start = place - self.off[k][entry]
            before = total[place] - left[place]  # words of the text before the token
            fits = (self.off[k][entry] <= before) & (self.length[win] <= left[place] + self.off[k][entry])
            for s, w in zip(start[fits].tolist(), win[fits].tolist(), strict=True):
                if (s, w) not in out and self.holds(flat[s : s + len(self.wins[w])], w, k):
                    out.add((s, w))
        return sorted(out)

    def holds(self, text: list[bytes], w: int, k: int) -> bool:
        own = self.wins[w]
        if text == own:
            return True
        run = found = 0
        for x, y in zip(text, own, strict=True):
            run = run + 1 if x == y else 0
            found += run >= k
        return found >= self.need[w]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, n: int = 5, num: int = 1, den: int = 1, max_entries: int = 2_000_000) -> DataFrame:
    """One row per document: id, n_words, spans (runs of words inside any occurrence of a window), items (ids of items with occurring windows, sorted)."""
    text_batches(docs.sparkSession)
    wins = stash(item_windows(items, item_col, item_text, window).groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-windows")
    shingles = wins.agg(F.sum(F.length("win") - F.length(F.translate(F.col("win").cast("string"), " ", "")) + 1)).first()[0] or 0  # as many as words, or fewer
    shards = max(1, -(-shingles // max_entries))
    kind = items.schema[item_col].dataType.simpleString()
    outs = []
    for s in range(shards):
        mine = wins.filter(F.pmod(F.xxhash64("win"), F.lit(shards)) == s).toArrow()  # at most about max_entries shingles
        outs.append(_shard(docs, mine, id_col, text_col, kind, n, num, den, shards > 1))
    discard(wins)
    if shards == 1:
        return outs[0]
    stored = [stash(x.filter(F.size("spans") > 0).withColumn("_shard", F.lit(s)), "marked") for s, x in enumerate(outs)]
    every = stored[0]
    for x in stored[1:]:
        every = every.unionByName(x)
    key = ["_k", "_t1", "_t2"]
    every = every.dropDuplicates([*key, "_shard"])  # rows that repeat id and text have the same spans
    merged = every.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    merged = stash(merged.select(*key, F.aggregate("all", F.array().cast(SPANS), joined).alias("_spans"), F.col("items").alias("_items")), "merged-spans")
    discard(*stored)
    base = _shard(docs, mine.slice(0, 0), id_col, text_col, kind, n, num, den, True)
    out = base.join(merged, key, "left")
    return out.select(id_col, "n_words", F.coalesce("_spans", "spans").alias("spans"), F.coalesce("_items", "items").alias("items"))


def _shard(docs: DataFrame, mine: pa.Table, id_col: str, text_col: str, kind: str, n: int, num: int, den: int, keyed: bool) -> DataFrame:
    known = _Words()
    wins = [w.as_py() for w in mine.column("win")]
    found: dict[int, list] = {}
    with np.errstate(over="ignore"):
        for w in wins:
            found.setdefault(min(n, w.count(b" ") + 1), []).append(window_shingles(w, known, n))
    tokens = _Tokens({k: np.concatenate(v) for k, v in found.items()}, {x: known[x] for w in wins for x in w.split(b" ")})
    df = {k: np.zeros(len(v), np.int64) for k, v in tokens.of.items()}
    if wins:
        counted = document_frequencies(docs.select(F.col(text_col).alias("text")), tokens).toArrow()  # at most a row for each shingle
        k, no, c = (counted.column(x).to_numpy() for x in ("k", "no", "df"))
        for j in df:
            df[j][no[k == j]] = c[k == j]
    prefixes = docs.sparkSession.sparkContext.broadcast(_Prefixes(wins, mine.column("items").to_pylist(), tokens, df, n, num, den))

    def run(batches):
        p = prefixes.value
        with np.errstate(over="ignore"):
            for b in batches:
                at = b.schema.get_field_index("_text")
                item_type = b.schema.field("_none").type
                for lo, texts in text_blocks(b, at):
                    flat, sizes, h, left = p.tokens.block(texts)
                    ends = np.cumsum(sizes)
                    spans, ids = [[] for _ in texts], [set() for _ in texts]
                    for start, w in p.places(flat, h, left, sizes):
                        d = int(np.searchsorted(ends, start, "right"))
                        first = start - int(ends[d] - sizes[d])
                        last = first + len(p.wins[w])
                        if spans[d] and spans[d][-1]["end"] >= first:
                            spans[d][-1]["end"] = max(spans[d][-1]["end"], last)
                        else:
                            spans[d].append({"start": first, "end": last})
                        ids[d].update(p.items[w])
                    part = b.slice(lo, len(texts))
                    cols = [part.column(c) for c in held] + [pa.array(sizes), pa.array(spans, span_type), pa.array([sorted(x) for x in ids], item_type)]
                    yield pa.RecordBatch.from_arrays(cols, [*held, "n_words", "spans", "items"])

    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    held = [id_col, *(["_k", "_t1", "_t2"] if keyed else [])]
    rows = docs.select(F.col(id_col), *[c.alias(k) for k, c in _row_key(id_col, text_col).items() if keyed], F.col(text_col).alias("_text"), F.array().cast(f"array<{kind}>").alias("_none"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {'_k string, _t1 long, _t2 long, ' if keyed else ''}n_words long, spans {SPANS}, items array<{kind}>"
    return rows.select(*held, "_text", "_none").mapInArrow(trimmed(run), schema)


def op11_decontamination(spark, sf_dir):
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = """
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS win FROM s
), z AS (SELECT DISTINCT n FROM v), g AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM t CROSS JOIN z WHERE len(w) >= n
), h AS (
  SELECT g.r, g.i, g.n, v.item_id FROM g JOIN v ON g.n = v.n AND array_to_string(g.w[g.i:g.i+g.n-1], ' ') = v.win
), k AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), m AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(k.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN k ON k.r = t.r LEFT JOIN m ON m.r = t.r
"""
