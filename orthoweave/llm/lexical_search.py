"""Ranked lexical search with a two-level quantised index.

Documents are cut into blocks (a slice of an Arrow batch, without a shuffle); a block is one row of the index and holds, for each term of the
vocabulary that occurs in it, the places of its documents and, on two levels, how much the term counts there: level 1 is the saturated term frequency
rounded up to a byte, level 2 the frequency itself with the documents' lengths. Level 1 gives an upper and a lower bound of every score in
integers. The search reads level 1 alone first and takes, for each item, the k-th largest lower bound of all documents; then every document whose upper
bound reaches it is scored exactly from level 2, and the best k of the exact scores are the result. No document is left out: one whose upper
bound is below k lower bounds has k better ones.

A score is the sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 8 m)) with w = floor(1000 ln((2N+2)/(2df+1))) and
m = 100 - b + (b n N) div L, b being 90; sums are 64-bit integers. Equal scores rank by ascending id: a block keeps its documents in the order of
ids, a task gives at most k documents for each block and item, and the best of these are merged in two steps by hash parts.

The vocabulary and the items' terms are held by every task: items are dealt by hash to as many groups as keep each below `max_terms` terms, and each group
has an index of its own terms. Every document is indexed, whole.

Defined results: null, empty and blank texts have no terms, count for nothing and are never found; repeated document ids are documents of
their own, ranked in any order among equal scores; a null id sorts before others; rows that repeat an item id are one item with the terms of
all, and a null item id is an item like others; items without terms, or whose terms no document has, give no rows; an empty table on either side
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, table, text_batches, trimmed
from .words import alnum_words, first_of, text_blocks

TOP = 1_000_000  # no saturated frequency is as large
#: Bounds of a saturated frequency by its byte.
UPPER = np.array([q * TOP // 255 for q in range(256)], np.int64)
LOWER = np.array([0] + [(q - 1) * TOP // 255 + 1 for q in range(1, 256)], np.int64)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): distinct terms of every item."""

    def run(batches):
        for b in batches:
            for lo, texts in text_blocks(b, 1):
                for i, raw in enumerate(texts):
                    found = sorted(set(alnum_words(raw)))
                    if found:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + i] * len(found))), pa.array(found, pa.binary())], ["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, f"item {kind}, term binary").distinct()


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks: ids, lengths, terms, starts, places, tfs (32-bit integers as bytes), n_docs and n_terms (of all terms of the texts)."""
    held = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    width = len(vocabulary)

    def run(batches):
        number = held.value.get
        for b in batches:
            order = pc.sort_indices(b, sort_keys=[("id", "ascending")], null_placement="at_start")
            b = b.take(order)
            for lo, texts in text_blocks(b, 1):
                words = [alnum_words(x) for x in texts]
                sizes = np.array([len(w) for w in words], np.int64)
                no = np.array([number(x, -1) for w in words for x in w], np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                both, tf = np.unique(no[no >= 0] * len(sizes) + doc[no >= 0], return_counts=True)
                terms, starts = np.unique(both // max(1, len(sizes)), return_index=True)
                data = [sizes, terms, np.append(starts, len(both)), both % max(1, len(sizes)), tf]
                ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), b.column(0).slice(lo, len(texts)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in data], pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], ["ids", *COLUMNS, "n_docs", "n_terms"])

    if width >= 2**31:
        raise ValueError("too many terms")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), f"ids array<{kind}>, {', '.join(f'{c} binary' for c in COLUMNS)}, n_docs long, n_terms long")


COLUMNS = ["lengths", "terms", "starts", "places", "tfs"]


def numbers(batch: pa.RecordBatch, name: str, i: int, kind=np.int32) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind).astype(np.int64)


def document_counts(blocks: DataFrame, width: int) -> np.ndarray:
    """df of each term of the vocabulary, summed in each task first; `width` numbers at most come to the driver."""

    def run(batches):
        df = np.zeros(width, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                df[numbers(b, "terms", i)] += np.diff(numbers(b, "starts", i))
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    got = blocks.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(width, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def saturation(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int, b: int = 90) -> np.ndarray:
    m = 100 - b + (b * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def quantised(blocks: DataFrame, n_docs: int, n_terms: int, b: int = 90) -> DataFrame:
    """The blocks with `impacts`, level 1: a byte for each posting, rounded up."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                c = saturation(numbers(batch, "tfs", i), numbers(batch, "lengths", i)[numbers(batch, "places", i)], n_docs, n_terms, b)
                out.append((-(-255 * c // TOP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "impacts"])

    return blocks.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in blocks.schema)}, impacts binary")


def build_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", b: int = 90) -> tuple[DataFrame, np.ndarray, int, int]:
    """(the stored index of all documents, weights of the terms, N, L)."""
    text_batches(docs.sparkSession)
    blocks = stash(postings(docs, vocabulary, id_col, text_col), "postings", "zstd")
    total = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = document_counts(blocks, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    index = stash(quantised(blocks, n_docs, n_terms, b), "index", "zstd")
    discard(blocks)
    return index, weights, n_docs, n_terms


def _slices(batch: pa.RecordBatch, i: int, asked: list[np.ndarray]):
    """(item, [(term, first posting, end)]) of the items that have terms in a block."""
    terms, starts = numbers(batch, "terms", i), numbers(batch, "starts", i)
    if len(terms):
        for q, want in enumerate(asked):
            at = np.searchsorted(terms, want)
            at[at == len(terms)] = 0
            at = at[terms[at] == want]
            if len(at):
                yield q, list(zip(terms[at].tolist(), starts[at].tolist(), starts[at + 1].tolist(), strict=True))


def thresholds(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, k: int) -> np.ndarray:
    """For each item the k-th largest lower bound of any document's score, or 0 if fewer than k are above 0. Reads level 1 alone."""
    held = index.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches):
        asked, weights = held.value
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                low, place = LOWER[numbers(b, "impacts", i, np.uint8)], numbers(b, "places", i)
                n = int(place.max(initial=-1)) + 1
                for q, parts in _slices(b, i, asked):
                    acc = np.zeros(n, np.int64)
                    for t, s, e in parts:
                        acc[place[s:e]] += weights[t] * low[s:e]
                    every = np.concatenate([best.get(q, acc[:0]), acc[acc > 0]])
                    best[q] = np.partition(every, len(every) - k)[-k:] if len(every) > k else every
        for q, x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), q, np.int64)), pa.array(x)], ["q", "low"])

    lows = index.select("terms", "starts", "places", "impacts").mapInArrow(run, "q long, low long").withColumn("salt", F.monotonically_increasing_id())
    got = first_of(lows, ["q"], [F.desc("low")], k, "salt").filter(F.col("rank") == k).select("q", "low").toArrow()  # at most a row for each item
    out = np.zeros(len(asked), np.int64)
    out[got.column("q").to_numpy()] = got.column("low").to_numpy()
    return out


def rescored(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, least: np.ndarray, n_docs: int, n_terms: int, k: int, b: int = 90) -> DataFrame:
    """(q, doc_id, score, checked): of each block the k best documents for each item by exact score; checked is how many were scored exactly, on one row of them."""
    held = index.sparkSession.sparkContext.broadcast((asked, weights, least))

    def run(batches):
        asked, weights, least = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                place = numbers(batch, "places", i)
                high, tf, n = UPPER[numbers(batch, "impacts", i, np.uint8)], numbers(batch, "tfs", i), numbers(batch, "lengths", i)
                ids = batch.column("ids")[i].values
                rows = []
                for q, parts in _slices(batch, i, asked):
                    acc = np.zeros(len(n), np.int64)
                    for t, s, e in parts:
                        acc[place[s:e]] += weights[t] * high[s:e]
                    chosen = (acc >= least[q]) & (acc > 0)
                    if chosen.any():
                        score = np.zeros(len(n), np.int64)
                        for t, s, e in parts:
                            on = chosen[place[s:e]]
                            p = place[s:e][on]
                            score[p] += weights[t] * saturation(tf[s:e][on], n[p], n_docs, n_terms, b)
                        best = np.argsort(-score, kind="stable")[:k]  # documents stand in the order of ids
                        rows += [(q, int(d), int(score[d]), int(chosen.sum()) if j == 0 else 0) for j, d in enumerate(best) if score[d] > 0 or j == 0]
                if rows:
                    q, d, score, checked = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids.take(pa.array(d)), pa.array(score, pa.int64()), pa.array(checked, pa.int64())], ["q", "doc_id", "score", "checked"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.select("ids", *COLUMNS, "impacts").mapInArrow(run, f"q long, doc_id {kind}, score long, checked long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", b: int = 90, max_terms: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, equal scores by ascending id."""
    spark = docs.sparkSession
    terms = stash(item_terms(items, item_col, item_text), "item-terms")
    groups = max(1, -(-terms.count() // max_terms))
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for g in range(groups):
        mine = terms.filter(F.pmod(F.xxhash64(F.lit("group"), "item"), F.lit(groups)) == g).groupBy("item").agg(F.collect_list("term").alias("terms")).toArrow()  # about max_terms terms
        vocabulary = sorted({t for x in mine.column("terms").to_pylist() for t in x})
        number = {w: i for i, w in enumerate(vocabulary)}
        asked = [np.array(sorted(number[t] for t in x), np.int64) for x in mine.column("terms").to_pylist()]
        index, weights, n_docs, n_terms = build_index(docs, vocabulary, id_col, text_col, b)
        found = rescored(index, asked, weights, thresholds(index, asked, weights, k), n_docs, n_terms, k, b).filter("score > 0")
        best = stash(first_of(found.drop("checked"), ["q"], [F.desc("score"), F.asc("doc_id")], k, "doc_id"), "ranked")
        discard(index)
        names = spark.createDataFrame(list(enumerate(mine.column("item").to_pylist())), f"q long, item_id {kind}")
        best = best.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    discard(terms)
    return out


def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM documents
), d AS (
  SELECT doc_id, r, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM t
), q AS (
  SELECT DISTINCT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark)
), n AS (SELECT r, doc_id, count(*) AS n FROM d GROUP BY r, doc_id), g AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM n),
p AS (SELECT r, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY r, w),
f AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * (SELECT c FROM g) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p GROUP BY w),
s AS (
  SELECT q.item_id, n.doc_id, p.r, CAST(sum(f.wt * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * n.n * g.c) // g.l)))) AS BIGINT) AS score
  FROM q JOIN p ON p.w = q.w JOIN f ON f.w = q.w JOIN n ON n.r = p.r CROSS JOIN g GROUP BY 1, 2, 3
), o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
