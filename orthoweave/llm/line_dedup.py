"""Line dedup by distinct-site spread.

Every line of every text is hashed (128 bits). One aggregate per line hash merges HyperLogLog sketches of the sites it was
seen on, map-side first. Lines whose estimate is clearly at or above `min_sites` are spread; lines near the threshold (within three
standard errors on either side) get exact distinct counts in a second, small aggregate; the others are not spread.

Removal: a spread line stays in one document, the one with the smallest id (its first occurrence there), and is removed
elsewhere, however short it is (empty lines are no lines). One guard: a near copy of a first document is left whole for
document dedup. A near copy shares at least `copy_lines` distinct spread lines with one first document, and the two texts' exact Jaccard
similarity over shingles of `n` words is num/den or more; documents that merely carry the same block of lines lose it.

Removal reads the spread lines as a broadcast hash set while there are at most `broadcast_lines` of them, and by a
shuffled join of line hashes (hot lines broadcast) beyond; both give the same rows.

Defined results: one row for each row; a null text counts as empty and has one empty line; a null site is no site; a null id sorts
before all others, so a line stays with it; of documents with the same id each keeps its first occurrence, and the text that hashes
lowest stands for them when near copies are told; an empty table gives an empty result; other columns are carried along by `clean`,
whatever their names, but for those of its own four (a ValueError; `prefix` gives these other names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, columns, discard, refuse_clash, small, stash, text_batches, trimmed
from .jaccard_join import _Words, shingles, texts_of

SEED = 42  # of Spark's xxhash64


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    line = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line")
    rows = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), line).filter(F.length("line") >= min_chars)
    return rows.select("id", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("2:"), "line")).alias("h2"))


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, min_chars: int = 1, lg_k: int = 8, broadcast_lines: int = 1_000_000) -> DataFrame:
    """h1, h2, first_id, seen (occurrences) of the lines that at least `min_sites` distinct sites have; a stored table."""
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    known = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min_by("id", F.struct(F.col("id").isNotNull(), "id")).alias("first_id"), F.count(F.lit(1)).alias("seen"))
    known = known.filter(F.col("seen") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= min_sites * (1 - error))
    known = stash(known.select("h1", "h2", "first_id", "seen", "sites"), "line-spread")
    near = known.filter(F.col("sites") <= min_sites * (1 + error)).select("h1", "h2")
    exact = lines.join(small(near, broadcast_lines), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.count(F.lit(1)).alias("_n")).groupBy("h1", "h2").agg(F.count("site").alias("exact"))
    out = known.join(exact, ["h1", "h2"], "left").filter(F.coalesce("exact", "sites") >= min_sites)
    out = stash(out.select("h1", "h2", "first_id", "seen"), "spread-lines")
    discard(known)
    return out


ADDED = ["n_lines", "n_spread", "copy_like", "cleaned"]


def clean(docs: DataFrame, spread: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, copy_lines: int = 3, broadcast_lines: int = 1_000_000, num: int = 80, den: int = 100, n: int = 5, prefix: str = "") -> DataFrame:
    """All columns of `docs`, and, with `prefix`, n_lines, n_spread (distinct spread lines), copy_like, cleaned (the text that stays)."""
    refuse_clash(docs, [prefix + c for c in ADDED])
    text_batches(docs.sparkSession)
    few = spread.limit(broadcast_lines + 1).count() <= broadcast_lines
    copies = near_copies(docs, spread, few, id_col, text_col, min_chars, copy_lines, num, den, n)
    rows = docs.select(F.struct(*columns(docs)).alias("row"), *[c.alias(k) for k, c in _row_key(id_col, text_col).items()])
    marked = rows.join(small(copies), ["_k", "_t1", "_t2"], "left").select("row", F.coalesce("_copy", F.lit(False)).alias("copy"))
    out = (_clean_by_set if few else _clean_by_join)(marked, spread, docs.columns.index(id_col), docs.columns.index(text_col), min_chars)
    return out.select("row.*", *[F.col(c).alias(prefix + c) for c in ADDED])


def _row_key(id_col: str, text_col: str) -> dict:
    """Columns that tell rows by id and text; never null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"_k": F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), "_t1": F.xxhash64(text), "_t2": F.xxhash64(F.concat(F.lit("2:"), text))}


def near_copies(docs: DataFrame, spread: DataFrame, few: bool, id_col: str, text_col: str, min_chars: int, copy_lines: int, num: int, den: int, n: int) -> DataFrame:
    """_k, _t1, _t2, _copy (true) of the documents that are near copies of a first document; a stored table. few: spread lines can be broadcast."""
    row = ["_k", "_t1", "_t2"]
    line = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line")
    lines = docs.withColumns(_row_key(id_col, text_col)).select(*row, line).filter(F.length("line") >= min_chars)
    lines = lines.select(*row, F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("2:"), "line")).alias("h2"))
    named = spread.select("h1", "h2", "seen", _row_key("first_id", "first_id")["_k"].alias("_first"))
    if few:
        hits = lines.join(F.broadcast(named), ["h1", "h2"])
    else:
        total = spread.agg(F.sum("seen")).first()[0] or 0
        hits = attach(lines.withColumn("_place", F.xxhash64(*row)), named, ["h1", "h2"], "seen", total, "_place").filter("seen is not null")
    shared = hits.groupBy(*row, "h1", "h2", "_first").agg(F.lit(1)).groupBy(*row, "_first").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= copy_lines)
    shared = stash(shared.drop("c"), "line-origins")
    wanted = stash(shared.select(*row).distinct(), "line-origin-rows")
    texts = docs.withColumns(_row_key(id_col, text_col)).join(small(wanted), row).select(*row, F.col(text_col).alias("text"))

    def run(batches):
        words = _Words()
        for b in batches:
            with np.errstate(over="ignore"):
                sets = [shingles(x, words, n).tobytes() for x in texts_of(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], [*row, "_set"])

    sets = stash(texts.mapInArrow(trimmed(run), "_k string, _t1 long, _t2 long, _set binary").dropDuplicates(row), "line-origin-sets")
    pairs = shared.filter("_first <> _k").join(sets, row)
    uses = shared.filter("_first <> _k").groupBy("_first").agg(F.count(F.lit(1)).alias("uses"))
    firsts = shared.filter("_first = _k").join(sets, row).groupBy("_first").agg(F.min_by("_set", F.struct("_t1", "_t2")).alias("_other"))
    firsts = stash(firsts.join(uses, "_first").select("_first", "uses", "_other"), "line-firsts")
    total = firsts.agg(F.sum("uses")).first()[0] or 0
    pairs = attach(pairs, firsts, ["_first"], "uses", total, "_t1").filter("_other is not null")

    def linked(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(3), b.column(4), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(u, v, assume_unique=True)) if den * min(len(u), len(v)) >= num * max(len(u), len(v)) else 0
                ok.append(common > 0 and den * common >= num * (len(u) + len(v) - common))
            yield b.select(row).filter(pa.array(ok, pa.bool_()))

    found = pairs.select(*row, "_set", "_other").mapInArrow(trimmed(linked), "_k string, _t1 long, _t2 long")
    out = stash(found.distinct().withColumn("_copy", F.lit(True)), "line-copies")
    discard(shared, wanted, sets, firsts)
    return out


def _clean_by_set(rows: DataFrame, spread: DataFrame, id_at: int, text_at: int, min_chars: int) -> DataFrame:
    """row and ADDED of rows (row, copy)."""
    found = spread.select("h1", "h2", "first_id").toArrow()  # at most broadcast_lines rows, held as two sorted arrays of numbers and one of ids
    h1, h2 = (found.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    held = rows.sparkSession.sparkContext.broadcast((h1[order], h2[order], found.column("first_id").combine_chunks().take(pa.array(order))))

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def place(raw: bytes) -> int:
        """Where a line stands among the spread ones, or -1."""
        one, two, _ = held.value
        key = signed(xxhash.xxh64_intdigest(raw, SEED))
        lo = int(one.searchsorted(key))
        if lo == len(one) or one[lo] != key:
            return -1
        other = signed(xxhash.xxh64_intdigest(b"2:" + raw, SEED))
        while lo < len(one) and one[lo] == key:
            if two[lo] == other:
                return lo
            lo += 1
        return -1

    def one(doc, text, copy):
        lines = (text or "").split("\n")
        keys: dict[int, list] = {}
        for i, line in enumerate(lines):
            if len(line) >= min_chars and (at := place(line.encode("utf-8", "surrogatepass"))) >= 0:
                keys.setdefault(at, []).append(i)
        if not keys or copy:
            return len(lines), len(keys), copy, text
        gone = {i for at, places in keys.items() for i in (places[1:] if held.value[2][at].as_py() == doc else places)}
        return len(lines), len(keys), copy, "\n".join(x for i, x in enumerate(lines) if i not in gone)

    def run(batches):
        for b in batches:
            row = b.column(0)
            found = [one(*x) for x in zip(row.field(id_at).to_pylist(), row.field(text_at).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([row, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["row", *ADDED])

    added = [T.StructField(c, t) for c, t in zip(ADDED, (T.LongType(), T.LongType(), T.BooleanType(), T.StringType()), strict=True)]
    return rows.mapInArrow(trimmed(run), T.StructType([rows.schema["row"], *added]))


def _clean_by_join(rows: DataFrame, spread: DataFrame, id_at: int, text_at: int, min_chars: int) -> DataFrame:
    """The same for any number of spread lines: line hashes are joined, and the verdicts return to the rows by id and text hash."""
    id_name, text_name = (rows.schema["row"].dataType.fields[i].name for i in (id_at, text_at))
    whole = F.coalesce(F.col("row")[text_name], F.lit(""))
    keyed = rows.select("row", "copy", F.col("row")[id_name].alias("_id"), F.xxhash64(whole).alias("_t1"), F.xxhash64(F.concat(F.lit("2:"), whole)).alias("_t2"))
    each = keyed.select(F.col("_id").alias("id"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), whole.alias("text")).distinct()
    lines = each.select("id", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.length("line") >= min_chars)
    lines = lines.select("id", "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("2:"), "line")).alias("h2"))
    lines = lines.withColumn("_place", F.xxhash64("id", "t1", "pos"))
    total = spread.agg(F.sum("seen")).first()[0] or 0
    hits = attach(lines, spread, ["h1", "h2"], "seen", total, "_place").filter("seen is not null")
    per_line = hits.groupBy("id", "t1", "t2", "h1", "h2", "first_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    mine = F.col("first_id").eqNullSafe(F.col("id"))
    gone = F.when(mine, F.slice("places", F.lit(2), F.size("places"))).otherwise(F.col("places"))
    per_first = per_line.groupBy("id", "t1", "t2", "first_id").agg(F.count(F.lit(1)).alias("c"), F.flatten(F.collect_list(gone)).alias("gone"))
    found = per_first.groupBy("id", "t1", "t2").agg(F.sum("c").alias("found"), F.flatten(F.collect_list("gone")).alias("gone"))
    out = keyed.join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    parts = F.split(whole, "\n", -1)
    n_spread = F.coalesce("found", F.lit(0)).cast("long")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    return out.select("row", F.size(parts).cast("long").alias("n_lines"), n_spread.alias("n_spread"), F.col("copy").alias("copy_like"), F.when((n_spread == 0) | F.col("copy"), F.col("row")[text_name]).otherwise(kept).alias("cleaned"))


def op9_line_dedup(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = clean(docs, spread_lines(docs))
    return out.select("doc_id", "n_lines", "n_spread", "copy_like", F.length(F.coalesce("cleaned", F.lit(""))).cast("long").alias("clean_chars"), F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("clean_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), s AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE length(line) >= 1 GROUP BY line HAVING count(DISTINCT source) >= 8
), m AS (
  SELECT l.doc_id, l.line, l.pos, s.first_id, s.line IS NOT NULL AS spread,
    s.line IS NOT NULL AND (l.doc_id <> s.first_id OR l.pos > min(l.pos) OVER (PARTITION BY l.doc_id, l.line)) AS gone
  FROM l LEFT JOIN s ON l.line = s.line
), o AS (
  SELECT doc_id, first_id FROM m WHERE spread AND first_id <> doc_id GROUP BY 1, 2 HAVING count(DISTINCT line) >= 3
), w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM o UNION SELECT first_id FROM o)
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i : array_to_string(w[i:i+4], ' '))) END AS g FROM w
), c AS (
  SELECT DISTINCT o.doc_id FROM o JOIN g a ON a.doc_id = o.doc_id JOIN g b ON b.doc_id = o.first_id
  WHERE len(list_intersect(a.g, b.g)) > 0 AND 100 * len(list_intersect(a.g, b.g)) >= 80 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))
), d AS (
  SELECT m.doc_id, count(*) AS n_lines, count(DISTINCT line) FILTER (WHERE spread) AS n_spread, any_value(c.doc_id) IS NOT NULL AS copy_like,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept, string_agg(line, chr(10) ORDER BY pos) AS whole
  FROM m LEFT JOIN c ON c.doc_id = m.doc_id GROUP BY m.doc_id
)
SELECT doc_id, n_lines, n_spread, copy_like, length(CASE WHEN copy_like THEN whole ELSE kept END) AS clean_chars, sha256(CASE WHEN copy_like THEN whole ELSE kept END) AS clean_sha256 FROM d
"""
