"""The corpus pipeline: quality classifier, line dedup, near-duplicate join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last keep the columns of `documents`.

Defined results of every stage: null and empty texts are documents like others (quality scores them; the line and personal data stages
leave them as they are; they link with nothing, so the near-duplicate stage keeps them; they have no piece, so packing returns no
row); null and repeated ids are rows of their own: decisions return to rows by id and text, never by id alone, and of rows that agree in
both the near-duplicate stage keeps one; whole texts of any length are read; an empty table gives an empty result; further columns are
carried along, whatever their names and types, up to packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoweave.llm import jaccard_join, line_dedup, packing, pii, quality
from orthoweave.llm.common import columns, discard, quoted, small, stash, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, trained on the labelled ones that are not held out, score at 0.5 or more."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.score(docs, forest, keep=docs.columns, score_col=score).filter(F.col(score) >= 0.5).select(*columns(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share, but for their first occurrence; documents left without text go."""
    prefix = "line_"
    while any(unused(docs, prefix + c) != prefix + c for c in line_dedup.ADDED):
        prefix += "_"
    cleaned = line_dedup.clean(docs, line_dedup.spread_lines(docs), prefix=prefix)
    text = F.col(prefix + "cleaned")
    kept = cleaned.filter((F.trim(text) != "") | text.eqNullSafe(F.col("text")))
    return _with_text(kept, docs, prefix + "cleaned")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (and text hash), of each component of near-duplicate links."""
    row, mark = unused(docs, "row"), unused(docs, "mark")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")))
    near = jaccard_join.near_components(keyed, id_col=row)
    found = stash(near.select(F.col(row).alias(mark), F.col("component_id").eqNullSafe(F.col(row)).alias("stays"), (F.col("n_shingles") > 0).alias("any")), "near-rows")
    gone = small(stash(found.filter("not stays").select(mark).distinct(), "near-dropped"))
    kept = keyed.join(gone, F.col(row) == F.col(mark), "left_anti")
    # rows that agree in id and text are copies of each other; their further columns are compared as JSON, which any type has
    twice = stash(found.filter("stays and any").groupBy(mark).count().filter("count > 1").select(mark), "near-repeated")
    if twice.take(1):
        whole = F.struct(*columns(docs))
        again = kept.join(small(twice), F.col(row) == F.col(mark), "left_semi").groupBy(row).agg(F.min_by(whole, F.to_json(whole)).alias(mark)).select(f"{mark}.*")
        kept = kept.join(small(twice), F.col(row) == F.col(mark), "left_anti").select(*columns(docs)).unionByName(again)
    discard(found)
    return kept.select(*columns(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose personal data spans are replaced by their kind."""
    return _with_text(pii.redact(docs, pii.train_field(docs)), docs, "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its bin."""
    return packing.pack_documents(docs, carry_text=True)


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs`, the text being `text` and n_chars, if there is one, its length."""
    kinds = {f.name: f.dataType for f in docs.schema}
    return rows.select(*[F.col(text).alias("text") if c == "text" else F.length(text).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("near duplicates", near_stage), ("personal data", pii_stage), ("packing", packing_stage)]

#: Boosted trees, message passing and packing have no SQL form; tests/llm hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, "stage-" + name.replace(" ", "-"))
    return docs
