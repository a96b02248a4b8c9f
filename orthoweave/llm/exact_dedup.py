"""Exact dedup by skew-safe combining, in DataFrame operations only.

Stage 1 groups by (salt, digest, full text): Spark's map-side aggregate deduplicates inside each
task, and the salt spreads the copies of one text over `salts` reducers. Stage 2 combines the salt
winners by (digest, full text), at most `salts` rows a text. Both stages compare whole texts, since
the text is part of the grouping key. The decision then goes back to every row through a narrow
lookup by digest, with hot groups broadcast (`common.attach`).

Defined results: a null text counts as empty, so null and empty texts are copies of each other; ties
on the id cannot change the result (the largest id is kept; repeated ids stay separate rows, all of them
kept if they carry the keeper's id); a null id is smaller than all others, `kept` is null for its row, and keep_id is null where all
copies have null ids; an empty table gives an empty result; other columns are ignored, and
only `id_col` and `text_col` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach, stash


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: text_sha256, text_md5, keep_id, group_size."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_text"))
    local = rows.groupBy(F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), F.sha2("_text", 256).alias("text_sha256"), "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = local.repartition("text_sha256").groupBy("text_sha256", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # The lookup below finds a text by two digests. Two texts that shared both would be an error, not a merge.
    one = winners.groupBy("text_sha256", F.md5("_text").alias("text_md5")).agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    return one.select("text_sha256", "text_md5", F.when(F.col("_texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share SHA-256 and MD5"))).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    groups = stash(exact_groups(docs, id_col, text_col, salts), "exact-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col), norm.alias("_text")).select(id_col, F.sha2("_text", 256).alias("text_sha256"), F.md5("_text").alias("text_md5"))
    out = attach(rows, groups, ["text_sha256", "text_md5"], "group_size", total, id_col)
    return out.select(F.col(id_col), "keep_id", "group_size", (F.col(id_col) == F.col("keep_id")).alias("kept"), "text_sha256")
