"""Ortholog pairs between species and their weights. Genes are (species, idx, gene, og)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .graph import dealt_blocks, group_jaccard


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(og, ia, ib): all cross-species gene pairs of an orthogroup."""
    return a.filter(F.col("og").isNotNull()).select("og", F.col("idx").alias("ia")).join(b.select("og", F.col("idx").alias("ib")), "og")


def weighted_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """`pairs` with w = 1/(n_a n_b), counts being taken after restriction to the genes given. The genes of an orthogroup meet in blocks (`graph.dealt_blocks`)."""
    own, other = (d.filter(F.col("og").isNotNull()).select(F.col("og").alias("grp"), F.col("idx").alias("id")) for d in (a, b))
    x, y, keys = dealt_blocks(own, other)
    return x.withColumnRenamed("id", "ia").join(y.withColumnRenamed("id", "ib"), keys).select(F.col("grp").alias("og"), "ia", "ib", (1.0 / F.col("n")).alias("w"))


def jaccard_pairs(a: DataFrame, b: DataFrame, og_nbrs_a: DataFrame, og_nbrs_b: DataFrame, most: int | None = None) -> DataFrame:
    """(ia, ib, jaccard) of the pairs whose neighbour-orthogroup sets meet. og_nbrs are (gene, og), gene being idx. With `most`, at least
    the `most` best ib of each ia (ties: smaller ib), which is enough for rankings up to that place."""
    left, right = og_nbrs_a.select("gene", F.col("og").alias("el")), og_nbrs_b.select("gene", F.col("og").alias("el"))
    own, other = (d.select(F.col("og").alias("grp"), F.col("idx").alias("id")) for d in (a, b))
    return group_jaccard(own, other, left, right, most).select(F.col("u").alias("ia"), F.col("v").alias("ib"), "jaccard")


def hybrid_orthogroups(a: DataFrame, b: DataFrame, og_nbrs_a: DataFrame, og_nbrs_b: DataFrame, alpha: float = 5.0) -> DataFrame:
    """`hybrid_pairs` of `weighted_pairs` and `jaccard_pairs`, each pair made once, where its two blocks meet."""
    left, right = og_nbrs_a.select("gene", F.col("og").alias("el")), og_nbrs_b.select("gene", F.col("og").alias("el"))
    own, other = (d.select(F.col("og").alias("grp"), F.col("idx").alias("id")) for d in (a, b))
    found = group_jaccard(own, other, left, right, every=True)
    return found.select(F.col("u").alias("ia"), F.col("v").alias("ib"), (1.0 / F.col("n") * (1 + alpha * F.col("jaccard"))).alias("w"))


def hybrid_pairs(weighted: DataFrame, jaccard: DataFrame, alpha: float = 5.0) -> DataFrame:
    """All pairs with w (1 + alpha jaccard), a missing Jaccard counting as 0."""
    boosted = F.col("w") * (1 + alpha * F.coalesce("jaccard", F.lit(0.0)))
    return weighted.join(jaccard, ["ia", "ib"], "left").select("ia", "ib", boosted.alias("w"))


def two_tier_orthogroups(valid: DataFrame, og_table: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, og) by exact id if that covers at least `least` of the valid ids, else by the text before the first dot on both
    sides; of several rows for a key the last (largest row_no) counts. og_table is (row_no, protein_id, og)."""
    known = og_table.filter(F.col("og").isNotNull())
    want = valid.select("id").distinct()
    exact = want.join(known.groupBy(F.col("protein_id").alias("id")).agg(F.max_by("og", "row_no").alias("og")), "id")
    by_prefix = known.groupBy(ids.first_dot(F.col("protein_id")).alias("_k")).agg(F.max_by("og", "row_no").alias("og"))
    loose = want.withColumn("_k", ids.first_dot(F.col("id"))).join(by_prefix, "_k").select("id", "og")
    n = want.count()
    return exact if n and exact.count() / n >= least else loose


def either_id_orthogroups(genes: DataFrame, og_table: DataFrame) -> DataFrame:
    """(gene, og) by transcript or protein id, else by the text before the last dot."""
    both = og_table.filter(F.col("og").isNotNull()).select(F.explode(F.array("transcript_id", "protein_id")).alias("gene"), "og", "row_no")
    exact = both.groupBy("gene").agg(F.max_by("og", "row_no").alias("og_exact"))
    loose = exact.select(F.col("gene").alias("_k"), F.col("og_exact").alias("og_loose"))
    out = genes.select("gene").join(exact, "gene", "left").withColumn("_k", ids.last_dot(F.col("gene"))).join(loose, "_k", "left")
    return out.select("gene", F.coalesce("og_exact", "og_loose").alias("og"))


def in_bounds(pairs_: DataFrame, n_a: int, n_b: int) -> DataFrame:
    return pairs_.filter((F.col("ia") < n_a) & (F.col("ib") < n_b) & (F.col("ia") >= 0) & (F.col("ib") >= 0))


def enough_anchors(pairs_: DataFrame, least: int = 2) -> DataFrame:
    """The pairs, or ValueError with fewer than `least`."""
    if pairs_.limit(least).count() < least:
        raise ValueError(f"fewer than {least} anchor pairs")
    return pairs_
