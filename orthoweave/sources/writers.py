"""Sinks: networks, scored networks, pair and embedding tables, configuration, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import int_scores


def network(edges: DataFrame, path: str, parts: int | None = None) -> None:
    """Tab separated, sorted by key over all files, no header; in `parts` files, so that what a task sorts is bounded by whoever knows the size."""
    ordered = edges.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b") if parts else edges.orderBy("a", "b")
    ordered.select("a", "b", "w").write.mode("overwrite").csv(path, sep="\t")


def scored_network(edges: DataFrame, path: str) -> None:
    """Space separated gzip with header protein1 protein2 score."""
    int_scores(edges).select(F.col("a").alias("protein1"), F.col("b").alias("protein2"), "score").write.mode("overwrite").option("compression", "gzip").csv(path, sep=" ", header=True)


def pair_table(pairs: DataFrame, path: str) -> None:
    """Partitioned by the two species."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sp_a", "sp_b").parquet(path)


def embeddings(emb: DataFrame, path: str) -> None:
    emb.withColumn("v", F.col("v").cast("array<float>")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species").parquet(path)


def similarity(coo: DataFrame, path: str, n: int) -> dict:
    """Stores (i, j, value) and returns n_genes, nnz and density."""
    coo.write.mode("overwrite").parquet(path)
    nnz = coo.sparkSession.read.parquet(path).count()
    return {"n_genes": n, "nnz": nnz, "density": nnz / n**2 if n else 0.0}


def seed_config(spark, seeds: list[str], groups: dict[str, str], path: str) -> None:
    """seeds.txt, seed_groups.json and tax_group.tsv as folders under `path`."""
    spark.createDataFrame([(s,) for s in seeds], "s string").coalesce(1).write.mode("overwrite").text(f"{path}/seeds.txt")
    rows = spark.createDataFrame(sorted(groups.items()), "species string, seed string")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("species", "seed")))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/seed_groups.json")
    tax_group(spark, seeds, groups).coalesce(1).write.mode("overwrite").csv(f"{path}/tax_group.tsv", sep="\t", header=True)


def tax_group(spark, seeds: list[str], groups: dict[str, str]) -> DataFrame:
    """(taxid, group): the seeds, then the sorted others, all plants."""
    return spark.createDataFrame([(s, "plants") for s in [*seeds, *sorted(set(groups) - set(seeds))]], "taxid string, `group` string")


def report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def missing(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work list without what is stored already."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def text_file(lines: DataFrame, path: str) -> None:
    """One file of the given name with the lines of a small table (value string), as tools that read by name expect; `.gz` packs it."""
    spark = lines.sparkSession
    folder = f"{path}.parts"
    lines.select("value").coalesce(1).write.mode("overwrite").text(folder, compression="gzip" if path.endswith(".gz") else "none")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(jvm.Path(folder)) if s.getPath().getName().startswith("part-"))
    fs.delete(jvm.Path(path), False)
    fs.rename(part, jvm.Path(path))
    fs.delete(jvm.Path(folder), True)


def markdown(df: DataFrame, digits: int = 4) -> DataFrame:
    """(value): the lines of a Markdown table of a small frame, fractions with `digits` digits, missing values empty."""
    cells = [F.when(F.col(f"`{f.name}`").isNull(), "").otherwise(F.format_string(f"%.{digits}f", f"`{f.name}`") if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "at int, value string")
    return head.unionByName(df.select(F.lit(2).alias("at"), row.alias("value"))).orderBy("at", "value").select("value")
