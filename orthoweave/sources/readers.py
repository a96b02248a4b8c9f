"""Scans: networks, orthogroup tables, anchor pairs, annotations, ontologies, embeddings. Paths may be globs or folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_NETWORK = "src string, dst string, w double"
NETWORK = "a string, b string, w double"
OG_TABLE = "Transcript_ID string, Protein_ID string, Orthogroup string"
#: Name endings of the input files.
NETWORK_SUFFIX, OG_SUFFIX = "_Top50EdgesPerGene_ProteinID.tsv", "_transcripts_to_OG.tsv"


def _species(suffix: str):
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark gives it encoded
    return F.regexp_replace(name, f"{suffix.replace('.', '[.]')}(\\.gz)?$", "")


def raw_network(spark: SparkSession, path: str) -> DataFrame:
    """Directed edges of a raw network file with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=RAW_NETWORK)


def network(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, w) of network files without header; lines of fewer than two fields are skipped. Gzip is read as is."""
    parts = F.split(F.trim("value"), "\t")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 2)
    return lines.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.try_element_at("p", F.lit(3)).try_cast("double").alias("w"))


def networks_by_species(spark: SparkSession, folder: str) -> DataFrame:
    """(species, a, b, w) of all files `{species}.tsv[.gz]` of a folder, in one scan."""
    parts = F.split(F.trim("value"), "\t")
    lines = spark.read.text(f"{folder}/*.tsv*").select(_species(".tsv").alias("species"), parts.alias("p")).filter(F.size("p") >= 2)
    return lines.select("species", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.try_element_at("p", F.lit(3)).try_cast("double").alias("w"))


def orthogroups(spark: SparkSession, folder: str) -> DataFrame:
    """(species, transcript_id, protein_id, og) of all orthogroup tables of a folder; rows without orthogroup are dropped."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.csv(f"{folder}/*{OG_SUFFIX}", sep="\t", header=True, schema=OG_TABLE)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"no *{OG_SUFFIX} files in {folder}") from e
    return rows.select(_species(OG_SUFFIX).alias("species"), F.col("Transcript_ID").alias("transcript_id"), F.col("Protein_ID").alias("protein_id"), F.col("Orthogroup").alias("og")).dropna(subset=["og"])


def species_with(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Sorted species codes of the files with a suffix: the name without it, for networks up to the first underscore."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("n"))
    code = F.regexp_replace("n", suffix.replace(".", "[.]") + "$", "")
    code = F.split(code, "_")[0] if suffix == NETWORK_SUFFIX else code
    return [r["c"] for r in names.select(code.alias("c")).distinct().orderBy("c").collect()]


def valid_species(spark: SparkSession, networks: str, tables: str) -> list[str]:
    return sorted(set(species_with(spark, networks, NETWORK_SUFFIX)) & set(species_with(spark, tables, OG_SUFFIX)))


def anchor_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(ia, ib, w) of pair files of two or three columns; a missing weight is 1."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(p.alias("p"))
    return lines.select(F.col("p")[0].cast("double").cast("long").alias("ia"), F.col("p")[1].cast("double").cast("long").alias("ib"), F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0)).alias("w"))


def pair_table(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """The partition of a stored pair table for two species, whichever comes first."""
    return spark.read.parquet(path).filter((F.col("sp_a") == min(a, b)) & (F.col("sp_b") == max(a, b)))


def resolved_pairs(spark: SparkSession, folder: str, a: str, b: str) -> DataFrame:
    """Anchors of two species from text files named by their sorted codes: in `seeds`, else in `non_seeds` under either species."""
    name = "_".join(sorted((a, b)))
    jvm = spark._jvm.org.apache.hadoop.fs
    for path in (f"{folder}/seeds/{name}.tsv", f"{folder}/non_seeds/{a}/{name}.tsv", f"{folder}/non_seeds/{b}/{name}.tsv"):
        if jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path)):
            return anchor_pairs(spark, path)
    raise FileNotFoundError(f"no pairs of {a} and {b} in {folder}")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of several paths that exists: experimental annotations, else all."""
    jvm = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        if jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path)):
            return path
    raise FileNotFoundError(", ".join(paths))


#: Columns of the annotation files beside the gene's, and their types. Partition files also have a 0/1 column a compartment.
ANNOTATIONS = {"location": {"compartment": "string"}, "partitions": {"Partition": "int"}, "go": {"go_term": "string", "aspect": "string"}, "accessions": {"go_id": "string"}}


def typed_annotations(spark: SparkSession, path: str, kind: str, gene: str, classes: list[str] = ()) -> DataFrame:
    """(gene, ...) of an annotation file with a header: the columns of its kind, typed, and 0/1 columns `classes` (0 where missing)."""
    rows = spark.read.csv(path, sep="\t", header=True)
    flags = [F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)).alias(c) if c in rows.columns else F.lit(0).alias(c) for c in classes]
    return rows.select(F.col(gene).alias("gene"), *[F.col(c).cast(t).alias(c) for c, t in ANNOTATIONS[kind].items()], *flags)


def annotations(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(*columns) if columns else rows


def best_evidence(experimental: DataFrame, everything: DataFrame, key: str = "species") -> DataFrame:
    """Rows of the first table, and for keys that it lacks those of the second."""
    return experimental.unionByName(everything.join(experimental.select(key).distinct(), key, "left_anti"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(go_id, aspect) of an OBO file: one row a stanza."""
    text = spark.read.text(path, lineSep="\n\n")
    stanza = text.select(F.regexp_extract("value", r"(?m)^id: (GO:\d+)", 1).alias("go_id"), F.regexp_extract("value", r"(?m)^namespace: (\w+)", 1).alias("ns")).filter("go_id <> '' and ns <> ''")
    aspect = F.when(F.col("ns") == "biological_process", "BP").when(F.col("ns") == "cellular_component", "CC").when(F.col("ns") == "molecular_function", "MF")
    return stanza.select("go_id", aspect.alias("aspect"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(species, idx, gene, v) from Parquet; column pruning makes a scan of the ids alone cheap."""
    return spark.read.parquet(path)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
