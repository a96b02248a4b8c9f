"""Incremental materialisation: an output counts only when its manifest entry has been renamed into place.

A run writes the rows of all keys that are still missing as one attempt (data/<attempt>), then the list of its keys, and last renames that list
into the manifest, which is one file-system operation. Readers go by the manifest alone, so an attempt that was killed leaves nothing visible, and a
rerun writes only what is missing. If two runs commit the same key, the smaller attempt name counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def entries(spark: SparkSession, root: str, key: str, kind: str) -> DataFrame:
    """(key, attempt) of what is committed under `root`."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/manifest")) or not fs.listStatus(path(f"{root}/manifest")):
        return spark.createDataFrame([], f"`{key}` {kind}, attempt string")
    listed = spark.read.schema(f"`{key}` {kind}, attempt string").parquet(f"{root}/manifest/*")
    return listed.groupBy(key).agg(F.min("attempt").alias("attempt"))


def committed(spark: SparkSession, root: str, schema, key: str) -> DataFrame:
    """The committed rows."""
    kind = schema[key].dataType.simpleString()
    known = entries(spark, root, key, kind)
    attempts = [r["attempt"] for r in known.select("attempt").distinct().collect()]  # one a run
    if not attempts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/data/{a}" for a in attempts])
    at = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/", 1)
    return rows.select("*", at.alias("attempt")).join(known, [key, "attempt"], "left_semi").select(*schema.names)


def materialise(df: DataFrame, root: str, key: str) -> int:
    """Write the rows of `df` whose key is not committed yet; how many keys that was. A null key is written like others, each time."""
    spark = df.sparkSession
    fs, path = _fs(spark, root)
    todo = df.join(entries(spark, root, key, df.schema[key].dataType.simpleString()), key, "left_anti").select(*df.columns)
    attempt = uuid.uuid4().hex
    todo.write.parquet(f"{root}/data/{attempt}")
    written = spark.read.schema(df.schema).parquet(f"{root}/data/{attempt}").select(key).distinct().withColumn("attempt", F.lit(attempt))
    written.coalesce(1).write.parquet(f"{root}/tmp/{attempt}")
    n = spark.read.schema(written.schema).parquet(f"{root}/tmp/{attempt}").count()
    if not n:
        fs.delete(path(f"{root}/tmp/{attempt}"), True)
        fs.delete(path(f"{root}/data/{attempt}"), True)
        return 0
    fs.mkdirs(path(f"{root}/manifest"))
    if not fs.rename(path(f"{root}/tmp/{attempt}"), path(f"{root}/manifest/{attempt}")):
        raise OSError(f"attempt {attempt} could not be committed")
    return n


def swept(spark: SparkSession, root: str) -> int:
    """Delete attempts that were never committed; how many they were. Not to be run beside a writer."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/data")):
        return 0
    named = {s.getPath().getName() for s in fs.listStatus(path(f"{root}/manifest"))} if fs.exists(path(f"{root}/manifest")) else set()
    gone = [s.getPath() for s in fs.listStatus(path(f"{root}/data")) if s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    fs.delete(path(f"{root}/tmp"), True)
    return len(gone)
