"""Networks that arrive as files over time: edges kept at their largest weight, in append-only or updated form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.readers import RAW_NETWORK


def edge_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw edges of network files as they land in a folder."""
    return spark.readStream.schema(RAW_NETWORK).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def running_max(edges: DataFrame) -> DataFrame:
    """One row per undirected edge with its largest weight so far; write it in update or complete mode."""
    a, b = ids.edge_key(F.col("src"), F.col("dst"))
    return edges.groupBy(a.alias("a"), b.alias("b")).agg(F.max("w").alias("w"))
