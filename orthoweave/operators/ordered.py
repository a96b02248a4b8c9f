"""Positions and running sums over a table's order, whole or by group, without a single-task sort.

Rows are range-partitioned by group and ordering column, so that partitions follow each other and a large group spans many; sums run
inside partitions, and each adds what its first group, the only one that can have begun earlier, has in those before it. Two rows a partition reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored


def sums_below(df: DataFrame, column: str, values: list[str], *by: str) -> DataFrame:
    """df (one row a value of `column` in a group) with below_{v}: the sum of v over the group's rows of smaller `column`, for each v in values."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*by, column).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged, "ordered")  # fixes the partition numbers, also when executors are lost
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))
    keyed = ranged.withColumn("_g", group)
    ends = keyed.groupBy("_p").agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    last = keyed.join(F.broadcast(ends), "_p").filter(F.col("_g").eqNullSafe(F.col("_last"))).groupBy("_p", "_first", "_last").agg(*[F.sum(v).alias(v) for v in values])
    none, rows, run, at = dict.fromkeys(values, 0), [], dict.fromkeys(values, 0), None
    for r in sorted(last.collect(), key=lambda r: r["_p"]):  # a row a partition
        start = run if r["_first"] == at else none
        rows.append((r["_p"], r["_first"], *[start[v] for v in values]))
        run = {v: (start[v] if r["_first"] == r["_last"] else 0) + (r[v] or 0) for v in values}
        at = r["_last"]
    kinds = {f.name: f.dataType for f in last.schema.fields}
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_first", kinds["_first"]), *[T.StructField(f"_start_{v}", kinds[v]) for v in values]])
    inside = Window.partitionBy("_p", *by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(F.broadcast(spark.createDataFrame(rows, schema)), "_p")
    begun = lambda v: F.when(F.col("_g").eqNullSafe(F.col("_first")), F.col(f"_start_{v}")).otherwise(F.lit(0))
    return out.select(*df.columns, *[(begun(v) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"below_{v}") for v in values])


def positions(df: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """df with the 0-based place of each row by the unique column."""
    return sums_below(df.withColumn("_one", F.lit(1)), column, ["_one"]).withColumnRenamed("below__one", out).drop("_one")
