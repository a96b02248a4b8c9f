"""Shared plumbing of the corpus operators: tables, shared folder, skew-safe lookup."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A group is hot when it holds more than 1/HOT_PARTS of all rows, so there are fewer than
#: HOT_PARTS hot groups whatever the input: the broadcast in `attach` has this proven bound.
HOT_PARTS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset and in local mode, as in tests) an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orthoweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read any more: what was made of them is stored."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of an Arrow batch of texts; Spark's 10,000 would hold tens of MB of text several times over in each task.
ARROW_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ARROW_ROWS, unless it has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def trimmed(run):
    """The function of a mapInArrow, which gives freed memory back to the system when its task ends: Python workers live on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def unused(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_1, name_2, ... that is no column of `df` (in any case)."""
    held = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(held) + 2))) if x.lower() not in held)


def quoted(name: str) -> str:
    """A column name as it stands in an expression or schema, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def refuse_clash(df: DataFrame, names: list[str]) -> None:
    """ValueError if `df` has columns of these names, which an operator adds beside the columns it carries along."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} are added here; give them other names or another prefix")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in, which is the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attach(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, spread: str) -> DataFrame:
    """Left join `rows` with `groups` (one row per key, `size` rows each) so that no key fills a task.

    Groups above total/HOT_PARTS rows (fewer than HOT_PARTS of them) are broadcast; their rows are spread
    by a hash of the column `spread` in the shuffled join that serves all others.
    `groups` should be a stored table: it is read twice. Key columns must not be null.
    """
    limit = total / HOT_PARTS
    values = [c for c in groups.columns if c not in key]
    g_hot = groups.filter(F.col(size) > limit).select(*key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    g_cold = groups.filter(F.col(size) <= limit).select(*key, *[F.col(c).alias(f"_cold_{c}") for c in values], F.lit(0).cast("long").alias("_spread"))
    marked = rows.join(F.broadcast(g_hot), key, "left")
    marked = marked.withColumn("_spread", F.when(F.col("_hot"), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    joined = marked.join(g_cold, [*key, "_spread"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])


def hashed_share(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """Up to about `n` of the rows, those whose key hashes lowest; no task sees more than its own rows. All rows if there are no more than n.

    The share is set a little low, so that `limit`, which is the bound, hardly ever cuts."""
    total = rows.count()
    if total <= n:
        return rows
    cut = int(n / total * (1 - 3 / n**0.5) * 2**32)
    return rows.filter(F.pmod(F.xxhash64(F.lit("share"), *key), F.lit(2**32)) < cut).limit(n)
