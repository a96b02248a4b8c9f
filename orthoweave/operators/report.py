"""Report frames: comparisons of methods, summaries, validation checks, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def pivot_mean(df: DataFrame, row: str, col: str, value: str, cols: list) -> DataFrame:
    """Mean and standard error of a value, one pair of columns a method."""
    aggs = []
    for c in cols:
        v = F.when(F.col(col) == c, F.col(value))
        aggs += [F.avg(v).alias(f"{c}_mean"), (F.stddev_samp(v) / F.sqrt(F.greatest(F.count(v), F.lit(1)))).alias(f"{c}_se")]
    return df.groupBy(row).agg(*aggs)


def merge_methods(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two result tables."""
    return a.join(b, keys, "full")


def ablation(df: DataFrame, metrics: list[str], arm: str, base, full) -> DataFrame:
    """Per metric: mean, deviation and n of two arms and the improvement in per cent."""
    long = df.filter(F.col(arm).isin([base, full])).select(F.col(arm).alias("_arm"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["_arm"], metrics, "metric", "value")
    pick = lambda x: F.when(F.col("_arm") == x, F.col("value"))
    out = long.groupBy("metric").agg(*[f(pick(x)).alias(f"{n}_{s}") for x, n in ((base, "base"), (full, "full")) for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.count, "n"))])
    return out.withColumn("improvement_pct", 100 * (F.col("full_mean") - F.col("base_mean")) / F.nullif("base_mean", F.lit(0.0)))


def comparison(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def validation(checks: DataFrame) -> DataFrame:
    """Counts and overall status of (name, value, threshold, passed) rows."""
    n, ok = F.count(F.lit(1)), F.sum(F.col("passed").cast("long"))
    return checks.agg(n.alias("n_checks"), ok.alias("n_passed"), (n - ok).alias("n_failed"), F.when(ok == n, "PASS").otherwise("FAIL").alias("status"))


def gate(value, least=None, most=None):
    """Whether a value lies strictly between its bounds."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (value > least)
    if most is not None:
        ok = ok & (value < most)
    return F.coalesce(ok, F.lit(False))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of the values in [lo, hi)."""
    width = (hi - lo) / bins
    return df.filter((F.col(value) >= lo) & (F.col(value) < hi)).groupBy(F.floor((F.col(value) - lo) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The five numbers of a box plot."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "largest"))])


def pair_type(a, b, seeds: list):
    """seed-seed, seed-nonseed or nonseed-nonseed."""
    n = a.isin(seeds).cast("int") + b.isin(seeds).cast("int")
    return F.when(n == 2, "seed-seed").when(n == 1, "seed-nonseed").otherwise("nonseed-nonseed")


def run_summary(df: DataFrame, metrics: list[str], best_by: str) -> DataFrame:
    """One row: averages over rows without error, the best and the worst pair, and the number of errors."""
    good = F.col("error").isNull()
    of = lambda c: F.when(good, F.col(c))
    return df.agg(*[F.avg(of(m)).alias(f"avg_{m}") for m in metrics], F.max_by("pair", of(best_by)).alias("best_pair"), F.min_by("pair", of(best_by)).alias("worst_pair"), F.sum((~good).cast("long")).alias("n_errors"))


def grid_argmax(grid: DataFrame, parameters: list[str], value: str) -> DataFrame:
    """The row of a parameter grid with the largest value; ties to the smallest parameters."""
    return grid.orderBy(F.desc(value), *parameters).limit(1).select(*parameters, value)
