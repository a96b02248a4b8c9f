"""Threshold curves over scored binary labels (score, y), optionally per group. Rows with equal scores enter together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordered import positions, sums_below


def cumulative(df: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Per distinct score: positives and negatives there (tp_at, fp_at) and from there up (tp, fp), and the totals p and n. With
    `weight` a row counts that often."""
    y, times = F.col("y").cast("long"), F.lit(1) if weight is None else F.col(weight)
    g = df.groupBy(*by, "score").agg(F.sum(y * times).alias("tp_at"), F.sum((1 - y) * times).alias("fp_at"))
    total = g.groupBy(*by).agg(F.sum("tp_at").alias("p"), F.sum("fp_at").alias("n"))
    below = sums_below(g, "score", ["tp_at", "fp_at"], *by)
    c = below.join(total, list(by)) if by else below.join(F.broadcast(total))  # one row
    return c.select(*by, "score", "tp_at", "fp_at", (F.col("p") - F.col("below_tp_at")).alias("tp"), (F.col("n") - F.col("below_fp_at")).alias("fp"), "p", "n")


def _trapezoids():
    return F.sum(F.col("fp_at") * (2 * F.col("tp") - F.col("tp_at")) / 2)


def roc_auc(df: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids; null without both classes."""
    return cumulative(df, *by, weight=weight).groupBy(*by).agg((_trapezoids() / F.nullif(F.max("p") * F.max("n"), F.lit(0))).alias("auc"))


def partial_auc(df: DataFrame, share: float = 0.001) -> DataFrame:
    """Area up to fp_cap = max(int(share n), 1) false positives, over fp_cap p."""
    inside = cumulative(df).withColumn("cap", F.greatest(F.floor(F.col("n") * share), F.lit(1))).filter(F.col("fp") <= F.col("cap"))
    return inside.agg((F.coalesce(_trapezoids(), F.lit(0.0)) / F.nullif(F.max("cap") * F.max("p"), F.lit(0))).alias("pauc"), F.max("cap").cast("long").alias("fp_cap"))


def pr_summary(df: DataFrame, *by: str) -> DataFrame:
    """fmax over the distinct thresholds and average precision; both 0 for groups of one class."""
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    ap = F.sum(F.col("tp_at") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    return cumulative(df, *by).withColumn("f1", f1).filter("p > 0").groupBy(*by).agg(F.when(both, F.max("f1")).otherwise(0.0).alias("fmax"), F.when(both, ap).otherwise(0.0).alias("ap"))


def fmax_micro(df: DataFrame, lo: int = 10, hi: int = 999, scale: int = 1000) -> DataFrame:
    """Best pooled F1 over the thresholds lo/scale to hi/scale: rows fall into the highest threshold they pass, then sums run down."""
    step = F.least(F.floor(F.col("score") * scale + 1e-9), F.lit(hi)).cast("int")
    hist = df.groupBy(step.alias("t")).agg(F.sum(F.col("y").cast("long")).alias("tp_at"), F.count(F.lit(1)).alias("n_at"))
    grid = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("t"))
    run = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    pos = df.agg(F.sum(F.col("y").cast("long")).alias("p"))  # one row
    c = grid.join(hist, "t", "left").fillna(0).withColumns({"tp": F.sum("tp_at").over(run), "pred": F.sum("n_at").over(run)}).join(F.broadcast(pos)).filter("pred > 0")
    return c.withColumn("f1", 2 * F.col("tp") / (F.col("pred") + F.col("p"))).agg(F.max("f1").alias("fmax"), F.max_by(F.col("t"), F.struct("f1", -F.col("t"))).alias("threshold"))


def sampled_points(n: int, dense: int = 200, even: int = 200) -> list[int]:
    """Indices for drawing a curve of n points: geometric and even steps together."""
    if n <= dense + even:
        return list(range(n))
    geometric = {min(n - 1, round(n ** (i / (dense - 1))) - 1) for i in range(dense)}
    return sorted(geometric | {round(i * (n - 1) / (even - 1)) for i in range(even)})


def curve_points(df: DataFrame, dense: int = 200, even: int = 200) -> DataFrame:
    """(idx, score, tp, fp) of the ROC curve of (score, y) at the places of `sampled_points`, 0 being the highest score."""
    points = positions(cumulative(df).withColumn("_down", -F.col("score")), "_down")
    points = stored(points.select("idx", "score", "tp", "fp"), "curve")
    wanted = df.sparkSession.createDataFrame([(i,) for i in sampled_points(points.count(), dense, even)], "idx long")  # dense + even rows at most
    return points.join(F.broadcast(wanted), "idx")
