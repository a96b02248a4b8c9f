"""Alignment by a margin loss: encoders trained on anchors by synchronous distributed mini-batches.

The baseline beside Procrustes: each species has a linear encoder x -> x a + b into the reference space, and an anchor (x, y, w) costs
-w log sigmoid(gamma - |x a + b - y|), averaged over the batch. A step is one pass over a hashed mini-batch: every task sums the
gradients of all encoders over its own anchors, the sums meet by species on the cluster, and d by d numbers a species come to the driver, which takes an Adam
step. The parameters are the same in all tasks at every step, so the result depends on the seed alone, up to the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .procrustes import vectors


@dataclass
class Encoder:
    a: np.ndarray
    b: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.a + self.b


def loss_and_gradient(e: Encoder, x: np.ndarray, y: np.ndarray, w: np.ndarray, gamma: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss and its gradients by a and b."""
    diff = e.apply(x) - y
    far = np.sqrt((diff * diff).sum(1)) + 1e-12
    t = np.clip(gamma - far, -60, 60)
    loss = float((w * np.logaddexp(0, -t)).sum())
    pull = (w / (1 + np.exp(t)) / far)[:, None] * diff
    return loss, x.T @ pull, pull.sum(0)


def train_encoders(anchors: DataFrame, by: str = "species", gamma: float = 0.1, rate: float = 0.01, steps: int = 200, batch: float = 0.25, seed: int = 42, patience: int = 20, delta: float = 1e-4) -> tuple[dict, list[float]]:
    """(encoders by species, the mean loss of each step) from anchors (by, src, ref, x, y, w). `batch` is the share of anchors in a step. Ends early
    when the mean of the last `patience` losses is not `delta` below that of the `patience` before."""
    spark = anchors.sparkSession
    kind = anchors.schema[by].dataType.simpleString()
    dims = anchors.groupBy(by).agg(F.max(F.size("x")).alias("d"), F.max(F.size("y")).alias("e")).collect()  # a row a species
    encoders = {r[by]: Encoder(np.eye(r["d"], r["e"]), np.zeros(r["e"])) for r in dims}
    first = {g: [np.zeros_like(e.a), np.zeros_like(e.b)] for g, e in encoders.items()}
    second = {g: [np.zeros_like(e.a), np.zeros_like(e.b)] for g, e in encoders.items()}
    losses: list[float] = []
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_step"), F.col(by), "src", "ref"), F.lit(1 << 20))
    for step in range(1, steps + 1):
        held = spark.sparkContext.broadcast(encoders)
        mine = anchors.withColumn("_step", F.lit(step)).filter(draw < int(batch * (1 << 20))).select(F.col(by).alias("g"), "x", "y", F.col("w").cast("double").alias("w"))

        def summed(batches, held=held):
            acc: dict = {}
            g_type = None
            for b in batches:
                g_type = b.schema.field("g").type
                if b.num_rows:
                    codes = b.column("g").dictionary_encode()
                    at = codes.indices.to_numpy(zero_copy_only=False)
                    x, y, w = vectors(b.column("x")), vectors(b.column("y")), b.column("w").to_numpy(zero_copy_only=False)
                    for i, g in enumerate(codes.dictionary.to_pylist()):
                        on = at == i
                        part = [int(on.sum()), *loss_and_gradient(held.value[g], x[on], y[on], w[on], gamma)]
                        acc[g] = [p + q for p, q in zip(acc[g], part, strict=True)] if g in acc else part
            for g, (n, loss, ga, gb) in acc.items():
                k = ga.size + gb.size
                yield pa.RecordBatch.from_arrays([pa.array([g] * k, g_type), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.concatenate([ga.ravel(), gb])), pa.array(np.full(k, n)), pa.array(np.full(k, loss))], ["g", "i", "v", "n", "loss"])

        got = mine.mapInArrow(summed, f"g {kind}, i int, v double, n long, loss double").groupBy("g", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).orderBy("g", "i").toArrow()
        held.destroy()
        total = count = 0.0
        g_all, v, n, loss = got.column("g").to_pylist(), got.column("v").to_numpy(), got.column("n").to_numpy(), got.column("loss").to_numpy()
        places: dict = {}
        for i, g in enumerate(g_all):
            places.setdefault(g, []).append(i)
        new = dict(encoders)
        for g, at in places.items():
            e, grad = encoders[g], v[at] / n[at[0]]
            total, count = total + loss[at[0]], count + n[at[0]]
            moved = []
            for j, (p, gr) in enumerate(((e.a, grad[: e.a.size].reshape(e.a.shape)), (e.b, grad[e.a.size :]))):
                first[g][j] = 0.9 * first[g][j] + 0.1 * gr
                second[g][j] = 0.999 * second[g][j] + 0.001 * gr * gr
                moved.append(p - rate * (first[g][j] / (1 - 0.9**step)) / (np.sqrt(second[g][j] / (1 - 0.999**step)) + 1e-8))
            new[g] = Encoder(*moved)
        encoders = new
        if count:
            losses.append(float(total / count))
        if len(losses) >= 2 * patience and np.mean(losses[-2 * patience : -patience]) - np.mean(losses[-patience:]) < delta:
            break
    return encoders, losses
