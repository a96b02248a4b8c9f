"""L2 logistic regression of many (fold, class) pairs at once, by Newton steps over the whole cluster.

Rows are (fold, x, labels), labels being an array of (class, y). A step is one pass over the rows: every task sums the gradient and the Hessian of
each fit over its own rows, the sums of a fit meet in one task as d + 1 by d + 1 blocks, and that task solves for the step. Only
steps, d + 1 numbers a fit, reach the driver, which sends the weights out again. The rows of a class lie in all tasks, so neither a frequent
class nor a large fold fills one. A task holds the Hessians of at most `held_bytes` at a time; more fits take turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .procrustes import vectors

CLIP = 30.0


@dataclass
class Fits:
    """Weights (the intercept last) or a constant score for each (fold, class); folds are None where all rows train one fit a class."""

    folds: list | None
    weights: dict = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    passes: int = 0


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -CLIP, CLIP)))


def _labels(batch: pa.RecordBatch):
    """(class, rows, y) of each class in a batch."""
    lists = batch.column("labels")
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    each = lists.flatten()
    classes = each.field("class").dictionary_encode()
    codes, y = classes.indices.to_numpy(zero_copy_only=False), each.field("y").to_numpy(zero_copy_only=False)
    for i, cls in enumerate(classes.dictionary.to_pylist()):
        at = np.flatnonzero(codes == i)
        yield cls, rows[at], y[at]


def _design(batch: pa.RecordBatch) -> np.ndarray:
    x = vectors(batch.column("x"))
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def fits(rows: DataFrame, folds: list | None, c: float = 1.0, steps: int = 50, tol: float = 1e-8, held_bytes: int = 256 << 20) -> Fits:
    """For each class, and each of `folds` (on the rows of the others) or all rows (None): the minimum of c times the summed loss plus |w|^2/2, intercept free."""
    out = Fits(folds)
    n = rows.select("fold", F.explode("labels").alias("l")).groupBy(F.col("l.class").alias("class"), "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("l.y").alias("p")).collect()  # a row a class and fold
    size = rows.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    whole: dict = {}
    for r in n:
        t = whole.setdefault(r["class"], [0, 0.0])
        t[0], t[1] = t[0] + r["n"], t[1] + r["p"]
    own = {(r["fold"], r["class"]): (r["n"], r["p"]) for r in n}
    todo = []
    for cls, (total, pos) in whole.items():
        for f in folds if folds is not None else [None]:
            less = own.get((f, cls), (0, 0.0)) if folds is not None else (0, 0.0)
            left, p = total - less[0], pos - less[1]
            if left == 0 or p == 0 or p == left:
                out.constants[f, cls] = 1.0 if left and p == left else 0.0
            else:
                todo.append((f, cls))
    at_once = max(1, held_bytes // (8 * (size + 1) ** 2))
    for lo in range(0, len(todo), at_once):
        _newton(rows, todo[lo : lo + at_once], size + 1, out, c, steps, tol)
    return out


def _newton(rows: DataFrame, keys: list, width: int, out: Fits, c: float, steps: int, tol: float) -> None:
    spark = rows.sparkSession
    penalty = np.ones(width)
    penalty[-1] = 0.0
    w = {i: np.zeros(width) for i in range(len(keys))}
    open_ = set(w)
    everywhere = out.folds is None
    for _ in range(steps):
        held = spark.sparkContext.broadcast(({i: w[i] for i in open_}, keys))

        def summed(batches, held=held):
            now, keys = held.value
            by: dict = {}
            for i in now:
                by.setdefault(keys[i][1], []).append(i)
            acc = {i: [np.zeros(width), np.zeros((width, width))] for i in now}
            for b in batches:
                if not b.num_rows:
                    continue
                z, fold = _design(b), None if everywhere else np.array(b.column("fold").to_pylist(), object)
                for cls, at, y in _labels(b):
                    for i in by.get(cls, []):
                        use = slice(None) if everywhere else fold[at] != keys[i][0]
                        zz, yy = z[at[use]], y[use]
                        p = sigmoid(zz @ now[i])
                        acc[i][0] += zz.T @ (p - yy)
                        acc[i][1] += (zz * (p * (1 - p))[:, None]).T @ zz
            for i, (g, h) in acc.items():
                if h.any() or g.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([g.tolist()], pa.list_(pa.float64())), pa.array([h.ravel().tolist()], pa.list_(pa.float64()))], ["fit", "g", "h"])

        def solved(batches, held=held):
            now, _ = held.value
            acc: dict = {}
            for b in batches:
                for i, g, h in zip(b.column(0).to_pylist(), vectors(b.column(1)), vectors(b.column(2)), strict=True):
                    acc[i] = (acc[i][0] + g, acc[i][1] + h) if i in acc else (g, h)
            for i, (g, h) in acc.items():
                step = np.linalg.solve(c * h.reshape(width, width) + np.diag(penalty + 1e-9), c * g + penalty * now[i])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([step.tolist()], pa.list_(pa.float64()))], ["fit", "step"])

        sums = rows.mapInArrow(summed, "fit int, g array<double>, h array<double>").repartition(max(1, min(len(open_), 64)), "fit")
        moved = sums.mapInArrow(solved, "fit int, step array<double>").collect()
        held.destroy()
        out.passes += 1
        for r in moved:
            step = np.array(r["step"])
            w[r["fit"]] -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < tol:
                open_.discard(r["fit"])
        if not open_:
            break
    out.weights.update({keys[i]: x for i, x in w.items()})


def scores(rows: DataFrame, found: Fits) -> DataFrame:
    """(id, fold, class, y, score) of rows (id, fold, x, labels) by the fits that did not see their fold; 0 for an unknown class. Broadcasts d + 1 numbers a fit."""
    held = rows.sparkSession.sparkContext.broadcast(found)
    label = rows.schema["labels"].dataType.elementType
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, fold {rows.schema['fold'].dataType.simpleString()}, class {label['class'].dataType.simpleString()}, y double, score double"

    def run(batches):
        found = held.value
        for b in batches:
            if not b.num_rows:
                continue
            z, fold = _design(b), b.column("fold").to_pylist()
            class_type = b.schema.field("labels").type.value_type.field("class").type
            for cls, at, y in _labels(b):
                score = np.zeros(len(at))
                folds = np.array([None if found.folds is None else fold[i] for i in at], object)
                for f in dict.fromkeys(folds):
                    on = np.array([x == f for x in folds])
                    if (f, cls) in found.weights:
                        score[on] = sigmoid(z[at[on]] @ found.weights[f, cls])
                    else:
                        score[on] = found.constants.get((f, cls), 0.0)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("fold").take(take), pa.array([cls] * len(at), class_type), pa.array(y), pa.array(score)], ["id", "fold", "class", "y", "score"])

    return rows.select("id", "fold", "x", "labels").mapInArrow(run, kinds)


def residuals(rows: DataFrame, found: Fits, c: float = 1.0) -> DataFrame:
    """(fold, class, residual): the largest entry of the gradient at the weights found, summed from the rows once more, in tasks, with all folds of a class in one product."""
    weights = [(str(f), str(cls), w.tolist()) for (f, cls), w in found.weights.items()]
    table = rows.sparkSession.createDataFrame(weights, "f string, cls string, w array<double>")  # d + 1 numbers a fit
    held = rows.sparkSession.sparkContext.broadcast(found.weights)
    everywhere = found.folds is None

    def summed(batches):
        by: dict = {}
        for f, cls in held.value:
            by.setdefault(cls, []).append(f)
        acc = {key: np.zeros(len(w)) for key, w in held.value.items()}
        for b in batches:
            if not b.num_rows:
                continue
            z, fold = _design(b), None if everywhere else np.array(b.column("fold").to_pylist(), object)
            for cls, at, y in _labels(b):
                own = by.get(cls, [])
                if own:
                    zz = z[at]
                    with np.errstate(over="ignore"):
                        off = 1 / (1 + np.exp(-(zz @ np.stack([held.value[f, cls] for f in own], 1)))) - y[:, None]
                    if not everywhere:
                        off[fold[at][:, None] == np.array(own, object)[None, :]] = 0.0
                    for f, g in zip(own, (zz.T @ off).T, strict=True):
                        acc[f, cls] += g
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array([str(f) for f, _ in acc]), pa.array([str(cls) for _, cls in acc]), pa.array([g.tolist() for g in acc.values()], pa.list_(pa.float64()))], ["f", "cls", "g"])

    part = rows.select("fold", "x", "labels").mapInArrow(summed, "f string, cls string, g array<double>")  # a row a task and fit
    part = part.select("f", "cls", F.posexplode("g").alias("i", "x")).groupBy("f", "cls", "i").agg(F.sum("x").alias("g"))
    pull = table.select("f", "cls", F.posexplode("w").alias("i", "wi"), (F.size("w") - 1).alias("last"))
    total = F.abs(c * F.col("g") + F.when(F.col("i") < F.col("last"), F.col("wi")).otherwise(0.0))
    return part.join(F.broadcast(pull), ["f", "cls", "i"]).groupBy(F.col("f").alias("fold"), F.col("cls").alias("class")).agg(F.max(total).alias("residual"))
