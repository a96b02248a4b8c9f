"""Labels, folds, scalers, classifiers and their metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import logistic
from .procrustes import vectors

#: The ten compartments of the location task.
COMPARTMENTS = ["Cytoplasm", "Nucleus", "Extracellular", "Cell membrane", "Mitochondrion", "Plastid", "Endoplasmic reticulum", "Lysosome/Vacuole", "Golgi apparatus", "Peroxisome"]


def multi_hot(df: DataFrame, key: str, label: str, classes: list) -> DataFrame:
    """One 0/1 column per class, in the given order; other labels are ignored."""
    known = df.filter(F.col(label).isin(classes))
    return known.groupBy(key).agg(*[F.max((F.col(label) == c).cast("int")).alias(str(c)) for c in classes])


def known_compartments(df: DataFrame, label: str = "label") -> DataFrame:
    """The rows whose label is one of the task's compartments."""
    return df.filter(F.col(label).isin(COMPARTMENTS))


def available(*tables: DataFrame) -> DataFrame:
    """(gene, n_tables): genes that any of the tables (gene, ...) has, and in how many of them."""
    genes = None
    for t in tables:
        g = t.select("gene").distinct()
        genes = g if genes is None else genes.unionByName(g)
    return genes.groupBy("gene").agg(F.count(F.lit(1)).alias("n_tables"))


def fold_scores(data: DataFrame, fold: str, c: float = 1.0) -> DataFrame:
    """(fold, class, id, y, score): for each value of `fold`, classifiers trained on the other folds score it. data is (id, class, y, x) with
    the fold, a gene's x being the same in all its rows. All fits advance together (`logistic`)."""
    rows = data.groupBy("id", F.col(fold).alias("fold")).agg(F.first("x").alias("x"), F.collect_list(F.struct("class", F.col("y").cast("double").alias("y"))).alias("labels"))
    rows = stored(rows, "fold-rows")
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]  # a few folds
    scored = logistic.scores(rows, logistic.fits(rows, folds, c)).withColumn("y", F.col("y").cast(data.schema["y"].dataType))
    return scored.select("fold", "class", "id", "y", "score")


def cross_validated(data: DataFrame, fold: str, c: float = 1.0, cut: float = 0.5) -> DataFrame:
    """(fold, n_test, f1_micro, f1_macro, jaccard_micro, accuracy) of `fold_scores` at a cut: homology partitions, or a species left out each."""
    scored = stored(fold_scores(data, fold, c).withColumn("yhat", (F.col("score") >= cut).cast("int")), "fold-scores")
    out = None
    for r in scored.select("fold").distinct().collect():
        part = scored.filter(F.col("fold") == r["fold"])
        row = label_metrics(part).crossJoin(part.agg(F.countDistinct("id").alias("n_test"))).withColumn("fold", F.lit(r["fold"]))  # single rows
        out = row if out is None else out.unionByName(row)
    return out.select("fold", "n_test", "f1_micro", "f1_macro", "jaccard_micro", "accuracy")


def term_transfer(data: DataFrame, group: str = "species", least_train: int = 10, least_test: int = 1, c: float = 1.0) -> DataFrame:
    """(held_out, n_terms, fmax, macro_ap): for each group left out, the terms with enough positives on both sides are scored there by
    classifiers on the other groups. data is (group, id, class, y, x)."""
    from . import curves

    out = None
    for r in data.select(group).distinct().collect():  # a few groups
        held = F.col(group) == r[group]
        found = evaluable_terms(data.filter("y = 1").select(F.col("id").alias("gene"), F.col("class").alias("term"), held.alias("is_test")), least_train, least_test)
        use = data.join(F.broadcast(found.select(F.col("term").alias("class"))), "class", "left_semi")  # a row a term
        scored = one_vs_rest(use.filter(~held), use.filter(held), c).join(use.filter(held).select("id", "class", "y"), ["id", "class"])
        per = curves.pr_summary(scored, "class").agg(F.count(F.lit(1)).alias("n_terms"), F.avg("ap").alias("macro_ap"))
        row = curves.fmax_micro(scored).select("fmax").crossJoin(per).withColumn("held_out", F.lit(r[group]))  # single rows
        out = row if out is None else out.unionByName(row)
    return out.select("held_out", "n_terms", "fmax", "macro_ap")


def transfer(labels: DataFrame, features: dict[str, DataFrame], train, test, group: str = "species", c: float = 1.0, cut: float = 0.5) -> DataFrame:
    """(condition, n_test, f1_micro, f1_macro, jaccard_micro, accuracy) of classifiers trained on one group and tested on another, for each named
    feature table (id, x); labels are (group, id, class, y). Genes that a table lacks drop out of its condition."""
    out = None
    for name, table in features.items():
        rows = labels.filter(F.col(group).isin([train, test])).join(table.select("id", "x"), "id")
        held = rows.filter(F.col(group) == test)
        scored = one_vs_rest(rows.filter(F.col(group) == train), held, c).join(held.select("id", "class", "y"), ["id", "class"])
        scored = stored(scored.withColumn("yhat", (F.col("score") >= cut).cast("int")), "transfer")
        row = label_metrics(scored).crossJoin(scored.agg(F.countDistinct("id").alias("n_test"))).withColumn("condition", F.lit(name))  # single rows
        out = row if out is None else out.unionByName(row)
    return out.select("condition", "n_test", "f1_micro", "f1_macro", "jaccard_micro", "accuracy")


def term_cross_validation(data: DataFrame, fold: str, least: int = 10, c: float = 1.0) -> DataFrame:
    """(class, n, fmax, ap) of every term with at least `least` positive genes, from the scores of the folds that did not train on them."""
    from . import curves

    often = data.filter("y = 1").groupBy("class").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least)
    scored = stored(fold_scores(data.join(often.select("class"), "class", "left_semi"), fold, c), "term-scores")
    return curves.pr_summary(scored.select("class", "score", "y"), "class").join(often, "class").select("class", "n", "fmax", "ap")


def dominant_cluster(assigned: DataFrame, label: str) -> DataFrame:
    """(label, cluster, n, share): the cluster that holds most rows of a label; ties to the smaller cluster."""
    n = assigned.groupBy(label, "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("_t"))
    best = n.groupBy(label).agg(F.max(F.struct(F.col("n"), (-F.col("cluster")).alias("c"))).alias("_b"))
    return best.join(total, label).select(label, (-F.col("_b.c")).alias("cluster"), F.col("_b.n").alias("n"), (F.col("_b.n") / F.col("_t")).alias("share"))


def unpivoted(df: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """(key, label) of the classes with a positive value; rows without any drop out."""
    return df.unpivot([key], classes, "label", "value").filter("value > 0").select(key, "label")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, salt: str = "fold") -> DataFrame:
    """fold 0..k-1, dealt within each label in the order of a hash."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), key)
    return df.withColumn("fold", (F.row_number().over(order) - 1) % k)


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """Per held-out group: n_test and n_train."""
    n = df.groupBy(F.col(group).alias("held_out")).agg(F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return n.join(F.broadcast(total)).select("held_out", "n_test", (F.col("_n") - F.col("n_test")).alias("n_train"))


def evaluable_terms(annot: DataFrame, least_train: int = 10, least_test: int = 1) -> DataFrame:
    """Terms with enough distinct positive genes in either split; annot is (gene, term, is_test)."""
    g = annot.groupBy("term").agg(F.countDistinct(F.when(~F.col("is_test"), F.col("gene"))).alias("n_train"), F.countDistinct(F.when(F.col("is_test"), F.col("gene"))).alias("n_test"))
    return g.filter((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test))


def frequent_terms(annot: DataFrame, least: int = 10, *by: str) -> DataFrame:
    """Rows whose term has at least `least` rows (repeats count) in its group."""
    return annot.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "term"))).filter(F.col("_n") >= least).drop("_n")


def shared_terms(annot: DataFrame, least: int = 2) -> DataFrame:
    """(term, n_species) of terms in at least `least` species."""
    return annot.groupBy("term").agg(F.countDistinct("species").alias("n_species")).filter(F.col("n_species") >= least)


def standardised(df: DataFrame, columns: list[str], train=None) -> DataFrame:
    """(x - mean) / population deviation, fitted on the rows where `train` holds; a deviation of 0 counts as 1."""
    base = df if train is None else df.filter(train)
    stats = base.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])  # one row
    out = df.join(F.broadcast(stats))
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))).alias(c) for c in columns]
    return out.select(*[c for c in df.columns if c not in columns], *scaled)


def label_metrics(df: DataFrame) -> DataFrame:
    """Of (id, class, y, yhat) with 0/1 values: f1_micro, f1_macro over all classes, jaccard_micro, subset accuracy."""
    by_class = df.groupBy("class").agg(F.sum(F.col("y") * F.col("yhat")).alias("tp"), F.sum((1 - F.col("y")) * F.col("yhat")).alias("fp"), F.sum(F.col("y") * (1 - F.col("yhat"))).alias("fn"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    a = by_class.agg(F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1_micro"), F.avg(f1).alias("f1_macro"), F.coalesce(tp / F.nullif(tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("jaccard_micro"))
    exact = df.groupBy("id").agg(F.min((F.col("y") == F.col("yhat")).cast("double")).alias("same")).agg(F.avg("same").alias("accuracy"))
    return a.crossJoin(exact)  # single rows


def mcc(df: DataFrame) -> DataFrame:
    """(class, mcc) of classes that occur in y; 0 where a margin is empty."""
    y, h = F.col("y").cast("double"), F.col("yhat").cast("double")
    g = df.groupBy("class").agg(F.sum(y * h).alias("tp"), F.sum((1 - y) * h).alias("fp"), F.sum(y * (1 - h)).alias("fn"), F.sum((1 - y) * (1 - h)).alias("tn")).filter("tp + fn > 0")
    under = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return g.select("class", F.coalesce((F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.nullif(under, F.lit(0.0)), F.lit(0.0)).alias("mcc"))


def knn_transfer(knn: DataFrame, labels: DataFrame, k: int = 50) -> DataFrame:
    """(q, term, score): the share of the k nearest training genes that have the term; labels are (gene, term)."""
    near = knn.filter(F.col("rank") <= k).select("q", F.col("nbr").alias("gene"))
    return near.join(labels.select("gene", "term").distinct(), "gene").groupBy("q", "term").agg((F.count(F.lit(1)) / k).alias("score"))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """L2 logistic regression by Newton steps: c times the summed loss plus |w|^2/2, the intercept (last) free."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, penalty = np.zeros(z.shape[1]), np.ones(z.shape[1])
    penalty[-1] = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = c * z.T @ (p - y) + penalty * w
        hess = c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def one_vs_rest(train: DataFrame, test: DataFrame, c: float = 1.0) -> DataFrame:
    """(id, class, score): one classifier a class, all fitted together over the whole cluster. train is (class, y, x), test (class, id, x); a class
    without both values scores its constant, one without training rows 0."""
    labels = lambda y: F.array(F.struct("class", y.cast("double").alias("y")))
    rows = stored(train.select(F.lit(0).alias("fold"), "x", labels(F.col("y")).alias("labels")), "train-rows")
    asked = test.select("id", F.lit(0).alias("fold"), "x", labels(F.lit(0.0)).alias("labels"))
    return logistic.scores(asked, logistic.fits(rows, None, c)).select("id", "class", "score")


def clusters(points: DataFrame, k: int = 12, seed: int = 42, batches: int = 40, batch_rows: int = 50_000) -> DataFrame:
    """(columns of points, cluster) by mini-batch k-means on the array column x.

    A batch holds about `batch_rows` points, chosen by a hash of id and step. Tasks assign their points to the nearest centre and sum them by centre; the sums, k by d
    numbers, move each centre by its own learning rate, one over the points it has got so far. Centres start far apart among a bounded sample."""
    spark = points.sparkSession
    n = points.count()
    rows = points.select(F.col("id"), F.col("x").cast("array<double>").alias("x"))
    pick = lambda step, want: F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "id"), F.lit(1 << 30)) < int(min(1.0, want / max(1, n)) * (1 << 30))
    some = rows.filter(pick(-1, 64 * k)).limit(256 * k).orderBy("id").toArrow()
    x = vectors(some.column("x"))
    if not len(x):
        return points.withColumn("cluster", F.lit(0))
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    rng = np.random.default_rng(seed)
    while len(chosen) < min(k, len(x)) and near.max() > 0:
        tries = rng.choice(len(x), 8, p=near / near.sum())  # k-means++: of a few draws that which lowers the cost most
        best = min(tries, key=lambda i: np.minimum(near, ((x - x[i]) ** 2).sum(1)).sum())
        chosen.append(int(best))
        near = np.minimum(near, ((x - x[best]) ** 2).sum(1))
    centres, seen = x[chosen], np.zeros(len(chosen))

    def nearest(c: np.ndarray, v: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1)[None, :] - 2 * v @ c.T).argmin(1)

    for step in range(batches):
        held = spark.sparkContext.broadcast(centres)

        def summed(parts, held=held):
            c = held.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in parts:
                v = vectors(b.column("x"))
                if len(v):
                    at = nearest(c, v)
                    np.add.at(total, at, v)
                    count += np.bincount(at, minlength=len(c))
            on = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(count[on]), pa.array(total[on].tolist(), pa.list_(pa.float64()))], ["c", "n", "s"])

        d = centres.shape[1]
        got = rows.filter(pick(step, batch_rows)).mapInArrow(summed, "c long, n long, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d)]).toArrow()
        held.destroy()
        c, m = got.column("c").to_numpy(), got.column("n").to_numpy()
        total = np.stack([got.column(f"s{i}").to_numpy() for i in range(d)], 1) if len(c) else np.zeros((0, d))
        centres = centres.copy()
        seen[c] += m
        moved = (m / seen[c])[:, None] * (total / m[:, None] - centres[c])
        centres[c] += moved
        if step and np.abs(moved).max(initial=0.0) < 1e-9:
            break
    last = spark.sparkContext.broadcast(centres)

    def assigned(parts):
        for b in parts:
            v = vectors(b.column("_x"))
            at = nearest(last.value, v) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(at.astype(np.int32))], ["_row", "cluster"])

    packed = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_row"), F.col("x").cast("array<double>").alias("_x"))
    return packed.mapInArrow(assigned, f"_row {packed.schema['_row'].dataType.simpleString()}, cluster int").select("_row.*", "cluster")


def within_box(points: DataFrame, box: DataFrame, pad: float = 0.0) -> DataFrame:
    """The points (id, px, py) inside the bounding box of `box` widened by `pad`."""
    b = box.agg(*[f(c).alias(f"_{n}{c}") for c in ("px", "py") for f, n in ((F.min, "lo"), (F.max, "hi"))])  # one row
    inside = F.col("px").between(F.col("_lopx") - pad, F.col("_hipx") + pad) & F.col("py").between(F.col("_lopy") - pad, F.col("_hipy") + pad)
    return points.join(F.broadcast(b)).filter(inside).select(*points.columns)


def subsample(df: DataFrame, group: str, key: str, n: int, salt: str = "sample", forced=None) -> DataFrame:
    """At most n rows a group, forced ones first, then by a hash."""
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), F.col(key)]
    if forced is not None:
        order.insert(0, F.desc(forced.cast("int")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
