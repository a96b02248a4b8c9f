"""Species-level operators over presence rows (species, og): distances, density, seed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("og").isNotNull()).select("species", "og").distinct()


def prevalence(present: DataFrame, least: int = 5) -> DataFrame:
    """(og, n_species) of the orthogroups in at least `least` species."""
    return present.groupBy("og").agg(F.count(F.lit(1)).alias("n_species")).filter(F.col("n_species") >= least)


def jaccard_distances(present: DataFrame, least: int = 5) -> DataFrame:
    """(sp_i, sp_j, dist) of all ordered pairs, over prevalent orthogroups; two species without any have distance 0."""
    kept = present.join(prevalence(present, least).select("og"), "og", "left_semi")
    n = kept.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    n = present.select("species").distinct().join(n, "species", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inter = kept.select(F.col("species").alias("sp_i"), "og").join(kept.select(F.col("species").alias("sp_j"), "og"), "og").groupBy("sp_i", "sp_j").agg(F.count(F.lit(1)).alias("inter"))
    # a species table has a row a species (hundreds): its pairs are the result
    grid = n.select(F.col("species").alias("sp_i"), F.col("n").alias("ni")).crossJoin(n.select(F.col("species").alias("sp_j"), F.col("n").alias("nj")))
    union = F.col("ni") + F.col("nj") - F.coalesce("inter", F.lit(0))
    dist = F.when((F.col("sp_i") == F.col("sp_j")) | (union == 0), 0.0).otherwise(1 - F.coalesce("inter", F.lit(0)) / union)
    return grid.join(inter, ["sp_i", "sp_j"], "left").select("sp_i", "sp_j", dist.alias("dist"))


def og_counts(rows: DataFrame) -> DataFrame:
    """(species, og, n): transcripts per orthogroup."""
    return rows.filter(F.col("og").isNotNull()).groupBy("species", "og").agg(F.count("transcript").alias("n"))


def density(counts: DataFrame) -> DataFrame:
    """(sp_i, sp_j, shared, pairs) for species pairs that share an orthogroup; the diagonal has its own count and 0 pairs."""
    a, b = counts.select(F.col("species").alias("sp_i"), "og", F.col("n").alias("x")), counts.select(F.col("species").alias("sp_j"), "og", F.col("n").alias("y"))
    same = F.col("sp_i") == F.col("sp_j")
    return a.join(b, "og").groupBy("sp_i", "sp_j").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.when(same, 0).otherwise(F.col("x") * F.col("y"))).alias("pairs"))


def without_outliers(present: DataFrame) -> DataFrame:
    """(species, n_ogs, threshold, kept): kept up to Q3 + 1.5 IQR, quartiles being interpolated."""
    n = present.groupBy("species").agg(F.count(F.lit(1)).alias("n_ogs"))
    q = n.agg(F.percentile("n_ogs", F.lit(0.25)).alias("q1"), F.percentile("n_ogs", F.lit(0.75)).alias("q3"))  # one row
    top = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return n.join(F.broadcast(q)).select("species", "n_ogs", top.alias("threshold"), (F.col("n_ogs") <= top).alias("kept"))


def farthest_pair(dist: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """The most distant pair (i < j) that shares at least `least` orthogroups; the first one wins ties."""
    ok = dist.filter("sp_i < sp_j").join(shared.filter(F.col("shared") >= least).select("sp_i", "sp_j"), ["sp_i", "sp_j"])
    return ok.orderBy(F.desc("dist"), "sp_i", "sp_j").limit(1)


def greedy_seeds(dist: DataFrame, shared: DataFrame, k: int, least: int) -> list:
    """Greedy p-dispersion on the species matrix (n by n on the driver, n being the number of species)."""
    d = {(r["sp_i"], r["sp_j"]): r["dist"] for r in dist.collect()}
    ok = {(r["sp_i"], r["sp_j"]) for r in shared.filter(F.col("shared") >= least).select("sp_i", "sp_j").collect()}
    names = sorted({i for i, _ in d})
    if k > len(names):
        raise ValueError(f"k={k} exceeds the number of species ({len(names)})")
    if k < 2:
        raise ValueError("k must be >= 2")
    first = [(d[i, j], i, j) for n, i in enumerate(names) for j in names[n + 1 :] if (i, j) in ok]
    if not first:
        raise ValueError(f"No species pair shares at least {least} orthogroups")
    far = max(x[0] for x in first)
    seeds = list(next((i, j) for x, i, j in first if x == far))
    while len(seeds) < k:
        rest = [(min(d[s, x] for x in seeds), s) for s in names if s not in seeds and any((s, x) in ok for x in seeds)]
        if not rest:
            break
        most = max(r[0] for r in rest)
        seeds.append(next(s for v, s in rest if v == most))
    return seeds


def checked_seeds(present: DataFrame, seeds: list) -> list:
    """The given seeds, if all of them are species of the table; else a ValueError that names the others."""
    known = {r["species"] for r in present.filter(F.col("species").isin(seeds)).select("species").distinct().collect()}  # at most the seeds
    if unknown := [s for s in seeds if s not in known]:
        raise ValueError(f"unknown seeds {unknown}")
    return seeds


def nearest_seed(dist: DataFrame, seeds: list) -> DataFrame:
    """(species, seed, dist) for the others; the seed that is listed first wins ties."""
    order = dist.sparkSession.createDataFrame(list(enumerate(seeds)), f"ord int, sp_j {dist.schema['sp_j'].dataType.simpleString()}")
    near = dist.join(F.broadcast(order), "sp_j").join(F.broadcast(order.select(F.col("sp_j").alias("sp_i"))), "sp_i", "left_anti")
    return near.groupBy(F.col("sp_i").alias("species")).agg(F.min_by("sp_j", F.struct("dist", "ord")).alias("seed"), F.min("dist").alias("dist"))


def seed_metrics(present: DataFrame, dist: DataFrame, shared: DataFrame, seeds: list) -> DataFrame:
    """One row: distances and shared orthogroups within the seeds, distances of the others, share of orthogroups covered."""
    within = dist.filter(F.col("sp_i").isin(seeds) & F.col("sp_j").isin(seeds) & (F.col("sp_i") < F.col("sp_j"))).join(shared, ["sp_i", "sp_j"], "left")
    a = within.agg(F.min("dist").alias("seed_min_dist"), F.avg("dist").alias("seed_mean_dist"), F.min(F.coalesce("shared", F.lit(0))).cast("long").alias("seed_min_shared"), F.floor(F.avg(F.coalesce("shared", F.lit(0)))).cast("long").alias("seed_mean_shared"))
    b = nearest_seed(dist, seeds).agg(F.max("dist").alias("nonseed_max_dist"), F.avg("dist").alias("nonseed_mean_dist"))
    c = present.groupBy("og").agg(F.max(F.col("species").isin(seeds).cast("int")).alias("hit")).agg(F.avg("hit").alias("og_coverage"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def sweep(present: DataFrame, dist: DataFrame, shared: DataFrame, ks: range, least: int) -> dict[int, list]:
    """Seeds for each k that has a solution."""
    out = {}
    for k in ks:
        try:
            out[k] = greedy_seeds(dist, shared, k, least)
        except ValueError:
            continue
    return out


def average_linkage(dist: DataFrame) -> list[tuple]:
    """Merges (left members, right members, height) of average-linkage clustering of the species matrix, on the driver."""
    d = {(r["sp_i"], r["sp_j"]): r["dist"] for r in dist.collect()}
    groups = [(s,) for s in sorted({i for i, _ in d})]
    merges = []
    while len(groups) > 1:
        mean = lambda x, y: sum(d[i, j] for i in x for j in y) / (len(x) * len(y))
        h, i, j = min((round(mean(x, y), 9), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        merges.append((groups[i], groups[j], h))
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [groups[i] + groups[j]]
    return merges
