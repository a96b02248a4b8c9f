"""The test tables in the roles of networks, orthogroups, embeddings and annotations.

Each role is given twice: as a DataFrame, and as a SQL relation of the same name and columns (`WITH` takes names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges among parts of one order; w is the quantity of the source line."""
    li = table(spark, sf, "lineitem")
    a = li.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_quantity").alias("w"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").filter("src <> dst").select("src", "dst", "w")


#: Lines whose edges one task makes and groups.
TASK_LINES = 200_000


def edge_parts(spark: SparkSession, sf: str) -> int:
    """Partitions that bound what a task has of the edges."""
    return max(1, -(-table(spark, sf, "lineitem").count() // TASK_LINES), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The network of `raw_edges`, where an order gives each pair of its parts once, at the larger quantity."""
    n = edge_parts(spark, sf)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(n, "l_orderkey")
    a = li.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_quantity").alias("_w"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("_v"))
    return graph.dedup_max(a.join(b, "l_orderkey").filter("src < dst").select("src", "dst", F.greatest("_w", "_v").alias("w")), n)


def part_og(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.concat_ws("|", "p_brand", "p_type").alias("og"))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """(species, idx, id, og, v): five species of embedded genes."""
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 5).cast("int").alias("species"), F.floor(F.col("vec_id") / 5).alias("idx"), F.col("vec_id").alias("id"), F.col("label").alias("og"), F.col("embedding").alias("v"))


def two_species(spark: SparkSession, sf: str) -> DataFrame:
    """(species, idx, id, og, v): all embedded genes as two species, those with even and with odd ids, and 100 orthogroups."""
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 2).cast("int").alias("species"), F.floor(F.col("vec_id") / 2).alias("idx"), F.col("vec_id").alias("id"), (F.floor(F.col("vec_id") / 2) % 100).alias("og"), F.col("embedding").alias("v"))


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, el): orders and the parts in them."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gene"), F.col("l_partkey").alias("el")).distinct()


def species_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(species, og, transcript): nations of suppliers, parts, line items."""
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("og"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transcript"))
    return li.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("species")), "l_suppkey").select("species", "og", "transcript")


def slice_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected edges among embedded genes of one species (even and odd ids): an order links the remainders of its customer and of its number."""
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))  # one row
    o = table(spark, sf, "orders").join(F.broadcast(n)).select((F.col("o_custkey") % F.col("n")).alias("x"), (F.col("o_orderkey") % F.col("n")).alias("y"))
    return o.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b and a % 2 = b % 2").distinct()


def slice_og(spark: SparkSession, sf: str) -> DataFrame:
    """(species, gene, og) with 100 orthogroups that run over the two species."""
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("species"), F.col("vec_id").alias("gene"), (F.floor(F.col("vec_id") / 2) % 100).alias("og"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(id, grp, score, y): documents with labels; the score rises with the length."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"), F.col("quality").alias("y"), F.col("toxic").alias("y2"))


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, term, is_test, species): users, kinds of events by hour, every fifth user in the test split."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("gene"), F.concat_ws("@", "event_type", F.hour("ts").cast("string")).alias("term"), (F.col("user_id") % 5 == 0).alias("is_test"), (F.col("user_id") % 3).alias("species"))


SQL = {
    "raw_edges": "SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_quantity AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey",
    "edges": "SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM raw_edges GROUP BY 1, 2",
    "nbrs": "SELECT a AS gene, b AS nbr FROM edges UNION SELECT b, a FROM edges",
    "part_og": "SELECT p_partkey AS gene, p_brand || '|' || p_type AS og FROM part",
    "og_nbrs": "SELECT DISTINCT n.gene, p.og FROM nbrs n JOIN part_og p ON n.nbr = p.gene",
    "genes": "SELECT CAST(vec_id % 5 AS INT) AS species, vec_id // 5 AS idx, vec_id AS id, label AS og, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "unit": "SELECT species, idx, id, og, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v FROM genes",
    "genes2": "SELECT CAST(vec_id % 2 AS INT) AS species, vec_id // 2 AS idx, vec_id AS id, (vec_id // 2) % 100 AS og, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "unit2": "SELECT species, idx, id, og, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v FROM genes2",
    "order_parts": "SELECT DISTINCT l_orderkey AS gene, l_partkey AS el FROM lineitem",
    "species_rows": "SELECT s_nationkey AS species, l_partkey AS og, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transcript FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "present": "SELECT DISTINCT species, og FROM species_rows",
    "kept": "SELECT species, og FROM present WHERE og IN (SELECT og FROM present GROUP BY og HAVING count(*) >= 5)",
    "sp_n": "SELECT s.species, count(k.og) AS n FROM (SELECT DISTINCT species FROM present) s LEFT JOIN kept k ON s.species = k.species GROUP BY 1",
    "dist": "SELECT i.species AS sp_i, j.species AS sp_j, CASE WHEN i.species = j.species OR i.n + j.n - coalesce(x.inter, 0) = 0 THEN 0.0 ELSE 1 - coalesce(x.inter, 0) / (i.n + j.n - coalesce(x.inter, 0)) END AS dist FROM sp_n i CROSS JOIN sp_n j LEFT JOIN (SELECT a.species AS si, b.species AS sj, count(*) AS inter FROM kept a JOIN kept b ON a.og = b.og GROUP BY 1, 2) x ON x.si = i.species AND x.sj = j.species",
    "counts": "SELECT species, og, count(transcript) AS n FROM species_rows WHERE og IS NOT NULL GROUP BY 1, 2",
    "density": "SELECT a.species AS sp_i, b.species AS sp_j, count(*) AS shared, sum(CASE WHEN a.species = b.species THEN 0 ELSE a.n * b.n END) AS pairs FROM counts a JOIN counts b ON a.og = b.og GROUP BY 1, 2",
    "slice_edges": "SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT o_custkey % n AS x, o_orderkey % n AS y FROM orders CROSS JOIN (SELECT count(*) AS n FROM embeddings)) WHERE x <> y AND x % 2 = y % 2",
    "slice_og": "SELECT vec_id % 2 AS species, vec_id AS gene, (vec_id // 2) % 100 AS og FROM embeddings",
    "slice_nbrs": "SELECT a AS gene, b AS nbr FROM slice_edges UNION SELECT b, a FROM slice_edges",
    "slice_sets": "SELECT DISTINCT n.gene, o.og FROM slice_nbrs n JOIN slice_og o ON n.nbr = o.gene",
    "slice_truth": "SELECT p.u, p.v, count(*) / (any_value(p.nu) + any_value(p.nv) - count(*)) AS s FROM (SELECT a.gene AS u, b.gene AS v, x.n AS nu, y.n AS nv FROM slice_og a JOIN slice_og b ON a.og = b.og JOIN (SELECT gene, count(*) AS n FROM slice_sets GROUP BY 1) x ON x.gene = a.gene JOIN (SELECT gene, count(*) AS n FROM slice_sets GROUP BY 1) y ON y.gene = b.gene WHERE a.species = 0 AND b.species = 1) p JOIN slice_sets l ON l.gene = p.u JOIN slice_sets r ON r.gene = p.v AND r.og = l.og GROUP BY p.u, p.v",
    "ranked_truth": "SELECT u, v, s, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS place FROM slice_truth",
    "knn01": "SELECT * FROM (SELECT q.id AS q, c.id AS nbr, round(list_dot_product(q.v, c.v), 9) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.id) AS rank FROM unit2 q CROSS JOIN unit2 c WHERE q.species = 0 AND c.species = 1) WHERE rank <= 50",
    "knn10": "SELECT * FROM (SELECT q.id AS q, c.id AS nbr, round(list_dot_product(q.v, c.v), 9) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.id) AS rank FROM unit2 q CROSS JOIN unit2 c WHERE q.species = 1 AND c.species = 0) WHERE rank <= 10",
    "labelled": "SELECT d.doc_id AS id, d.lang AS grp, d.n_chars / (d.n_chars + CAST(2000 AS DOUBLE)) AS score, l.quality AS y, l.toxic AS y2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "annotated": "SELECT user_id AS gene, event_type || '@' || CAST(hour(ts) AS VARCHAR) AS term, user_id % 5 = 0 AS is_test, user_id % 3 AS species FROM events",
}


def using(body: str) -> str:
    """`body` with the roles it names, and those that they name, as common table expressions."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in need:
                visit(SQL[name])
                need.append(name)

    visit(body)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    if not need:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
