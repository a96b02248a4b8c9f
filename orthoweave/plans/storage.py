"""Queries over sources and sinks: each writes a role of the test tables in the format of a file and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import vectors as vec
from ..operators import graph, orthologs, vector
from ..sources import manifest, readers, writers
from ..sources.shared import shared_dir
from . import roles
from .registry import query, r6


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tsv(df, *columns: str):
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


@query("SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(w AS DOUBLE) AS w FROM raw_edges")
def scan_raw_network(spark, sf):
    at = _folder(spark, "raw")
    roles.raw_edges(spark, sf).write.csv(at, sep="\t", header=True)
    return readers.raw_network(spark, at)


@query("SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(w AS DOUBLE) AS w FROM edges")
def sink_clean_network(spark, sf):
    at = _folder(spark, "clean")
    writers.network(roles.edges(spark, sf), at, roles.edge_parts(spark, sf))
    return readers.network(spark, at)


@query("SELECT a AS protein1, b AS protein2, CAST(trunc(w / (SELECT max(w) FROM edges) * 1000) AS INT) AS score FROM edges")
def sink_scored_network(spark, sf):
    at = _folder(spark, "scored")
    writers.scored_network(roles.edges(spark, sf), at)
    return spark.read.csv(at, sep=" ", header=True, schema="protein1 long, protein2 long, score int")


@query("SELECT r_name AS species, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(n_nationkey AS DOUBLE) / 2 AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_networks_by_species(spark, sf):
    """One gzip file a region; a line with a single field is skipped."""
    at = _folder(spark, "networks")
    n = _nations(spark, sf)
    for r in n.select("r_name").distinct().collect():
        rows = _tsv(n.filter(F.col("r_name") == r["r_name"]).withColumn("w", F.col("n_nationkey") / 2), "n_nationkey", "n_name", "w")
        writers.text_file(rows.unionByName(spark.createDataFrame([("broken",)], "value string")), f"{at}/{r['r_name']}.tsv.gz")
    return readers.networks_by_species(spark, at)


def _nations(spark, sf):
    return roles.table(spark, sf, "nation").join(roles.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _og_folder(spark, sf) -> str:
    at = _folder(spark, "tables")
    n = _nations(spark, sf).withColumn("og", F.when(F.col("n_nationkey") != 3, F.concat(F.lit("OG"), (F.col("n_nationkey") % 4).cast("string"))))
    head = spark.createDataFrame([("Transcript_ID\tProtein_ID\tOrthogroup",)], "value string")
    for r in n.select("r_name").distinct().collect():
        rows = _tsv(n.filter(F.col("r_name") == r["r_name"]), "n_nationkey", "n_name", "og")
        writers.text_file(head.unionByName(rows), f"{at}/{r['r_name']}{readers.OG_SUFFIX}")
    return at


@query("SELECT r_name AS species, CAST(n_nationkey AS VARCHAR) AS transcript_id, n_name AS protein_id, 'OG' || (n_nationkey % 4) AS og FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3")
def scan_orthogroups(spark, sf):
    return readers.orthogroups(spark, _og_folder(spark, sf))


@query("SELECT r_name AS species FROM region WHERE r_name <> 'ASIA'")
def scan_valid_species(spark, sf):
    """Species with both a network and a table: ASIA has no network."""
    tables, nets = _og_folder(spark, sf), _folder(spark, "nets")
    for r in roles.table(spark, sf, "region").filter("r_name <> 'ASIA'").collect():
        writers.text_file(spark.createDataFrame([("a\tb\t1",)], "value string"), f"{nets}/{r['r_name']}{readers.NETWORK_SUFFIX}")
    return spark.createDataFrame([(s,) for s in readers.valid_species(spark, nets, tables)], "species string")


@query("SELECT idx AS ia, id AS ib, CASE WHEN idx % 2 = 0 THEN 1.0 ELSE og / 2 END AS w FROM genes2")
def scan_anchor_pairs(spark, sf):
    """Files of three columns, and of two, whose weight is 1."""
    at, g = _folder(spark, "pairs"), roles.two_species(spark, sf)
    _tsv(g.filter("idx % 2 = 0"), "idx", "id").write.text(f"{at}/two")
    _tsv(g.filter("idx % 2 = 1").withColumn("w", F.col("og") / 2), "idx", "id", "w").write.text(f"{at}/three")
    return readers.anchor_pairs(spark, f"{at}/*")


@query("SELECT idx AS ia, id AS ib, CAST(og AS DOUBLE) AS w FROM genes2 WHERE species = 1")
def scan_resolved_pairs(spark, sf):
    at, g = _folder(spark, "resolved"), roles.two_species(spark, sf)
    writers.text_file(_tsv(g.filter("species = 0"), "idx", "id", "og"), f"{at}/seeds/A_B.tsv")
    writers.text_file(_tsv(g.filter("species = 1"), "idx", "id", "og"), f"{at}/non_seeds/C/A_C.tsv")
    return readers.resolved_pairs(spark, at, "C", "A")


@query("SELECT idx AS ia, id AS ib FROM genes WHERE species IN (1, 3)")
def sink_pair_table(spark, sf):
    at, g = _folder(spark, "pair-table"), roles.genes(spark, sf)
    name = F.concat(F.lit("s"), F.col("species").cast("string"))
    writers.pair_table(g.select(F.when(F.col("species").isin(1, 3), "a").otherwise(name).alias("sp_a"), F.when(F.col("species").isin(1, 3), "b").otherwise("z").alias("sp_b"), F.col("idx").alias("ia"), F.col("id").alias("ib")), at)
    return readers.pair_table(spark, at, "b", "a").select("ia", "ib")


@query("SELECT CAST(id AS VARCHAR) AS gene, CAST(idx AS INT) AS \"Partition\", CASE WHEN og = 3 THEN 1 ELSE 0 END AS \"Nucleus\", 0 AS \"Plastid\" FROM genes")
def scan_annotations(spark, sf):
    at = _folder(spark, "annotations")
    g = roles.genes(spark, sf).select(F.col("id").alias("gene_id"), F.col("idx").alias("Partition"), F.when(F.col("og") == 3, 1).alias("Nucleus"), "species")
    g.write.csv(at, sep="\t", header=True)
    return readers.typed_annotations(spark, at, "partitions", "gene_id", ["Nucleus", "Plastid"])


@query("SELECT CAST(id AS VARCHAR) AS gene, 'GO:' || og AS go_term, CASE WHEN species = 0 THEN 'MF' ELSE 'BP' END AS aspect FROM genes")
def scan_go_annotations(spark, sf):
    at = _folder(spark, "annotations")
    g = roles.genes(spark, sf).select(F.col("id").alias("gene_id"), F.concat(F.lit("GO:"), F.col("og").cast("string")).alias("go_term"), F.when(F.col("species") == 0, "MF").otherwise("BP").alias("aspect"))
    g.write.csv(f"{at}/all", sep="\t", header=True)
    return readers.typed_annotations(spark, readers.first_existing(spark, f"{at}/experimental", f"{at}/all"), "go", "gene_id")


@query("SELECT id AS gene, species, CASE WHEN species < 2 THEN 'experimental' ELSE 'all' END AS evidence FROM genes")
def scan_best_evidence(spark, sf):
    g = roles.genes(spark, sf).select(F.col("id").alias("gene"), "species")
    return readers.best_evidence(g.filter("species < 2").withColumn("evidence", F.lit("experimental")), g.withColumn("evidence", F.lit("all")))


@query("SELECT 'GO:' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS go_id, CASE n_regionkey % 3 WHEN 0 THEN 'BP' WHEN 1 THEN 'CC' ELSE 'MF' END AS aspect FROM nation")
def scan_ontology(spark, sf):
    at = f"{_folder(spark, 'obo')}/go.obo"
    names = F.element_at(F.array(*[F.lit(x) for x in ("biological_process", "cellular_component", "molecular_function")]), (F.col("n_regionkey") % 3 + 1).cast("int"))
    stanza = F.concat(F.lit("[Term]\nid: GO:"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0"), F.lit("\nname: "), F.col("n_name"), F.lit("\nnamespace: "), names, F.lit("\n"))
    writers.text_file(roles.table(spark, sf, "nation").select(stanza.alias("value")), at)
    return readers.ontology(spark, at)


@query("SELECT n_name, n_regionkey FROM nation")
def scan_json(spark, sf):
    at = _folder(spark, "json") + ".json"
    each = F.to_json(F.collect_list(F.struct("n_name", "n_regionkey")))  # one JSON array, as result files are
    writers.text_file(roles.table(spark, sf, "nation").agg(each.alias("value")), at)
    return readers.json_records(spark, at).select("n_name", "n_regionkey")


@query("""SELECT g.gene, p.p_brand AS og FROM (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'T' || l_partkey WHEN l_partkey % 3 = 1 THEN 'P' || l_partkey ELSE 'T' || l_partkey || '.1' END AS gene, l_partkey FROM lineitem) g JOIN part p ON p.p_partkey = g.l_partkey""")
def either_id_orthogroups(spark, sf):
    """Genes named by transcript, by protein, or by transcript with a suffix."""
    k = F.col("l_partkey").cast("string")
    gene = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("T"), k)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("P"), k)).otherwise(F.concat(F.lit("T"), k, F.lit(".1")))
    genes = roles.table(spark, sf, "lineitem").select(gene.alias("gene")).distinct()
    part = roles.table(spark, sf, "part")
    ogs = part.select(F.col("p_partkey").alias("row_no"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("transcript_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("protein_id"), F.col("p_brand").alias("og"))
    return orthologs.either_id_orthogroups(genes, ogs)


@query("SELECT species, idx, CAST(id AS VARCHAR) AS gene, round(list_sum(v), 4) AS total FROM genes")
def sink_embeddings(spark, sf):
    at = _folder(spark, "embeddings")
    writers.embeddings(roles.genes(spark, sf).select("species", "idx", F.col("id").cast("string").alias("gene"), "v"), at)
    got = readers.embeddings(spark, at)
    return got.select("species", "idx", "gene", F.round(F.aggregate(vec.as_double("v"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT CAST(id AS VARCHAR) AS gene FROM genes")
def scan_ids(spark, sf):
    at = _folder(spark, "embeddings")
    writers.embeddings(roles.genes(spark, sf).select("species", "idx", F.col("id").cast("string").alias("gene"), "v"), at)
    return readers.embeddings(spark, at).select("gene")


@query("WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT gene FROM nbrs)) SELECT any_value(n) AS n_genes, count(*) AS nnz, round(count(*) / any_value(n) / any_value(n), 9) AS density FROM edges CROSS JOIN n")
def sink_similarity(spark, sf):
    e = roles.edges(spark, sf)
    n = graph.symmetric(e).select("gene").distinct().count()
    got = writers.similarity(e.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("w").alias("value")), _folder(spark, "similarity"), n)
    return spark.createDataFrame([(got["n_genes"], got["nnz"], round(got["density"], 9))], "n_genes long, nnz long, density double")


@query("SELECT n_name AS taxid, 'plants' AS \"group\" FROM nation WHERE n_regionkey < 2")
def sink_tool_config(spark, sf):
    at, n = _folder(spark, "config"), roles.table(spark, sf, "nation").filter("n_regionkey < 2").collect()
    seeds = [r["n_name"] for r in n if r["n_regionkey"] == 0]
    writers.seed_config(spark, seeds, {r["n_name"]: seeds[0] for r in n if r["n_regionkey"] == 1}, at)
    return spark.read.csv(f"{at}/tax_group.tsv", sep="\t", header=True)


@query("SELECT '| ' || r_name || ' | ' || printf('%.2f', r_regionkey / 4) || ' |' AS value FROM region UNION ALL SELECT * FROM (VALUES ('| r_name | share |'), ('|---|---|'))")
def sink_markdown(spark, sf):
    at = f"{_folder(spark, 'markdown')}/table.md"
    writers.text_file(writers.markdown(roles.table(spark, sf, "region").select("r_name", (F.col("r_regionkey") / 4).alias("share")), 2), at)
    return spark.read.text(at)


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def sink_skip_stored(spark, sf):
    n = roles.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return writers.missing(n, n.filter("n_regionkey = 2"), ["n_nationkey"]).select("n_nationkey")


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def sink_incremental(spark, sf):
    """Totals by supplier in three runs: one of even suppliers, one killed before its commit, one of all, which writes only what is missing."""
    root = _folder(spark, "incremental")
    totals = roles.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
    manifest.materialise(totals.filter("l_suppkey % 2 = 0"), root, "l_suppkey")
    totals.write.parquet(f"{root}/data/killed")
    manifest.materialise(totals, root, "l_suppkey")
    return manifest.committed(spark, root, totals.schema, "l_suppkey")


# ---- rules without a query of their own ---------------------------------------------------------


@query("""SELECT n_nationkey, substr(n_name, 1, 3) AS short, least(n_name, c) || '_' || greatest(n_name, c) AS pair, regexp_replace(regexp_replace(regexp_replace(t, '\\|.*$', ''), '\\.p$', ''), '\\.\\d+$', '') AS node, round(1 / (1 + exp(-n_regionkey)), 9) AS sigmoid, isnan(x) AS missing, n_name AS decoded, 'run_' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '_csls' ELSE '' END AS folder
    FROM (SELECT *, chr(CAST(65 + n_nationkey % 26 AS INT)) || 'Z' AS c, n_name || '.' || n_nationkey || '.p|x' AS t, CASE WHEN n_nationkey % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE n_nationkey END AS x FROM nation)""")
def scalar_rules(spark, sf):
    n = roles.table(spark, sf, "nation").withColumn("c", F.concat(F.char(65 + F.col("n_nationkey") % 26), F.lit("Z")))
    t = F.concat(F.col("n_name"), F.lit("."), F.col("n_nationkey").cast("string"), F.lit(".p|x"))
    x = F.when(F.col("n_nationkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("n_nationkey").cast("double"))
    flags = F.concat_ws("_", F.lit("run"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "csls"))
    return n.select("n_nationkey", ids.short_name(F.col("n_name")).alias("short"), ids.pair_name(F.col("n_name"), F.col("c")).alias("pair"), ids.node_key_unversioned(t).alias("node"), F.round(1 / (1 + F.exp(-F.col("n_regionkey"))), 9).alias("sigmoid"), F.isnan(x).alias("missing"), F.decode(F.encode("n_name", "UTF-8"), "UTF-8").alias("decoded"), flags.alias("folder"))


@query("""SELECT a.idx AS id, round(sqrt(list_dot_product(a.v, a.v)) / greatest(sqrt(list_dot_product(a.v, a.v)), 1e-9), 6) AS clamped, CAST(len(a.v) + len(coalesce(b.v, a.v)) AS INT) AS dim, round(list_sum(a.v) + coalesce(list_sum(b.v), 0), 5) AS total
    FROM genes2 a LEFT JOIN (SELECT idx, v FROM genes2 WHERE species = 1 AND og < 5) b ON b.idx = a.idx WHERE a.species = 0""")
def vector_rules(spark, sf):
    """Clamped norms; raw concatenation with zeros for genes that the second table lacks."""
    g = roles.two_species(spark, sf).select("species", "og", F.col("idx").alias("id"), "v")
    a = g.filter("species = 0")
    b = a.select("id").join(g.filter("species = 1 and og < 5").select("id", "v"), "id", "left").select("id", vec.zero_filled(vec.as_double("v"), 64).alias("v"))
    both = vector.concatenated(a.select("id", "v"), b, normalise=False)
    one = vector.normalised(a.select("id", "v"), "clamped").select("id", vec.norm(F.col("v")).alias("clamped"))
    out = both.join(one, "id").select("id", "clamped", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
    return r6(out, "clamped")


@query("SELECT idx AS ia, id AS ib FROM genes2 WHERE idx < 100 AND id < 150")
def pairs_in_bounds(spark, sf):
    g = roles.two_species(spark, sf).select(F.col("idx").alias("ia"), F.col("id").alias("ib"))
    return orthologs.enough_anchors(orthologs.in_bounds(g, 100, 150))
