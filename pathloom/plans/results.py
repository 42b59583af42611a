"""Queries over what is made of results, and over hand-made changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results
from .adapters import Tables
from .registry import query


@query("entity_types", "SELECT unnest(['nation', 'participants', 'cspecies', 'reactions']) AS t, unnest(['species', 'reaction_species', 'compartmentalized_species', 'reactions']) AS entity")
def _(t: Tables) -> DataFrame:
    columns = {"nation": ["s_id", "c_id"], "participants": t.participants().columns, "cspecies": t.cspecies().columns, "reactions": t.reactions().columns}
    return t.spark.createDataFrame([(n, results.entity_type(c)) for n, c in columns.items()], "t string, entity string")


@query("downcast_floats", "SELECT p_partkey, (p_retailprice / 3)::FLOAT::DOUBLE AS price FROM part")
def _(t: Tables) -> DataFrame:
    return results.downcast(t.part.select("p_partkey", (F.col("p_retailprice") / 3).alias("price"))).withColumn("price", F.col("price").cast("double"))


@query("attributes_dropped", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables) -> DataFrame:
    return results.without_attributes(t.nation.select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey"])


@query("wrapped_text", "SELECT p_partkey, 'aa bbb' || chr(10) || 'cccc ' || (p_partkey % 10) || chr(10) || 'ddddddddd' || chr(10) || 'e' AS text FROM part")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" aa  bbb cccc "), (F.col("p_partkey") % 10).cast("string"), F.lit(" ddddddddd e"))
    return t.part.select("p_partkey", results.wrapped(text, 7).alias("text"))


@query("melted_results", "SELECT n_nationkey AS name, unnest(['a', 'a', 'b']) AS attribute, unnest(['observed', 'quantile', 'observed']) AS metric, unnest([n_regionkey + 0.5, 0.25, n_regionkey * 2.0])::DOUBLE AS value FROM nation")
def _(t: Tables) -> DataFrame:
    r = F.col("n_regionkey")
    return results.melted(t.nation.select(F.col("n_nationkey").alias("name"), (r + 0.5).cast("double").alias("a::observed"), F.lit(0.25).cast("double").alias("a::quantile"), (r * 2.0).cast("double").alias("b::observed")), "name")


@query("cspecies_identifiers", "SELECT sc_id, identifier FROM identifiers JOIN (SELECT DISTINCT s_id, sc_id FROM cspecies) USING (s_id) WHERE ontology = 'brand'", ["identifiers", "cspecies"])
def _(t: Tables) -> DataFrame:
    known = t.identifiers().where("ontology = 'brand'").join(t.cspecies().select("s_id").distinct(), "s_id", "left_semi")
    return results.cspecies_identifiers(known, t.cspecies()).select("sc_id", "identifier")


@query("sets_of_species", "SELECT DISTINCT 'g' || (p_size % 7) AS geneset, s_id FROM part JOIN identifiers ON identifier = p_brand AND ontology = 'brand' WHERE p_size < 3", ["identifiers"])
def _(t: Tables) -> DataFrame:
    sets = t.part.where("p_size < 3").select(F.concat(F.lit("g"), (F.col("p_size") % 7).cast("string")).alias("geneset"), F.col("p_brand").alias("member"))
    return results.sets_of_species(sets, t.identifiers(), "brand")


@query(
    "path_attributes",
    """SELECT l_orderkey AS path, count(*) AS n_steps, round(sum(l_quantity), 6) AS path_weight, arg_max(l_returnflag, l_linenumber::BIGINT * 1000000000000 + l_partkey::BIGINT * 100000 + l_suppkey) AS net_polarity FROM lineitem GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    step = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey").cast("long") * 100000 + F.col("l_suppkey")
    steps = t.lineitem.select(F.col("l_orderkey").alias("path"), step.alias("step"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("net_polarity"))
    return results.path_attributes(steps).withColumn("path_weight", F.round("path_weight", 6))


@query("labelled_paths", "SELECT 'p' || (o_orderkey % 9) AS path, o_orderkey AS step, 'R' || o_orderkey AS r_id, o_orderpriority AS r_name, 'f' AS formula, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_orderkey END AS url FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    r_id = F.concat(F.lit("R"), k.cast("string"))
    nodes = t.orders.select(F.concat(F.lit("p"), (k % 9).cast("string")).alias("path"), k.alias("step"), r_id.alias("node"))
    nodes = nodes.unionByName(t.part.select(F.lit("p0").alias("path"), F.lit(0).cast("long").alias("step"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("node")))
    urls = t.orders.where("o_orderkey % 2 = 0").select(r_id.alias("r_id"), F.concat(F.lit("u"), k.cast("string")).alias("url"))
    return results.labelled_paths(nodes, t.reactions().withColumn("formula", F.lit("f")), urls)


@query("connected_neighbourhood", "SELECT src, dst FROM trade WHERE (src % 3 <> 0 OR src = 0) AND (dst % 3 <> 0 OR dst = 0)", ["trade"])
def _(t: Tables) -> DataFrame:
    e = t.trade().select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    v = t.nation.select(F.col("n_nationkey").cast("string").alias("name"), (F.col("n_nationkey") % 3).alias("weight"))
    return results.connected_neighbourhood(v, e, "0")[1].select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


_COVER_SOURCES = (
    "v AS (SELECT sc_id FROM cspecies WHERE s_id % 50 = 0), l0 AS MATERIALIZED (SELECT DISTINCT pathway_id, r_id FROM reactions WHERE r_id IN (SELECT r_id FROM participants JOIN v USING (sc_id)))"
    + "".join(f", t{k} AS MATERIALIZED (SELECT pathway_id, count(*) AS n FROM l{k} GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, pathway_id LIMIT 1), l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} WHERE r_id NOT IN (SELECT r_id FROM l{k} JOIN t{k} USING (pathway_id)))" for k in range(6))
    + " "
    + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, pathway_id, n AS n_covered FROM t{k}" for k in range(6))
)


@query("minimal_sources", _COVER_SOURCES, ["cspecies", "participants", "reactions"])
def _(t: Tables) -> DataFrame:
    vertices = t.cspecies().where("s_id % 50 = 0").select(F.col("sc_id").alias("name"))
    return results.minimal_sources(vertices, t.participants(), t.reactions())


@query("results_by_modality", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'rna' ELSE 'protein' END AS modality FROM part")
def _(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey")
    parts = results.by_modality(rows, {"rna": t.part.where("p_size % 2 = 0"), "protein": t.part.where("p_size % 2 = 1")}, "p_partkey")
    return parts["rna"].withColumn("modality", F.lit("rna")).unionByName(parts["protein"].withColumn("modality", F.lit("protein")))


@query(
    "vertex_summaries",
    "SELECT n_nationkey AS name, coalesce(c, 0) AS customers_n, coalesce(s, 0) AS suppliers_n FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_nationkey < 20 GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON b.k = n_nationkey",
)
def _(t: Tables) -> DataFrame:
    c = t.customer.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return results.vertex_summaries(t.nation.select(F.col("n_nationkey").alias("name")), {"customers": c, "suppliers": s})


@query("merge_report", "SELECT 'b' || (p_partkey % 50) AS new_id, count(*) AS n_merged, list_sort(list(DISTINCT p_brand))[1:3] AS names FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    names = t.part.select(F.lit("m").alias("model"), "p_partkey", "p_brand")
    lookup = names.select("model", "p_partkey", F.concat(F.lit("b"), (F.col("p_partkey") % 50).cast("string")).alias("new_id"))
    return results.merge_report(lookup, names, "p_partkey", "p_brand")


@query("stub_compartment", "SELECT 'C00000000' AS c_id, 'cellular_component' AS c_name, 'GO:0005575' AS identifier")
def _(t: Tables) -> DataFrame:
    return results.stub_compartment(t.spark).select("c_id", "c_name", F.col("identifiers")[0]["identifier"].alias("identifier"))


@query(
    "curated_model",
    "k AS (SELECT * FROM reactions WHERE pathway_id <> 'BUILDING') SELECT 'reactions' AS entity, count(*) + 1 AS n FROM k UNION ALL SELECT 'reaction_species', count(*) + 1 FROM participants JOIN k USING (r_id)",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    keys = {"reactions": ("r_id", {}), "reaction_species": ("rsc_id", {"r_id": "reactions"})}
    r, p = t.reactions(), t.participants()
    new_r = t.spark.createDataFrame([("RNEW", "new", False, "own")], "r_id string, r_name string, r_isreversible boolean, pathway_id string")
    new_p = t.spark.createDataFrame([("X", "RNEW", "P_1_0")], "rsc_id string, r_id string, sc_id string")
    out = results.curated({"reactions": r, "reaction_species": p}, keys, {"reactions": r.where("pathway_id = 'BUILDING'")}, {"reactions": new_r, "reaction_species": new_p})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in out.items()]
    return parts[0].unionByName(parts[1])
