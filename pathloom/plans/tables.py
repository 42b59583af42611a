"""Queries over the steps between tables: merges, keys, names, summaries of whole models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import scalars as S
from ..operators import attributes, consensus, context, edgelist, identifiers, ingest, integrity, matching, propagation, wiring
from .adapters import Tables
from .registry import query

# --- matching --------------------------------------------------------------------


@query(
    "edges_to_cspecies",
    "SELECT p.p_partkey AS s_id_upstream, p.p_partkey + 1 AS s_id_downstream, a.sc_id AS sc_id_upstream, b.sc_id AS sc_id_downstream FROM part p JOIN cspecies a ON a.s_id = p.p_partkey JOIN cspecies b ON b.s_id = p.p_partkey + 1",
    ["cspecies"],
)
def _(t: Tables) -> DataFrame:
    return matching.edgelist_to_cspecies(t.part.select(F.col("p_partkey").alias("s_id_upstream"), (F.col("p_partkey") + 1).alias("s_id_downstream")), t.cspecies())


def _modalities(t: Tables) -> dict[str, DataFrame]:
    a = t.part.where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"))
    b = t.part.where("p_size > 20").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 2).alias("x"))
    return {"rna": a, "protein": b}


@query("bound_contiguous", "SELECT p_partkey AS k, p_size AS x FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, p_size * 2 FROM part WHERE p_size > 20")
def _(t: Tables) -> DataFrame:
    return matching.bind_tables(_modalities(t), "k")


@query("bound_staggered", "SELECT p_partkey AS k, CASE WHEN p_size < 30 THEN p_size END AS x_rna, CASE WHEN p_size > 20 THEN p_size * 2 END AS x_protein FROM part")
def _(t: Tables) -> DataFrame:
    return matching.bind_tables(_modalities(t), "k", "stagger")


# --- edge lists ------------------------------------------------------------------


@query("edges_merged", "SELECT a.src, a.dst, a.n AS n_x, b.n AS n_y, b.weight AS other FROM trade a JOIN trade b ON a.src = b.dst AND a.dst = b.src", ["trade"])
def _(t: Tables) -> DataFrame:
    e = t.trade()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.col("weight").alias("other"))
    return edgelist.merge(e.select("src", "dst", "n"), back, relationship="1:0")


@query("columns_overwritten", "SELECT n_nationkey, r_name AS n_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables) -> DataFrame:
    left = t.nation.select("n_nationkey", "n_regionkey", "n_name")
    return edgelist.overwrite_merge(left, t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name")), ["n_regionkey"]).select("n_nationkey", "n_name")


@query("edge_flags", "SELECT (SELECT count(*) > 0 FROM (SELECT src, dst FROM supplies GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicated, (SELECT count(*) > 0 FROM trade a JOIN trade b ON a.src = b.dst AND a.dst = b.src) AS reciprocal", ["supplies", "trade"])
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(edgelist.has_duplicates(t.supplies()), edgelist.has_reciprocal(t.trade()))], "duplicated boolean, reciprocal boolean")


@query("join_cardinalities", "SELECT unnest(['1:1', '1:m', 'm:1', '1:0', '0:1']) AS relationship, unnest([false, false, true, false, false]) AS holds")
def _(t: Tables) -> DataFrame:
    def holds(relationship: str) -> bool:
        try:
            edgelist.check_cardinality(t.nation.select(F.col("n_regionkey").alias("k")), t.region.select(F.col("r_regionkey").alias("k")), ["k"], relationship)
        except ValueError:
            return False
        return True

    return t.spark.createDataFrame([(r, holds(r)) for r in ("1:1", "1:m", "m:1", "1:0", "0:1")], "relationship string, holds boolean")


@query("induced_edges", "SELECT src, dst, n FROM trade WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)", ["trade"])
def _(t: Tables) -> DataFrame:
    return edgelist.induced(t.trade(), t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("name"))).select("src", "dst", "n")


@query("connected_vertices", "SELECT DISTINCT p_partkey AS name, p_size % 2 = 0 AS kept_anyway FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) OR p_size % 2 = 0")
def _(t: Tables) -> DataFrame:
    vertices = t.part.select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, "reaction").otherwise("species").alias("node_type"))
    edges = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))
    return edgelist.without_isolated(vertices, edges, ["species"]).select("name", (F.col("node_type") == "reaction").alias("kept_anyway"))


@query("pairs_listed_once", "SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def _(t: Tables) -> DataFrame:
    one = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src <> dst")
    both = one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("score", F.lit(1))
    return ingest.reciprocal_only_once(both, "score").select("src", "dst")


# --- the network -----------------------------------------------------------------


@query(
    "reversed_network",
    "SELECT dst AS src, src AS dst, n::DOUBLE AS weight, weight AS weight_upstream, -2.0::DOUBLE AS stoichiometry_upstream, 1.0::DOUBLE AS stoichiometry_downstream, CASE WHEN n % 2 = 0 THEN 'reverse' ELSE 'undirected' END AS direction FROM trade",
    ["trade"],
)
def _(t: Tables) -> DataFrame:
    e = t.trade().select("src", "dst", "weight", F.col("n").cast("double").alias("weight_upstream"), F.lit(-1.0).alias("stoichiometry_upstream"), F.lit(2.0).alias("stoichiometry_downstream"), F.when(F.col("n") % 2 == 0, "forward").otherwise("undirected").alias("direction"))
    return wiring.reverse(e)


_BIPARTITE = "b AS (SELECT CASE WHEN stoichiometry <= 0 THEN sc_id ELSE r_id END AS src, CASE WHEN stoichiometry <= 0 THEN r_id ELSE sc_id END AS dst, stoichiometry, sbo_term, r_id, sc_id FROM participants)"


@query("network_edges_once", _BIPARTITE + " SELECT src, dst, min(r_id) AS r_id FROM b GROUP BY 1, 2", ["participants"])
def _(t: Tables) -> DataFrame:
    e = wiring.bipartite(t.participants()).select("src", "dst", "r_id", F.lit("forward").alias("direction"), F.col("sbo_term").alias("sbo_term_upstream"), F.lit("").alias("sbo_term_downstream"))
    return wiring.deduplicate(e).select("src", "dst", "r_id")


@query(
    "augmented_edges",
    _BIPARTITE + ", f AS (SELECT sc_id, count(*) AS sc_degree FROM participants GROUP BY 1) SELECT src, dst, r_id, sc_id, sc_degree, r_isreversible FROM b JOIN f USING (sc_id) JOIN reactions USING (r_id)",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    features = t.participants().groupBy("sc_id").agg(F.count(F.lit(1)).alias("sc_degree"))
    return attributes.augment_edges(wiring.bipartite(t.participants()).select("src", "dst", "r_id"), features, t.reactions())


def _typed(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = t.nation.select(F.col("n_nationkey").alias("name"), F.when(F.col("n_regionkey") == 0, "drug").when(F.col("n_regionkey") == 1, None).otherwise("protein").alias("species_type"), F.when(F.col("n_regionkey") == 4, "reaction").otherwise("species").alias("node_type"))
    return v, t.trade().select("src", "dst", "n")


for _negate in (False, True):
    _hit = "coalesce(n_regionkey = 0, false)"
    _keep = f"(n_regionkey = 4 OR {'NOT ' if _negate else ''}{_hit})"

    @query(
        "species_type_" + ("removed" if _negate else "kept"),
        f"k AS (SELECT n_nationkey AS name FROM nation WHERE {_keep}), e AS (SELECT src, dst FROM trade WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)) SELECT 'edge' AS kind, src AS a, dst AS b FROM e UNION ALL SELECT 'vertex', name, name FROM k WHERE name IN (SELECT src FROM e UNION SELECT dst FROM e)",
        ["trade"],
    )
    def _(t: Tables, negate: bool = _negate) -> DataFrame:
        v, e = attributes.of_species_type(*_typed(t), ["drug"], negate)
        return e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(v.select(F.lit("vertex").alias("kind"), F.col("name").alias("a"), F.col("name").alias("b")))


@query("species_participations", "SELECT rsc_id, r_id, sc_id, r_name AS formula FROM participants JOIN reactions USING (r_id) WHERE s_id % 7 = 0", ["participants", "reactions"])
def _(t: Tables) -> DataFrame:
    formulas = t.reactions().select("r_id", F.col("r_name").alias("formula"))
    return attributes.species_status(t.participants(), formulas, t.cspecies().where("s_id % 7 = 0")).select("rsc_id", "r_id", "sc_id", "formula")


@query(
    "graph_summary",
    "WITH RECURSIVE v AS (SELECT s_suppkey AS a, s_suppkey % 7 + 1000000 + 100 * (s_nationkey % 3) AS b FROM supplier), u AS (SELECT a, b FROM v UNION SELECT b, a FROM v), r AS (SELECT a AS name, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.name = u.a),\n"
    "c AS (SELECT name, min(root) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1), d AS (SELECT a, count(*) AS degree FROM u GROUP BY 1)\n"
    "SELECT (SELECT count(*) FROM c) AS n_vertices, (SELECT count(*) FROM v) AS n_edges, (SELECT count(*) FROM s) AS n_components, (SELECT max(n) FROM s) AS largest_component, (SELECT a FROM d ORDER BY degree DESC, a LIMIT 1) AS top_vertex, (SELECT max(degree) FROM d) AS top_degree",
)
def _(t: Tables) -> DataFrame:
    e = t.supplier.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") % 7 + 1000000 + 100 * (F.col("s_nationkey") % 3)).alias("dst"))
    v = e.select(F.col("src").alias("name")).union(e.select(F.col("dst").alias("name"))).distinct()
    s = attributes.graph_summary(v, e, 1)
    row = (s["n_vertices"], s["n_edges"], s["n_components"], s["largest_component"], s["top_degree"][0]["name"], s["top_degree"][0]["degree"])
    return t.spark.createDataFrame([row], "n_vertices long, n_edges long, n_components long, largest_component long, top_vertex long, top_degree long")


# --- merging models --------------------------------------------------------------


@query("keys_updated", "SELECT l_orderkey, 'b' || (l_partkey % 5) AS l_partkey FROM lineitem")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.lit("m").alias("model"), "l_orderkey", "l_partkey")
    lookup = rows.select("model", "l_partkey").distinct().withColumn("new_id", F.concat(F.lit("b"), (F.col("l_partkey") % 5).cast("string")))
    return consensus.update_keys(rows, lookup, "l_partkey").select("l_orderkey", "l_partkey")


@query("cluster_identifiers", "SELECT p_size AS cluster, list_sort(list(DISTINCT identifier)) AS identifiers FROM identifiers JOIN part ON p_partkey = s_id WHERE ontology <> 'size' GROUP BY 1", ["identifiers"])
def _(t: Tables) -> DataFrame:
    rows = t.species().join(t.part.select(F.col("p_partkey").alias("s_id"), "p_size"), "s_id")
    out = consensus.merged_identifiers(rows.withColumn("identifiers", F.filter("identifiers", lambda x: x["ontology"] != "size")), "p_size")
    return out.select(F.col("p_size").alias("cluster"), F.array_sort(F.transform("identifiers", lambda x: x["identifier"])).alias("identifiers"))


@query(
    "entity_data_merged",
    """WITH x AS (SELECT 'b' || (p_partkey % 50) AS new_id, p_partkey::VARCHAR AS o, p_size, p_brand, p_size > 25 AS big FROM part)
    SELECT new_id, first(p_size ORDER BY o) AS p_size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS p_brand, first(big ORDER BY o) AS big FROM x GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    data = t.part.select(F.lit("m").alias("model"), F.col("p_partkey").alias("k"), F.col("p_partkey").alias("row"), "p_size", "p_brand", (F.col("p_size") > 25).alias("big"))
    lookup = data.select("model", "k", F.concat(F.lit("b"), (F.col("k") % 50).cast("string")).alias("new_id"))
    return consensus.merge_entity_data(data, lookup, "k")


@query("unconnected_models", "SELECT ['a', 'b'] AS models, ['x', 'y'] AS ontologies UNION ALL SELECT ['c'], ['z']")
def _(t: Tables) -> DataFrame:
    rows = t.region.select(F.when(F.col("r_regionkey") < 2, "a").when(F.col("r_regionkey") < 4, "b").otherwise("c").alias("model"), F.when(F.col("r_regionkey") < 3, "x").when(F.col("r_regionkey") < 4, "y").otherwise("z").alias("ontology"))
    return consensus.unconnected_models(rows.select("model", F.array(F.struct("ontology")).alias("identifiers")))


def _model(t: Tables) -> consensus.Model:
    def ids(ontology: str, column: str):  # noqa: ANN202
        return F.array(F.struct(F.lit(ontology).alias("ontology"), F.col(column).cast("string").alias("identifier"), F.lit(None).cast("string").alias("url"), F.lit("BQB_IS").alias("bqb")))

    compartments = t.region.select(F.col("r_regionkey").cast("string").alias("c_id"), F.col("r_name").alias("c_name"), ids("go", "r_name").alias("identifiers"))
    species = t.part.select(F.col("p_partkey").cast("string").alias("s_id"), F.col("p_name").alias("s_name"), ids("brand", "p_brand").alias("identifiers"))
    cspecies = t.cspecies().select("sc_id", F.col("sc_id").alias("sc_name"), F.col("s_id").cast("string").alias("s_id"), F.col("c_id").cast("string").alias("c_id"))
    reactions = t.reactions().select("r_id", "r_name", "r_isreversible")
    return consensus.Model(compartments, species, cspecies, reactions, t.participants().select("r_id", "sc_id", "stoichiometry", "sbo_term"))


def _sizes(m: consensus.Model) -> DataFrame:
    parts = [getattr(m, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("entity"), "n") for n in ("compartments", "species", "cspecies", "reactions", "participants")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "merged_models",
    """x AS (SELECT DISTINCT r_id, p_brand || '_' || c_id AS sc, stoichiometry AS s, sbo_term AS o FROM participants JOIN part ON p_partkey = s_id),
    k AS (SELECT r_id, list_sort(list(sc || '_' || s || '_' || o)) AS key, count(*) AS n FROM x GROUP BY 1)
    SELECT 'compartments' AS entity, count(*) AS n FROM region UNION ALL SELECT 'species', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'cspecies', count(DISTINCT sc) FROM x
    UNION ALL SELECT 'reactions', count(DISTINCT key) FROM k UNION ALL SELECT 'participants', sum(n)::BIGINT FROM (SELECT DISTINCT key, n FROM k)""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    return _sizes(consensus.merge_models({"one": _model(t), "two": _model(t)}))


@query(
    "uncompartmentalised",
    """x AS (SELECT r_id, s_id, sbo_term AS o, sum(stoichiometry) AS s FROM participants GROUP BY ALL), z AS (SELECT r_id, s_id FROM x WHERE s <> 0 GROUP BY 1, 2 HAVING sum(s) = 0),
    y AS (SELECT * FROM x WHERE (r_id, s_id) NOT IN (SELECT (r_id, s_id) FROM z)), k AS (SELECT r_id, list_sort(list(s_id || '_' || s || '_' || o)) AS key, count(*) AS n FROM y GROUP BY 1)
    SELECT 'compartments' AS entity, 1::BIGINT AS n UNION ALL SELECT 'species', count(*) FROM part UNION ALL SELECT 'cspecies', count(*) FROM part
    UNION ALL SELECT 'reactions', count(DISTINCT key) FROM k UNION ALL SELECT 'participants', sum(n)::BIGINT FROM (SELECT DISTINCT key, n FROM k)""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    return _sizes(consensus.uncompartmentalise(_model(t)))


# --- names, cofactors, transport -------------------------------------------------


@query("cspecies_named", "SELECT DISTINCT sc_id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' [' || r_name || ']' ELSE 'own' END AS sc_name FROM cspecies JOIN part ON p_partkey = s_id JOIN region ON r_regionkey = c_id", ["cspecies"])
def _(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("s_id"), F.col("p_name").alias("s_name"))
    forms = t.cspecies().join(names, "s_id").select("sc_id", "s_id", "c_id", F.when(F.col("s_id") % 2 == 0, F.col("s_name")).otherwise("own").alias("sc_name"))
    return integrity.name_cspecies(forms, names, t.region.select(F.col("r_regionkey").alias("c_id"), F.col("r_name").alias("c_name"))).select("sc_id", "sc_name")


_CHEBI = ", ".join(f"({number}, '{name}')" for name, numbers in V.COFACTORS.items() for number in numbers)


@query("cofactors_found", f"WITH c(number, cofactor) AS (VALUES {_CHEBI}) SELECT DISTINCT p_partkey AS s_id, cofactor FROM part JOIN c ON number = 15300 + p_partkey % 200 WHERE p_size % 5 <> 0")
def _(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("s_id"), F.lit("chebi").alias("ontology"), (15300 + F.col("p_partkey") % 200).cast("string").alias("identifier"), F.when(F.col("p_size") % 5 == 0, "BQB_HAS_PART").otherwise("BQB_IS").alias("bqb"))
    return integrity.find_cofactors(rows)


_PAIRS = "p AS (SELECT a.s_id, a.sc_id AS f, b.sc_id AS g FROM cspecies a JOIN cspecies b ON a.s_id = b.s_id AND a.c_id <> 2 AND b.c_id = 2)"


@query(
    "transport_reactions",
    _PAIRS + ", r AS (SELECT *, 'R' || lpad((500 + row_number() OVER (ORDER BY f, g))::VARCHAR, 8, '0') AS r_id FROM p) SELECT r_id, p_name || ' transport' AS r_name, unnest([f, g]) AS sc_id, unnest([-1.0, 1.0])::DOUBLE AS stoichiometry, unnest(['SBO:0000010', 'SBO:0000011']) AS sbo_term FROM r JOIN part ON p_partkey = s_id",
    ["cspecies"],
)
def _(t: Tables) -> DataFrame:
    pairs = integrity.exchange_gaps(t.cspecies(), 2)[1]
    reactions, participants = integrity.exchange_reactions(pairs, t.species(), 500)
    return reactions.drop("r_isreversible").join(participants, "r_id")


@query(
    "ids_continued",
    "SELECT p_partkey, 'S' || lpad((row_number() OVER (ORDER BY p_name, p_partkey) + (SELECT max(p_partkey) FROM part))::VARCHAR, 8, '0') AS s_id FROM part",
)
def _(t: Tables) -> DataFrame:
    return integrity.next_ids(t.part.select("p_partkey", "p_name"), t.part.agg(F.max("p_partkey").alias("m")), "S", ["p_name", "p_partkey"], "s_id").select("p_partkey", "s_id")


# --- identifiers and attributes --------------------------------------------------


@query("ids_filtered", "SELECT s_id, ontology, identifier FROM identifiers WHERE ontology IN ('brand', 'size') AND bqb = 'BQB_IS' AND identifier IN ('Brand#11', 'Brand#55', '7')", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return identifiers.filter_ids(t.identifiers(), ["Brand#11", "Brand#55", "7"], ["brand", "size"], ["BQB_IS"]).select("s_id", "ontology", "identifier")


@query("source_arrays", "SELECT s_id, list_sort(list(DISTINCT pathway_id)) AS sources FROM participants JOIN reactions USING (r_id) GROUP BY 1", ["participants", "reactions"])
def _(t: Tables) -> DataFrame:
    rows = t.participants().join(t.reactions(), "r_id")
    return identifiers.sources_of(rows, "s_id", ["pathway_id"]).select("s_id", F.transform("sources", lambda x: x["pathway_id"]).alias("sources"))


@query("priority_sources", "SELECT r_id, pathway_id FROM reactions WHERE pathway_id IN ('BUILDING', 'MACHINERY')", ["reactions"])
def _(t: Tables) -> DataFrame:
    return identifiers.priority_sources(t.reactions(), ["BUILDING", "MACHINERY"]).select("r_id", "pathway_id")


@query("reactome_species", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HSA' WHEN 1 THEN 'MMU' END AS code FROM part")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, "R-HSA-1").when(F.col("p_size") % 3 == 1, "R-MMU-22").otherwise("other")
    return t.part.select("p_partkey", identifiers.reactome_species(text).alias("code"))


@query("digits_prefixed", "SELECT p_partkey, 'P' || p_size AS a, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE p_size::VARCHAR END AS b FROM part")
def _(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.col("p_size").cast("string").alias("a"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("b"))
    return identifiers.pathological_names(identifiers.pathological_names(df, "a", "P"), "b", "P")


@query("stacked_mappings", "SELECT p_partkey AS s_id, 'brand' AS ontology, p_brand AS identifier FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part")
def _(t: Tables) -> DataFrame:
    return identifiers.stack_mappings({"brand": t.part.select(F.col("p_partkey").alias("s_id"), "p_brand"), "size": t.part.select(F.col("p_partkey").alias("s_id"), "p_size")}, "s_id")


@query("binary_attributes", "SELECT p_partkey, (p_size > 25)::INTEGER AS big, p_size % 2 AS odd FROM part")
def _(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", (F.col("p_size") > 25).alias("big"), (F.col("p_size") % 2).alias("odd"), "p_size", "p_brand")
    return context.binary_columns(df, "p_partkey")


@query("attributes_by_pattern", "SELECT n_nationkey, r_name, r_regionkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables) -> DataFrame:
    left = t.nation.select("n_nationkey", F.col("n_regionkey").alias("k"))
    right = t.region.select(F.col("r_regionkey").alias("k"), "r_name", F.lit(1).alias("other"))
    return attributes.attach_by_pattern(left, right, "k", "re:^r_")


@query("identical_columns", "SELECT 'a,c' AS columns UNION ALL SELECT 'b'")
def _(t: Tables) -> DataFrame:
    df = t.part.select(F.col("p_size").alias("a"), (F.col("p_size") + 1).alias("b"), F.col("p_size").alias("c"))
    return t.spark.createDataFrame([(",".join(g),) for g in attributes.identical_columns(df, ["a", "b", "c"])], "columns string")


@query("samples_allocated", "SELECT unnest(['a', 'b', 'c']) AS attribute, unnest([34, 33, 33]) AS n")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(propagation.allocate(100, ["a", "b", "c"]).items()), "attribute string, n int")


@query(
    "merged_runs",
    "WITH r AS (SELECT n_nationkey AS name, n_regionkey + 1.0::DOUBLE AS o, 0.5 + k / 10.0 AS q, k FROM nation, (SELECT unnest([0, 1]) AS k)) SELECT 'x' AS attribute, name, avg(o) AS observed, round(avg(q), 9) AS quantile, round(log2(avg(o) / (avg(o / power(2.0, 1.0 + k) - 1e-10) + 1e-10)), 6) AS log2_enrichment FROM r GROUP BY 2",
)
def _(t: Tables) -> DataFrame:
    runs = [t.nation.select(F.lit("x").alias("attribute"), F.col("n_nationkey").alias("name"), (F.col("n_regionkey") + 1.0).alias("observed"), F.lit(0.5 + k / 10.0).alias("quantile"), F.lit(1.0 + k).alias("log2_enrichment")) for k in (0, 1)]
    return propagation.merge_runs(runs).withColumn("log2_enrichment", F.round("log2_enrichment", 6)).withColumn("quantile", F.round("quantile", 9))


# --- source-specific steps -------------------------------------------------------


@query("consensus_repaired", "SELECT p_partkey, p_size % 2 = 0 AND NOT (p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0) AS consensus_stimulation, p_size % 3 = 0 AND NOT (p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0) AS consensus_inhibition FROM part")
def _(t: Tables) -> DataFrame:
    s = F.col("p_size")
    df = t.part.select("p_partkey", (s % 2 == 0).alias("consensus_stimulation"), (s % 3 == 0).alias("consensus_inhibition"), (s % 5 == 0).alias("is_stimulation"), F.lit(False).alias("is_inhibition"))
    return ingest.repaired_consensus(df).select("p_partkey", "consensus_stimulation", "consensus_inhibition")


@query("listed_identifiers", "SELECT p_partkey AS k, 'uniprot' AS ontology, 'U' || p_size AS identifier FROM part UNION ALL SELECT p_partkey, 'go', 'G' || p_partkey FROM part")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("UniProt:U"), F.col("p_size").cast("string"), F.lit(";GO:G"), F.col("p_partkey").cast("string"), F.lit(";Other:x"))
    return ingest.listed_identifiers(t.part.select(F.col("p_partkey").alias("k"), text.alias("ids")), "k", "ids", {"UniProt": "uniprot"}, ["uniprot", "go"])


@query("citations", "SELECT p_brand, list_sort(list(DISTINCT r)) AS pubmed FROM (SELECT p_brand, unnest([(1000 + p_size)::VARCHAR, (2000 + p_size % 3)::VARCHAR]) AS r FROM part) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("a:"), (1000 + F.col("p_size")).cast("string"), F.lit(";b:"), (2000 + F.col("p_size") % 3).cast("string"), F.lit(";none"))
    return ingest.citations(t.part.select("p_brand", text.alias("references")), ["p_brand"]).select("p_brand", F.transform("identifiers", lambda x: x["identifier"]).alias("pubmed"))


@query("aliased_species", "SELECT DISTINCT 's' || l_suppkey AS s_name, CASE WHEN l_suppkey % 3 > 0 THEN ['e' || l_suppkey] ELSE [] END AS ids FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, []::VARCHAR[] FROM lineitem")
def _(t: Tables) -> DataFrame:
    aliases = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("protein"), F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("alias"), F.when(F.col("s_suppkey") % 3 > 0, "Known").otherwise("Other").alias("source"))
    pairs = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return ingest.species_of_aliases(pairs, aliases, {"Known": ("ensembl_protein", "BQB_IS")}).select("s_name", F.transform("identifiers", lambda x: x["identifier"]).alias("ids"))


@query("trailing_genes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') END AS gene FROM part")
def _(t: Tables) -> DataFrame:
    gene = F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))
    return t.part.select("p_partkey", ingest.trailing_gene(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("KO_"), gene)).otherwise(F.concat(gene, F.lit("_x")))).alias("gene"))


# --- scalars ---------------------------------------------------------------------


@query(
    "text_rules",
    """SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS found, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE '%3' THEN 'three' END AS rule,
    upper(p_type[1]) || substr(p_type, 2) AS capital, CASE WHEN p_size % 4 > 0 THEN array_to_string(list_sort(list_distinct([p_brand, 'a'])), ' OR ') END AS joined FROM part""",
)
def _(t: Tables) -> DataFrame:
    brand = F.col("p_brand")
    values = F.when(F.col("p_size") % 4 > 0, F.array(brand, F.lit("a"), brand, F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string")))
    return t.part.select(
        "p_partkey",
        S.first_match(brand, "#([0-9])", 1).alias("found"),
        S.match_first_rule(brand, {"^Brand#1": "one", "3$": "three"}).alias("rule"),
        S.capitalised(F.col("p_type")).alias("capital"),
        S.joined_set(values).alias("joined"),
    )


_POLARITY = " ".join(f"WHEN '{V.ROLE_CODES[n]}' THEN '{V.POLARITY_SYMBOLS[p]}'" for n, p in V.ROLE_POLARITY.items() if p in V.POLARITY_SYMBOLS)
_RULES = " ".join(f"WHEN '{V.ROLE_CODES[n]}' THEN '{r}'" for n, r in V.ROLE_RULES.items())


@query("interaction_names", f"SELECT rsc_id, sc_id || ' ' || CASE sbo_term {_POLARITY} ELSE '--' END || ' ' || r_id AS name, CASE sbo_term {_RULES} ELSE 'OPTIONAL' END AS rule FROM participants", ["participants"])
def _(t: Tables) -> DataFrame:
    return t.participants().select("rsc_id", S.interaction_name(F.col("sc_id"), F.col("r_id"), F.col("sbo_term")).alias("name"), S.role_rule(F.col("sbo_term")).alias("rule"))


@query("ensembl_parts", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ENSG' WHEN 1 THEN 'ENSMUST' END || lpad(p_partkey::VARCHAR, 11, '0') AS id, CASE p_size % 3 WHEN 0 THEN 'ensembl_gene' WHEN 1 THEN 'ensembl_transcript' END AS kind, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'MUS' END AS organism FROM part")
def _(t: Tables) -> DataFrame:
    prefix = F.when(F.col("p_size") % 3 == 0, "ENSG").when(F.col("p_size") % 3 == 1, "ENSMUST").otherwise("ENS")
    x = S.ensembl_parts(F.concat(prefix, F.lpad(F.col("p_partkey").cast("string"), 11, "0"), F.lit(".1")))
    return t.part.select("p_partkey", x.alias("x")).select("p_partkey", "x.id", "x.kind", "x.organism")
