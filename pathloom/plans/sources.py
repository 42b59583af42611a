"""Queries over identifiers, attributes and source-specific steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attributes, identifiers, ingest, traverse
from .adapters import Tables
from .registry import query

# --- identifiers -----------------------------------------------------------------


@query("identifier_arrays", "SELECT p_partkey AS s_id, p_brand AS brand, p_size < 10 AS small, 'brand,size,type' AS ontologies, 'BQB_HAS_PART,BQB_IS,BQB_IS_HOMOLOG_TO' AS qualifiers FROM part")
def _(t: Tables) -> DataFrame:
    x = F.col("identifiers")
    return t.species().select(
        "s_id",
        identifiers.hoist(x, "brand").alias("brand"),
        (identifiers.hoist(x, "size").cast("int") < 10).alias("small"),
        F.array_join(identifiers.ontologies_of(x), ",").alias("ontologies"),
        F.array_join(identifiers.qualifiers_of(x), ",").alias("qualifiers"),
    ).where(identifiers.has_ontology(F.array(F.struct(F.lit("brand").alias("ontology"))), ["brand"]))


@query("renamed_ontologies", "SELECT p_partkey AS s_id, ['marke', 'type', 'size'] AS ontologies FROM part")
def _(t: Tables) -> DataFrame:
    x = identifiers.rename_ontologies(F.col("identifiers"), {"brand": "marke"})
    return t.species().select("s_id", F.transform(x, lambda i: i["ontology"]).alias("ontologies"))


@query("merged_identifiers", "SELECT p_type, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.part.select("p_type", F.array(F.struct(F.col("p_brand").alias("identifier"))).alias("identifiers"))
    return identifiers.merged(rows, ["p_type"]).select("p_type", F.transform("identifiers", lambda i: i["identifier"]).alias("brands"))


@query("search_by_ids", "SELECT s_id FROM identifiers WHERE ontology = 'brand' AND identifier IN ('Brand#11', 'Brand#23')", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return identifiers.search_ids(t.identifiers(), t.species(), "s_id", identifiers=["Brand#11", "Brand#23"], ontologies=["brand"]).select("s_id")


@query("best_urls", "SELECT s_id, url FROM identifiers WHERE ontology = 'brand'", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return identifiers.best_urls(t.identifiers(), "s_id")


@query("best_urls_required", "SELECT s_id, url FROM identifiers WHERE ontology = 'type'", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return identifiers.best_urls(t.identifiers(), "s_id", required="type")


@query("two_tier_match", "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey % 50 = p_size AND s_suppkey = p_partkey UNION ALL SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey % 50 = p_size WHERE (s_suppkey % 50, s_suppkey) NOT IN (SELECT (p_size, p_partkey) FROM part)")
def _(t: Tables) -> DataFrame:
    left = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 50).cast("int").alias("p_size"), F.col("s_suppkey").alias("k"))
    right = t.part.select("p_size", F.col("p_partkey").alias("k"), "p_partkey")
    return identifiers.two_tier(left, right, ["p_size", "k"], ["p_size"]).select("s_suppkey", "p_partkey")


@query("expanded_identifiers", "SELECT p_partkey AS s_id, 'supplier' AS ontology, 's' || (p_partkey % 7) AS identifier FROM part")
def _(t: Tables) -> DataFrame:
    known = t.part.select(F.col("p_partkey").alias("s_id"), F.lit("key").alias("ontology"), F.col("p_partkey").cast("string").alias("identifier"))
    wide = t.part.select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("supplier"))
    return identifiers.expand(known, wide)


# --- attributes ------------------------------------------------------------------


@query("attached_attributes", "SELECT n_nationkey, r_name AS region_r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    return attributes.attach(t.nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), t.region, "r_regionkey", "region_").select("n_nationkey", "region_r_name")


@query("transformed_attributes", "SELECT p_partkey, p_retailprice AS raw_p_retailprice, round(1.0 / (p_retailprice / 1000.0), 9) AS p_retailprice FROM part")
def _(t: Tables) -> DataFrame:
    once = attributes.transform(t.part.select("p_partkey", "p_retailprice"), {"p_retailprice": "string"})
    return attributes.transform(once, {"p_retailprice": "string_inv"}).withColumn("p_retailprice", F.round("p_retailprice", 9))


@query("attribute_spec", "SELECT coalesce(a.k, b.k) AS k, a.price, round(250000.0 / power(b.q, 1.7), 9) AS score FROM (SELECT p_partkey AS k, p_retailprice AS price FROM part) a FULL JOIN (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1) b ON a.k = b.k")
def _(t: Tables) -> DataFrame:
    tables = {"part": t.part.select(F.col("p_partkey").alias("k"), "p_retailprice"), "lines": t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("q"))}
    spec = {"price": {"table": "part", "variable": "p_retailprice"}, "score": {"table": "lines", "variable": "q", "trans": "string"}}
    return attributes.compile_spec(spec, tables, "k").withColumn("score", F.round("score", 9))


@query("attribute_masks", "SELECT n_nationkey, n_regionkey > 0 AS mask_n_regionkey, n_nationkey IN (1, 2) AS mask_n_nationkey FROM nation")
def _(t: Tables) -> DataFrame:
    v = t.nation.withColumn("name", F.col("n_nationkey"))
    return attributes.masks(v, ["n_regionkey", "n_nationkey"], {"n_regionkey": "attr", "n_nationkey": [1, 2]}).select("n_nationkey", "mask_n_regionkey", "mask_n_nationkey")


@query("compartment_pairs", "SELECT DISTINCT a.s_id AS origin, b.s_id AS dest, a.sc_id AS sc_id_origin, b.sc_id AS sc_id_dest FROM cspecies a JOIN cspecies b ON b.s_id = a.s_id + 1", ["cspecies"])
def _(t: Tables) -> DataFrame:
    pairs = t.part.select(F.col("p_partkey").alias("origin"), (F.col("p_partkey") + 1).alias("dest"))
    return attributes.compartment_pairs(t.cspecies(), pairs)


@query("shared_reactions", "n AS (SELECT 5 * (s_id // 5) AS focal, sc_id FROM cspecies) SELECT focal, r_id FROM n JOIN participants USING (sc_id) GROUP BY 1, 2 HAVING count(*) >= 2", ["participants", "cspecies"])
def _(t: Tables) -> DataFrame:
    n = t.cspecies().select((F.floor(F.col("s_id") / 5) * 5).alias("focal"), F.col("sc_id").alias("name"))
    return attributes.shared_reactions(n, t.participants())


@query(
    "precomputed_neighbours",
    """x AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY weight, src) AS b FROM trade),
    y AS (SELECT n_nationkey AS focal, n_nationkey AS name, 0.0 AS h FROM nation UNION ALL SELECT src, dst, 1.0 FROM x WHERE a <= 3 UNION ALL SELECT dst, src, 1.0 FROM x WHERE b <= 3)
    SELECT focal, name, min(h)::DOUBLE AS hops FROM y GROUP BY 1, 2""",
    ["trade"],
)
def _(t: Tables) -> DataFrame:
    d = t.trade().select(F.col("src").alias("sc_id_origin"), F.col("dst").alias("sc_id_dest"), F.lit(1.0).alias("path_length"), F.col("weight").alias("path_weight"))
    return attributes.precomputed_neighbours(d, t.nation.select(F.col("n_nationkey").alias("name")), 1, 3)


@query("indirect_interactions", "SELECT DISTINCT a.src AS sc_id_upstream, b.dst AS sc_id_downstream FROM trade a JOIN trade b ON a.dst = b.src WHERE a.src < b.dst", ["trade"])
def _(t: Tables) -> DataFrame:
    e = t.trade()
    d = traverse.distances(e, max_steps=2).select(F.col("origin").alias("sc_id_origin"), F.col("dest").alias("sc_id_dest"), F.col("distance").alias("path_length"))
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src < b.dst").select(F.col("a.src").alias("sc_id_upstream"), F.col("b.dst").alias("sc_id_downstream")).distinct()
    return attributes.indirect_interactions(two, d, 2).select("sc_id_upstream", "sc_id_downstream")


# --- sources ---------------------------------------------------------------------


@query(
    "bait_and_prey",
    """WITH p AS (SELECT l_orderkey AS study, l_partkey AS i, CASE WHEN l_returnflag = 'A' THEN 'bait' WHEN l_returnflag = 'R' THEN 'prey' ELSE 'other' END AS role FROM lineitem),
    s AS (SELECT study, count(*) FILTER (role = 'bait') AS b, count(*) FILTER (role = 'prey') AS y, count(*) AS n FROM p GROUP BY 1)
    SELECT study, least(u.i, v.i) AS a, greatest(u.i, v.i) AS b FROM p u JOIN p v USING (study) JOIN s USING (study) WHERE s.b = 1 AND s.y > 0 AND u.role = 'bait' AND v.role = 'prey'
    UNION ALL SELECT study, min(i), max(i) FROM p JOIN s USING (study) WHERE NOT (s.b = 1 AND s.y > 0) AND n = 2 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "bait").when(F.col("l_returnflag") == "R", "prey").otherwise("other")
    return ingest.bait_and_prey(t.lineitem.select(F.col("l_orderkey").alias("study"), F.col("l_partkey").alias("interactor"), role.alias("role")))


@query(
    "cross_references",
    """WITH r AS (SELECT p_partkey AS i, unnest(['uni', 'mim', 'go']) AS o, unnest([CASE WHEN p_partkey % 3 > 0 THEN 'U' || p_partkey END, 'M' || p_size, 'G']) AS x FROM part)
    SELECT i AS interactor, 'uniprot' AS ontology, x AS identifier FROM r WHERE o = 'uni' AND x IS NOT NULL UNION ALL SELECT i, 'mim', x FROM r WHERE o = 'mim' AND i % 3 > 0""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("interactor"), F.inline(F.array(F.struct(F.lit("uni").alias("ontology"), F.when(k % 3 > 0, F.concat(F.lit("U"), k.cast("string"))).alias("identifier")), F.struct(F.lit("mim").alias("ontology"), F.lit("M").alias("identifier")), F.struct(F.lit("go").alias("ontology"), F.lit("G").alias("identifier")))), "p_size")
    rows = rows.withColumn("identifier", F.when(F.col("ontology") == "mim", F.concat(F.lit(" M"), F.col("p_size").cast("string"))).otherwise(F.col("identifier"))).drop("p_size")
    return ingest.cross_references(rows, {"uni": "uniprot"}, ["uniprot"], ["mim"])


@query(
    "annotated_edges",
    """WITH p AS (SELECT l_partkey AS s, l_suppkey AS d, l_quantity AS q, l_returnflag AS f FROM lineitem),
    x AS (SELECT s AS src, d AS dst, CASE f WHEN 'A' THEN 'stimulator' WHEN 'R' THEN 'inhibitor' ELSE 'interactor' END AS role, q AS score FROM p UNION ALL SELECT d, s, 'stimulator', q FROM p WHERE f = 'A')
    SELECT src, dst, role, score FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, role) AS k FROM x) WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    pairs = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("score"), F.when(flag == "A", "activated by").when(flag == "R", "").otherwise("complex").alias("annotation"), F.when(flag == "A", "<->").when(flag == "R", "-|").otherwise("-").alias("direction"))
    return ingest.annotated_edges(pairs)


@query("evidence_roles", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND p_size % 2 = 1 THEN 'modifier' WHEN p_partkey % 2 = 1 THEN 'stimulator' WHEN p_size % 2 = 1 THEN 'inhibitor' WHEN p_partkey % 3 = 0 THEN 'modifier' ELSE 'interactor' END AS upstream, NOT (p_partkey % 2 = 1 OR p_size % 2 = 1 OR p_partkey % 3 = 0) AS reversible FROM part")
def _(t: Tables) -> DataFrame:
    x = ingest.evidence_roles(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 2 == 1, F.col("p_size") % 2 == 1)
    return t.part.select("p_partkey", x.alias("x")).select("p_partkey", "x.upstream", "x.reversible")


@query("complex_members", "SELECT p_partkey AS complex, unnest(['m' || p_size, 'n']) AS member, unnest([-p_size::DOUBLE, -0.0::DOUBLE]) + 0.0 AS stoichiometry FROM part")
def _(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("complex"), F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("_n")).alias("members"), F.col("p_size").cast("string").alias("stoichiometry"))
    return ingest.complex_members(rows).withColumn("stoichiometry", F.col("stoichiometry") + 0.0)


@query("least_p_values", "SELECT l_partkey, l_suppkey, min(l_discount) AS p_value, count(*) AS n_measurements FROM lineitem GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return ingest.least_p(t.lineitem.select("l_partkey", "l_suppkey", F.col("l_discount").alias("p_value")), ["l_partkey", "l_suppkey"])


@query("perturbed_species", "SELECT s_suppkey, a.s_id AS perturbed_species_id, b.s_id AS target_species_id FROM supplier JOIN identifiers a ON a.ontology = 'brand' AND a.identifier = 'Brand#1' || (s_nationkey % 5 + 1) JOIN identifiers b ON b.ontology = 'size' AND b.identifier = (s_suppkey % 50 + 1)::VARCHAR", ["identifiers"])
def _(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("Brand#1"), (F.col("s_nationkey") % 5 + 1).cast("string")).alias("a"), (F.col("s_suppkey") % 50 + 1).cast("string").alias("b"))
    return ingest.with_species(rows, t.identifiers(), "a", "b", "brand", "size").select("s_suppkey", "perturbed_species_id", "target_species_id")


@query("clustered_mappings", "SELECT count(DISTINCT p_brand) AS n_clusters, (count(DISTINCT p_partkey) + count(DISTINCT p_brand))::BIGINT AS n_ids FROM part")
def _(t: Tables) -> DataFrame:
    m = t.part.select(F.lit("part").alias("ontology_a"), F.col("p_partkey").cast("string").alias("identifier_a"), F.lit("brand").alias("ontology_b"), F.col("p_brand").alias("identifier_b"))
    return ingest.cluster_mappings(m, ["brand"]).agg(F.countDistinct("s_name").alias("n_clusters"), F.sum("n_ids").alias("n_ids"))


@query("parsed_reactions", "SELECT p_partkey, unnest([p_brand, p_type, 'x']) AS s_name, unnest([-1.0, -1.0, 1.0])::DOUBLE AS stoichiometry FROM part")
def _(t: Tables) -> DataFrame:
    return ingest.parsed_reactions(t.part.select("p_partkey", F.concat(F.col("p_brand"), F.lit(" + "), F.col("p_type"), F.lit(" -> x")).alias("formula")), "p_partkey")


@query("closed_removal", "SELECT 'reactions' AS entity, count(*) AS n FROM reactions WHERE pathway_id = 'BUILDING' UNION ALL SELECT 'reaction_species', count(DISTINCT rsc_id) FROM participants JOIN reactions USING (r_id) WHERE pathway_id = 'BUILDING'", ["participants", "reactions"])
def _(t: Tables) -> DataFrame:
    keys = {"reactions": ("r_id", {}), "reaction_species": ("rsc_id", {"r_id": "reactions"})}
    gone = ingest.closed_removal({"reactions": t.reactions(), "reaction_species": t.participants()}, keys, {"reactions": t.reactions().where("pathway_id = 'BUILDING'")})
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in gone.items()]
    return out[0].unionByName(out[1])


@query("membership_reactions", "WITH m AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part) SELECT 'R' || lpad((100 + row_number() OVER (ORDER BY b, t))::VARCHAR, 8, '0') AS r_id, t || ' IS A ' || b AS r_name, false AS r_isreversible FROM m")
def _(t: Tables) -> DataFrame:
    m = t.part.select(F.col("p_brand").alias("set_id"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("member_id"), F.col("p_type").alias("member_name")).distinct()
    return ingest.set_membership_reactions(m, 100)[0]
