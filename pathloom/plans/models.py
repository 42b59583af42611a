"""Queries over the pathway model: summaries, scalars, matching, edges, integrity, wiring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import scalars as S
from ..operators import edgelist, integrity, matching, summaries, wiring
from .adapters import Tables
from .registry import query

# --- summaries -------------------------------------------------------------------


@query(
    "cspecies_features",
    """SELECT sc_id, s_id, c_id, count(*) AS sc_degree, count(*) FILTER (stoichiometry <= 0) AS sc_children, count(*) FILTER (stoichiometry > 0) AS sc_parents
    FROM participants GROUP BY ALL""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    return summaries.cspecies_features(t.participants(), t.cspecies())


@query(
    "sbo_occurrence_pivot",
    """SELECT r_id, """
    + ", ".join(f"""count(*) FILTER (sbo_term = '{code}') AS "{name}\"""" for code, name in sorted(V.ROLE_NAMES.items()))
    + " FROM participants GROUP BY r_id",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    return summaries.role_occurrence(t.participants())


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "source_occurrence",
    "SELECT s_id, " + ", ".join(f"count(*) FILTER (pathway_id = '{s}') AS {s}" for s in SEGMENTS) + " FROM participants JOIN reactions USING (r_id) GROUP BY s_id",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    long = t.participants().join(t.reactions(), "r_id").select("s_id", "pathway_id")
    return summaries.occurrence(long, "s_id", "pathway_id", SEGMENTS)


@query(
    "source_occurrence_binary",
    "SELECT s_id, " + ", ".join(f"least(count(*) FILTER (pathway_id = '{s}'), 1) AS {s}" for s in SEGMENTS) + " FROM participants JOIN reactions USING (r_id) GROUP BY s_id",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    long = t.participants().join(t.reactions(), "r_id").select("s_id", "pathway_id")
    return summaries.occurrence(long, "s_id", "pathway_id", SEGMENTS, binarise=True)


@query(
    "source_cooccurrence",
    """, x AS (SELECT DISTINCT s_id, pathway_id FROM participants JOIN reactions USING (r_id))
    SELECT a.pathway_id AS a, b.pathway_id AS b, count(*) AS n FROM x a JOIN x b USING (s_id) GROUP BY 1, 2""".lstrip(", "),
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    long = t.participants().join(t.reactions(), "r_id").select("s_id", "pathway_id")
    return summaries.cooccurrence(long, long, "s_id", "pathway_id", "pathway_id")


@query(
    "ontology_x_source_cooccurrence",
    """x AS (SELECT DISTINCT s_id, pathway_id FROM participants JOIN reactions USING (r_id)), y AS (SELECT DISTINCT s_id, identifier FROM identifiers WHERE ontology = 'brand')
    SELECT identifier AS a, pathway_id AS b, count(*) AS n FROM y JOIN x USING (s_id) GROUP BY 1, 2""",
    ["participants", "reactions", "identifiers"],
)
def _(t: Tables) -> DataFrame:
    sources = t.participants().join(t.reactions(), "r_id").select("s_id", "pathway_id")
    return summaries.cooccurrence(t.identifiers().where("ontology = 'brand'"), sources, "s_id", "identifier", "pathway_id")


@query(
    "sbo_x_source_cooccurrence",
    """x AS (SELECT DISTINCT r_id, sbo_term FROM participants) SELECT sbo_term AS a, pathway_id AS b, count(*) AS n FROM x JOIN reactions USING (r_id) GROUP BY 1, 2""",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    return summaries.cooccurrence(t.participants(), t.reactions(), "r_id", "sbo_term", "pathway_id")


@query(
    "missing_ids_other",
    """x AS (SELECT s_id, count(*) FILTER (identifier LIKE 'Brand#1%') AS first, count(*) FILTER (identifier LIKE 'Brand#2%') AS second FROM identifiers
      WHERE ontology = 'brand' AND (identifier LIKE 'Brand#1%' OR identifier LIKE 'Brand#2%') GROUP BY 1)
    SELECT s_id, first, second, 0::BIGINT AS other FROM x UNION ALL SELECT p_partkey, 0, 0, 1 FROM part WHERE p_partkey NOT IN (SELECT s_id FROM x)""",
    ["identifiers"],
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("identifier").startswith("Brand#1"), "first").when(F.col("identifier").startswith("Brand#2"), "second")
    long = t.identifiers().where("ontology = 'brand'").withColumn("kind", kind)
    return summaries.add_missing_ids(summaries.occurrence(long, "s_id", "kind", ["first", "second"]), t.species(), "s_id")


@query("source_totals", "SELECT pathway_id, count(*) AS total_counts FROM reactions GROUP BY 1", ["reactions"])
def _(t: Tables) -> DataFrame:
    return summaries.total_counts(t.reactions(), "pathway_id")


@query("identifiers_exploded", "SELECT s_id, CASE ontology WHEN 'brand' THEN 0 WHEN 'type' THEN 1 ELSE 2 END AS entry, ontology, identifier, url, bqb FROM identifiers", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return summaries.explode_identifiers(t.species(), "s_id")


@query("best_identifier", "SELECT s_id, s_name, ontology, identifier, url, bqb FROM identifiers WHERE ontology = 'brand'", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return summaries.best_identifier(t.identifiers(), ["s_id"])


@query(
    "characteristic_ids",
    """wide AS (SELECT ontology, identifier FROM (SELECT DISTINCT s_id, ontology, identifier FROM identifiers WHERE bqb = 'BQB_HAS_PART') GROUP BY ALL HAVING count(*) > 20)
    SELECT s_id, ontology, identifier, bqb FROM identifiers WHERE bqb IN ('BQB_IS', 'BQB_IS_HOMOLOG_TO')
    UNION ALL SELECT s_id, ontology, identifier, bqb FROM identifiers WHERE bqb = 'BQB_HAS_PART' AND (ontology, identifier) NOT IN (SELECT (ontology, identifier) FROM wide)""",
    ["identifiers"],
)
def _(t: Tables) -> DataFrame:
    return summaries.characteristic(t.identifiers()).select("s_id", "ontology", "identifier", "bqb")


@query(
    "identical_members",
    """x AS (SELECT p_brand AS g, list_sort(list(DISTINCT p_size)) AS m FROM part GROUP BY 1)
    SELECT len(m)::BIGINT AS n_members, string_agg(g, ' OR ' ORDER BY g) AS groups, count(*) AS n_groups FROM x GROUP BY m""".replace("x AS", "WITH x AS", 1),
)
def _(t: Tables) -> DataFrame:
    return summaries.identical_members(t.part, "p_brand", "p_size").drop("membership")


@query(
    "collapsed_sources",
    """SELECT s_id, string_agg(DISTINCT pathway_id, ' OR ' ORDER BY pathway_id) AS pathway_id, string_agg(DISTINCT r_name, ' OR ' ORDER BY r_name) AS r_name, count(*) AS n_collapsed
    FROM participants JOIN reactions USING (r_id) GROUP BY s_id""",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    return summaries.collapse(t.participants().join(t.reactions(), "r_id"), ["s_id"], ["pathway_id", "r_name"])


@query("model_profile", """SELECT 'compartments' AS "table", count(*) AS n_rows FROM region UNION ALL SELECT 'participants', count(*) FROM lineitem UNION ALL SELECT 'reactions', count(*) FROM orders UNION ALL SELECT 'species', count(*) FROM part""")
def _(t: Tables) -> DataFrame:
    return summaries.profile({"compartments": t.compartments(), "species": t.species(), "reactions": t.reactions(), "participants": t.participants()})


#: Steps of the cover that its SQL spells out; sizes are 50, and a step covers two or more.
_COVER = 25
_COVER_SQL = "WITH l0 AS MATERIALIZED (SELECT DISTINCT p_brand, p_size FROM part)" + "".join(
    f""", t{k} AS MATERIALIZED (SELECT p_brand, count(*) AS n FROM l{k} GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, p_brand LIMIT 1),
    l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} WHERE p_size NOT IN (SELECT p_size FROM l{k} JOIN t{k} USING (p_brand)))"""
    for k in range(_COVER)
)


@query("set_cover_sources", _COVER_SQL + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, p_brand, n AS n_covered FROM t{k}" for k in range(_COVER)))
def _(t: Tables) -> DataFrame:
    return summaries.set_cover(t.part.select("p_brand", "p_size"), "p_brand", "p_size", 2)


# --- scalars ---------------------------------------------------------------------


@query(
    "nameness_scores",
    r"""SELECT p_partkey, length(p_name) + CASE WHEN regexp_matches(p_name, '\s') THEN 0 ELSE 10 END + 5 * len(regexp_extract_all(p_name, '[0-9]')) AS score,
    upper(p_name[1]) || p_name[2:] AS name FROM part""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.nameness(F.col("p_name")).cast("long").alias("score"), S.capitalised(F.col("p_name")).alias("name"))


@query("species_types", "SELECT p_partkey AS s_id, CASE p_partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'metabolite' WHEN 2 THEN 'protein' WHEN 3 THEN 'drug' WHEN 4 THEN 'other' ELSE 'other' END AS species_type FROM part")
def _(t: Tables) -> DataFrame:
    def ids(*names: str):  # noqa: ANN202
        return F.array(*[F.struct(F.lit(n).alias("ontology")) for n in names])

    k = F.col("p_partkey") % 6
    none = F.array().cast("array<struct<ontology:string>>")
    made = F.when(k == 0, none).when(k == 1, ids("chebi", "kegg")).when(k == 2, ids("uniprot")).when(k == 3, ids("drugbank", "chebi")).when(k == 4, ids("chebi", "uniprot")).otherwise(ids("go"))
    return t.part.select(F.col("p_partkey").alias("s_id"), S.species_type(made).alias("species_type"))


_URLS = """CASE p_partkey % 5 WHEN 0 THEN 'https://www.ncbi.nlm.nih.gov/gene/' || p_partkey WHEN 1 THEN 'https://www.ebi.ac.uk/chebi/searchId.do?chebiId=CHEBI:' || p_partkey
    WHEN 2 THEN 'http://identifiers.org/kegg.compound/C' || p_partkey WHEN 3 THEN 'https://identifiers.org/go:' || p_partkey ELSE 'https://nowhere.example/' || p_partkey END"""


@query(
    "identifier_urls",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ncbi_entrez_gene' WHEN 1 THEN 'chebi' WHEN 2 THEN 'kegg.compound' WHEN 3 THEN 'go' END AS ontology,
    CASE p_partkey % 5 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN 'C' || p_partkey WHEN 3 THEN p_partkey::VARCHAR END AS identifier FROM part""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr(_URLS).alias("url")).select("p_partkey", S.parse_identifier_url(F.col("url")).alias("x")).select("p_partkey", "x.ontology", "x.identifier")


@query(
    "made_urls",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://www.ebi.ac.uk/chebi/CHEBI:' || p_partkey WHEN 1 THEN 'https://purl.uniprot.org/uniprot/P' || p_partkey END AS url FROM part""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    ontology = F.when(k == 0, "chebi").when(k == 1, "uniprot").otherwise("pubchem")
    identifier = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).otherwise("not a number")
    return t.part.select("p_partkey", S.identifier_url(ontology, identifier).alias("url"))


@query("weight_transformations", "SELECT p_partkey, round(250000.0 / power(p_retailprice, 1.7), 9) AS w, round(1.0 / (p_retailprice / 1000.0), 9) AS v FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(S.TRANSFORMATIONS["string"](F.col("p_retailprice")), 9).alias("w"), F.round(S.TRANSFORMATIONS["string_inv"](F.col("p_retailprice")), 9).alias("v"))


@query("minted_ids", "SELECT p_partkey, 'S' || lpad((row_number() OVER (ORDER BY p_partkey) - 1 + 5000)::VARCHAR, 8, '0') AS s_id FROM part")
def _(t: Tables) -> DataFrame:
    current = t.spark.createDataFrame([(4999,)], "m long")
    return integrity.next_ids(t.part.select("p_partkey"), current, "S", ["p_partkey"], "s_id")


# --- matching --------------------------------------------------------------------


def _features(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("feature_id"), F.concat_ws(" / ", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string")), (F.col("s_suppkey") % 50 + 1).cast("string")).alias("identifier"), "s_acctbal")


_FEATURES = """f AS (SELECT s_suppkey AS feature_id, unnest(['Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1), (s_suppkey % 50 + 1)::VARCHAR]) AS identifier, s_acctbal FROM supplier)"""


@query("match_features", _FEATURES + " SELECT feature_id, identifier, s_acctbal, ontology, s_id, s_name, bqb FROM f JOIN identifiers USING (identifier) WHERE ontology IN ('brand', 'size')", ["identifiers"])
def _(t: Tables) -> DataFrame:
    return matching.features_to_species(_features(t), t.identifiers(), ["brand", "size"])


@query(
    "match_wide",
    """w AS (SELECT s_suppkey AS feature_id, CASE WHEN s_suppkey % 3 > 0 THEN 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) END AS brand, (s_suppkey % 50 + 1)::VARCHAR AS size FROM supplier),
    l AS (SELECT feature_id, 'brand' AS ontology, brand AS identifier FROM w WHERE brand IS NOT NULL UNION ALL SELECT feature_id, 'size', size FROM w)
    SELECT feature_id, ontology, identifier, s_id, s_name, bqb FROM l JOIN identifiers USING (ontology, identifier)""",
    ["identifiers"],
)
def _(t: Tables) -> DataFrame:
    brand = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string")))
    wide = t.supplier.select(F.col("s_suppkey").alias("feature_id"), brand.alias("brand"), (F.col("s_suppkey") % 50 + 1).cast("string").alias("size"))
    return matching.match_wide(wide, t.identifiers(), ["brand", "size"])


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("s_id"), F.col("l_suppkey").alias("feature_id"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))


_ONE = "one AS (SELECT l_partkey AS s_id, l_suppkey AS feature_id, min(l_quantity) AS quantity, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY feature_id) AS w FROM one)"
_REST = "string_agg(DISTINCT flag, ',' ORDER BY flag) AS flag, count(*) AS n_match FROM w GROUP BY s_id"
for _method, _expr in {"weighted_mean": "sum(quantity * w) / sum(w)", "mean": "avg(quantity)", "first": "arg_min(quantity, feature_id)", "max": "max(quantity)"}.items():

    @query(f"resolve_{_method}", f"WITH {_ONE} SELECT s_id, round({_expr}, 6) AS quantity, {_REST}")
    def _(t: Tables, method: str = _method) -> DataFrame:
        return matching.resolve(_lines(t), numeric=method, keep_ids=False).withColumn("quantity", F.round("quantity", 6))


@query(
    "edgelist_to_species",
    """e AS (SELECT DISTINCT 'Brand#' || (s_suppkey % 5 + 1) || '1' AS identifier_upstream, 'Brand#' || (s_nationkey % 5 + 1) || '2' AS identifier_downstream FROM supplier),
    k AS (SELECT DISTINCT identifier, s_id, s_name FROM identifiers WHERE ontology = 'brand')
    SELECT identifier_upstream, identifier_downstream, a.s_id AS s_id_upstream, a.s_name AS s_name_upstream, b.s_id AS s_id_downstream, b.s_name AS s_name_downstream
    FROM e JOIN k a ON a.identifier = identifier_upstream JOIN k b ON b.identifier = identifier_downstream""",
    ["identifiers"],
)
def _(t: Tables) -> DataFrame:
    e = t.supplier.select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit("1")).alias("identifier_upstream"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), F.lit("2")).alias("identifier_downstream")).distinct()
    return matching.edgelist_to_species(e, t.identifiers(), ["brand"])


@query(
    "direct_interactions",
    """e AS (SELECT DISTINCT a.sc_id AS sc_id_upstream, b.sc_id AS sc_id_downstream FROM participants a JOIN participants b USING (r_id) WHERE a.s_id < b.s_id)
    SELECT DISTINCT sc_id_upstream, sc_id_downstream, a.r_id FROM e JOIN participants a ON a.sc_id = sc_id_upstream JOIN participants b ON b.sc_id = sc_id_downstream AND a.r_id = b.r_id
    WHERE (a.stoichiometry < 0 AND b.stoichiometry > 0) OR (a.stoichiometry = 0 AND b.stoichiometry <> 0)""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    p = t.participants()
    a = p.select("r_id", F.col("s_id").alias("x"), F.col("sc_id").alias("sc_id_upstream"))
    e = a.join(p.select("r_id", F.col("s_id").alias("y"), F.col("sc_id").alias("sc_id_downstream")), "r_id").where("x < y").select("sc_id_upstream", "sc_id_downstream").distinct()
    return matching.direct_interactions(e, p)


@query(
    "pluck_attributes",
    """SELECT coalesce(a.k, b.k) AS k, a.price, b.quantity FROM (SELECT p_partkey AS k, p_retailprice AS price FROM part WHERE p_size < 30) a
    FULL JOIN (SELECT l_partkey AS k, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k""",
)
def _(t: Tables) -> DataFrame:
    a = t.part.where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_retailprice"))
    b = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    return matching.pluck({"a": a, "b": b}, {"price": ("a", "p_retailprice"), "quantity": ("b", "q")}, "k")


# --- edge lists ------------------------------------------------------------------


@query("edgelist_dedup", "SELECT src, dst, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS l_quantity FROM supplies GROUP BY 1, 2", ["supplies"])
def _(t: Tables) -> DataFrame:
    return edgelist.remove_duplicates(t.supplies(), ["l_orderkey", "l_linenumber"]).select("src", "dst", "l_quantity")


@query("reciprocal_removed", """SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY n DESC, src) AS k FROM trade) WHERE k = 1""", ["trade"])
def _(t: Tables) -> DataFrame:
    return edgelist.remove_reciprocal(t.trade(), [F.desc("n"), "src"]).select("src", "dst", "n")


@query("reciprocal_share", "SELECT count(b.src) AS n_reciprocal, count(*) AS n_edges, round(count(b.src) / count(*), 9) AS share FROM trade a LEFT JOIN trade b ON a.src = b.dst AND a.dst = b.src", ["trade"])
def _(t: Tables) -> DataFrame:
    return edgelist.reciprocal_share(t.trade()).withColumn("share", F.round("share", 9))


@query("missing_edges", "SELECT src, dst FROM trade a WHERE NOT EXISTS (SELECT 1 FROM trade b WHERE b.n > 110 AND ((a.src = b.src AND a.dst = b.dst) OR (a.src = b.dst AND a.dst = b.src)))", ["trade"])
def _(t: Tables) -> DataFrame:
    e = t.trade()
    return edgelist.missing_edges(e, e.where("n > 110"), directed=False).select("src", "dst")


for _logic, _op in (("and", "INTERSECT"), ("or", "UNION")):

    @query(f"universe_{_logic}", f"x AS (SELECT src, dst FROM trade WHERE weight < 9.5 {_op} SELECT src, dst FROM trade WHERE n < 130) SELECT src, dst FROM x", ["trade"])
    def _(t: Tables, logic: str = _logic) -> DataFrame:
        e = t.trade()
        return edgelist.universe([e.where("weight < 9.5"), e.where("n < 130")], logic, t.nation.select(F.col("n_nationkey").alias("name")))


@query("universe_complete", "SELECT DISTINCT least(a.n_nationkey, b.n_nationkey) AS src, greatest(a.n_nationkey, b.n_nationkey) AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def _(t: Tables) -> DataFrame:
    return edgelist.universe([], "or", t.nation.select(F.col("n_nationkey").alias("name")), directed=False)


@query("vertex_degrees", "d AS (SELECT DISTINCT src, dst FROM supplies), x AS (SELECT src AS name, 0 AS p, 1 AS c FROM d UNION ALL SELECT dst, 1, 0 FROM d) SELECT name, sum(p)::BIGINT AS n_parents, sum(c)::BIGINT AS n_children, sum(p + c)::BIGINT AS degree FROM x GROUP BY 1", ["supplies"])
def _(t: Tables) -> DataFrame:
    return edgelist.degrees(t.supplies())


@query("endpoint_attributes", "SELECT src, dst, n, a.n_name AS source_n_name, b.n_name AS target_n_name FROM trade LEFT JOIN nation a ON src = a.n_nationkey LEFT JOIN nation b ON dst = b.n_nationkey", ["trade"])
def _(t: Tables) -> DataFrame:
    return edgelist.endpoint_attributes(t.trade(), t.nation.withColumnRenamed("n_nationkey", "name"), ["n_name"]).select("src", "dst", "n", "source_n_name", "target_n_name")


# --- integrity -------------------------------------------------------------------


@query(
    "underspecified_reactions",
    """g AS (SELECT p.*, p_size < 8 AS gone, CASE WHEN sbo_term IN ('SBO:0000010', 'SBO:0000011') THEN 'D' WHEN sbo_term = 'SBO:0000013' THEN 'R' ELSE 'O' END AS rule FROM participants p JOIN part ON s_id = p_partkey),
    x AS (SELECT r_id, sbo_term, rule, bool_or(gone) AS part_gone, bool_and(gone) AS all_gone FROM g GROUP BY 1, 2, 3)
    SELECT DISTINCT r_id FROM x WHERE (rule = 'D' AND part_gone) OR (rule = 'R' AND all_gone)""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    p = t.participants()
    small = t.part.where("p_size < 8").select(F.col("p_partkey").alias("s_id"))
    return integrity.underspecified(p, p.join(small, "s_id", "left_semi").select("sc_id"))


_CASCADE = """forms AS (SELECT sc_id FROM cspecies WHERE s_id IN (SELECT p_partkey FROM part WHERE p_size = 1)),
    g AS (SELECT *, sc_id IN (SELECT sc_id FROM forms) AS gone, CASE WHEN sbo_term IN ('SBO:0000010', 'SBO:0000011') THEN 'D' WHEN sbo_term = 'SBO:0000013' THEN 'R' ELSE 'O' END AS rule FROM participants),
    x AS (SELECT r_id, sbo_term, rule, bool_or(gone) AS part_gone, bool_and(gone) AS all_gone FROM g GROUP BY 1, 2, 3),
    r AS (SELECT DISTINCT r_id FROM x WHERE (rule = 'D' AND part_gone) OR (rule = 'R' AND all_gone)),
    p AS (SELECT rsc_id FROM g WHERE gone OR r_id IN (SELECT r_id FROM r)),
    i AS (SELECT DISTINCT sc_id FROM participants WHERE sc_id NOT IN (SELECT sc_id FROM participants WHERE rsc_id NOT IN (SELECT rsc_id FROM p)))
    SELECT 'reactions' AS entity, r_id AS id FROM r UNION ALL SELECT 'reaction_species', rsc_id FROM p UNION ALL SELECT 'compartmentalized_species', sc_id FROM (SELECT sc_id FROM forms UNION SELECT sc_id FROM i)"""


@query("cascade_delete", _CASCADE, ["participants", "cspecies"])
def _(t: Tables) -> DataFrame:
    parts = integrity.cascade(t.part.where("p_size = 1").select(F.col("p_partkey").alias("s_id")), t.cspecies(), t.participants())
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("entity"), F.col(df.columns[0]).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("unused_entities", "SELECT 'reactions' AS entity, 'R' || o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'species', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(t: Tables) -> DataFrame:
    compartments = t.region.select(F.col("r_regionkey").alias("c_id"))
    return integrity.unused(t.participants(), t.cspecies(), t.reactions(), t.species(), compartments)


@query("key_faults", "SELECT count(*) - count(DISTINCT l_orderkey) > 0 AS repeats, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys, count(*) FILTER (l_partkey IS NULL) AS null_l_partkey FROM lineitem")
def _(t: Tables) -> DataFrame:
    return integrity.table_faults(t.lineitem, "l_orderkey", ["l_partkey"]).select((F.col("repeated_keys") > 0).alias("repeats"), "repeated_keys", "null_l_partkey")


@query("inferred_roles", "SELECT rsc_id, CASE WHEN s_id % 4 > 0 THEN sbo_term WHEN stoichiometry < 0 THEN 'SBO:0000010' WHEN stoichiometry > 0 THEN 'SBO:0000011' ELSE 'SBO:0000459' END AS sbo_term FROM participants", ["participants"])
def _(t: Tables) -> DataFrame:
    p = t.participants()
    return integrity.infer_roles(p.withColumn("sbo_term", F.when(F.col("s_id") % 4 > 0, F.col("sbo_term")))).select("rsc_id", "sbo_term")


@query(
    "inferred_compartments",
    """x AS (SELECT sc_id, s_id, CASE WHEN s_id % 20 > 0 THEN c_id END AS c_id FROM cspecies),
    v AS (SELECT a.sc_id, b.c_id, count(*) AS n FROM participants a JOIN x l ON a.sc_id = l.sc_id AND l.c_id IS NULL JOIN (SELECT p.r_id, y.c_id FROM participants p JOIN x y ON p.sc_id = y.sc_id AND y.c_id IS NOT NULL) b ON a.r_id = b.r_id GROUP BY 1, 2),
    m AS (SELECT sc_id, c_id FROM (SELECT *, row_number() OVER (PARTITION BY sc_id ORDER BY n DESC, c_id) AS k FROM v) WHERE k = 1),
    common AS (SELECT c_id FROM x WHERE c_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, c_id LIMIT 1)
    SELECT x.sc_id, coalesce(x.c_id, m.c_id, (SELECT c_id FROM common)) AS c_id FROM x LEFT JOIN m ON x.sc_id = m.sc_id""",
    ["participants", "cspecies"],
)
def _(t: Tables) -> DataFrame:
    c = t.cspecies().withColumn("c_id", F.when(F.col("s_id") % 20 > 0, F.col("c_id")))
    return integrity.infer_compartments(c, t.participants()).select("sc_id", "c_id")


@query(
    "reaction_formulas",
    """l AS (SELECT p.*, CASE WHEN s_id % 2 = 0 THEN '2 ' ELSE '' END || p_name AS label, stoichiometry AS s FROM participants p JOIN part ON s_id = p_partkey),
    x AS (SELECT r_id, coalesce(string_agg(CASE WHEN s_id % 2 = 0 AND s <> 0 THEN label ELSE p_name END, ' + ' ORDER BY CASE WHEN s_id % 2 = 0 AND s <> 0 THEN label ELSE p_name END, rsc_id) FILTER (s < 0), '') AS a,
      coalesce(string_agg(CASE WHEN s_id % 2 = 0 AND s <> 0 THEN label ELSE p_name END, ' + ' ORDER BY CASE WHEN s_id % 2 = 0 AND s <> 0 THEN label ELSE p_name END, rsc_id) FILTER (sbo_term = 'SBO:0000011'), '') AS b,
      coalesce(string_agg(p_name, ' + ' ORDER BY p_name, rsc_id) FILTER (s = 0), '') AS c FROM (SELECT *, substr(label, CASE WHEN s_id % 2 = 0 THEN 3 ELSE 1 END) AS p_name FROM l) GROUP BY 1)
    SELECT r_id, a || CASE WHEN r_isreversible THEN ' <-> ' ELSE ' -> ' END || b || CASE WHEN c <> '' THEN ' ---- modifiers: ' || c || ']' ELSE '' END AS formula FROM x JOIN reactions USING (r_id)""",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    p = t.participants().join(t.part.select(F.col("p_partkey").alias("s_id"), F.col("p_name").alias("name")), "s_id")
    p = p.withColumn("stoichiometry", F.when(F.col("s_id") % 2 == 0, F.col("stoichiometry") * 2).otherwise(F.col("stoichiometry")))
    return integrity.formulas(p, t.reactions())


_COFACTORS = ["ATP", "ADP", "AMP", "NADH", "NAD+", "water", "H+", "GTP", "GDP", "CoA", None]
_CO = "CASE s_id % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COFACTORS) if c) + " END"
_RULES = " UNION ALL ".join(
    f"SELECT r_id, '{reason}' AS filter_reason, unnest([{', '.join(repr(x) for x in every)}]) AS cofactor FROM s WHERE list_has_all(have, [{', '.join(repr(x) for x in every)}])"
    + (f" AND NOT list_has_any(have, [{', '.join(repr(x) for x in none)}])" if none else "")
    + (f" AND list_has_any(used, [{', '.join(repr(x) for x in sub)}])" if sub else "")
    for reason, (every, none, sub) in V.COFACTOR_RULES.items()
)


@query(
    "cofactor_rules",
    f"""p AS (SELECT *, {_CO} AS cofactor FROM participants WHERE stoichiometry <> 0),
    s AS (SELECT r_id, list(DISTINCT cofactor) FILTER (cofactor IS NOT NULL) AS have, coalesce(list(DISTINCT cofactor) FILTER (cofactor IS NOT NULL AND stoichiometry < 0), []) AS used FROM p WHERE cofactor IS NOT NULL GROUP BY 1),
    m AS ({_RULES}) SELECT rsc_id, filter_reason FROM p JOIN m USING (r_id, cofactor)""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    name = S.mapped(F.col("s_id") % 11, {i: c for i, c in enumerate(_COFACTORS) if c})
    cofactors = t.cspecies().select("sc_id", name.alias("cofactor")).where("cofactor IS NOT NULL")
    return integrity.cofactor_hits(t.participants(), cofactors)


@query("trivial_participants", "SELECT r_id, sc_id FROM participants GROUP BY 1, 2 HAVING sum(stoichiometry) = 0", ["participants"])
def _(t: Tables) -> DataFrame:
    return integrity.trivial_participants(t.participants())


@query(
    "exchange_gaps",
    """many AS (SELECT s_id FROM cspecies GROUP BY 1 HAVING count(DISTINCT c_id) > 1)
    SELECT s_id, NULL AS sc_id_from, NULL AS sc_id_to FROM many WHERE s_id NOT IN (SELECT s_id FROM cspecies WHERE c_id = 2)
    UNION ALL SELECT a.s_id, a.sc_id, b.sc_id FROM cspecies a JOIN cspecies b ON a.s_id = b.s_id AND a.c_id <> 2 AND b.c_id = 2""",
    ["cspecies"],
)
def _(t: Tables) -> DataFrame:
    lacking, pairs = integrity.exchange_gaps(t.cspecies(), 2)
    return lacking.select("s_id", F.lit(None).cast("string").alias("sc_id_from"), F.lit(None).cast("string").alias("sc_id_to")).unionByName(pairs)


# --- wiring ----------------------------------------------------------------------


def _wire_sql(approach: str, drop: str, source: str = "participants") -> str:
    tiers = wiring.tier_of(approach)
    case = "CASE sbo_term " + " ".join(f"WHEN '{V.ROLE_CODES[r]}' THEN {k}" for r, k in tiers.items() if r != "reaction") + " END"
    keep = {"always": "false", "edgelist": "n <> 2", "same_tier": "true"}[drop]
    pair = V.ROLE_CODES["interactor"]
    # materialised, and joined on one key, so that every plan of it is a hash join
    return f"""m AS MATERIALIZED (SELECT r_id, sc_id AS node, sbo_term, stoichiometry AS s, {case} AS tier FROM {source}),
    g AS MATERIALIZED (SELECT r_id, count(DISTINCT tier) AS t, count(*) AS n, count(DISTINCT (sbo_term, s)) AS k, count(*) = 2 AND bool_and(sbo_term = '{pair}') AS two FROM m GROUP BY 1),
    e AS (SELECT m.* FROM m JOIN g USING (r_id) WHERE t > 1 AND NOT two AND tier IS NOT NULL UNION ALL SELECT r_id, r_id, NULL::VARCHAR, NULL::DOUBLE, {tiers['reaction']} FROM g WHERE t > 1 AND NOT two AND {keep}),
    d AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY r_id ORDER BY tier) AS o FROM e),
    q AS MATERIALIZED (SELECT m.*, row_number() OVER (PARTITION BY r_id ORDER BY node) AS i FROM m JOIN g USING (r_id) WHERE t = 1 AND k = 1 AND NOT two)
    SELECT a.node AS src, b.node AS dst, a.sbo_term AS sbo_term_upstream, b.sbo_term AS sbo_term_downstream, a.s AS stoichiometry_upstream, b.s AS stoichiometry_downstream, a.r_id
      FROM (SELECT *, r_id || ' ' || (o + 1) AS j FROM d) a JOIN (SELECT *, r_id || ' ' || o AS j FROM d) b ON a.j = b.j
    UNION ALL SELECT a.node, b.node, a.sbo_term, b.sbo_term, a.s, b.s, a.r_id FROM q a JOIN q b ON a.r_id = b.r_id AND a.i < b.i
    UNION ALL SELECT min(node), max(node), '{pair}', '{pair}', 0.0::DOUBLE, 0.0::DOUBLE, r_id FROM m JOIN g USING (r_id) WHERE two GROUP BY r_id"""


for _approach in V.TIERS:
    for _drop in V.DROP_MODES:

        @query(f"wire_{_approach}_{_drop}", _wire_sql(_approach, _drop), ["participants"])
        def _(t: Tables, approach: str = _approach, drop: str = _drop) -> DataFrame:
            return wiring.wire(t.participants(), approach, drop)


@query(
    "wire_interactors",
    "x AS MATERIALIZED (SELECT * REPLACE (CASE WHEN split_part(rsc_id, '-', 1)::BIGINT % 3 = 0 THEN 'SBO:0000336' ELSE sbo_term END AS sbo_term) FROM participants WHERE split_part(rsc_id, '-', 2)::INT < 3),\n    "
    + _wire_sql("regulatory", "same_tier", "x"),
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    part = F.split("rsc_id", "-")
    p = t.participants().where(part[1].cast("int") < 3)
    return wiring.wire(p.withColumn("sbo_term", F.when(part[0].cast("long") % 3 == 0, V.ROLE_CODES["interactor"]).otherwise(F.col("sbo_term"))))


@query("bipartite_edges", "SELECT CASE WHEN stoichiometry <= 0 THEN sc_id ELSE r_id END AS src, CASE WHEN stoichiometry <= 0 THEN r_id ELSE sc_id END AS dst, stoichiometry, sbo_term, r_id FROM participants", ["participants"])
def _(t: Tables) -> DataFrame:
    return wiring.bipartite(t.participants())


_REVERSED = (
    "w AS ("
    + "WITH "
    + _wire_sql("regulatory", "same_tier")
    + """), f AS (SELECT w.*, r_isreversible FROM w JOIN reactions USING (r_id)),
    e AS (SELECT src, dst, sbo_term_upstream, sbo_term_downstream, stoichiometry_upstream, stoichiometry_downstream, r_id, 'forward' AS direction FROM f UNION ALL
      SELECT dst, src, CASE sbo_term_downstream WHEN 'SBO:0000010' THEN 'SBO:0000011' WHEN 'SBO:0000011' THEN 'SBO:0000010' ELSE sbo_term_downstream END,
        CASE sbo_term_upstream WHEN 'SBO:0000010' THEN 'SBO:0000011' WHEN 'SBO:0000011' THEN 'SBO:0000010' ELSE sbo_term_upstream END, -stoichiometry_downstream, -stoichiometry_upstream, r_id, 'reverse'
      FROM f WHERE r_isreversible AND coalesce(sbo_term_upstream, '') NOT IN ('SBO:0000013', 'SBO:0000020', 'SBO:0000459', 'SBO:0000019'))"""
)


@query("add_reverse_edges", _REVERSED + " SELECT * FROM e", ["participants", "reactions"])
def _(t: Tables) -> DataFrame:
    return wiring.add_reverse(wiring.wire(t.participants()), t.reactions())


@query(
    "topology_weights",
    """n AS (SELECT DISTINCT src, dst FROM supplies), c AS (SELECT src, count(*) AS sc_children FROM n GROUP BY 1), p AS (SELECT dst, count(*) AS sc_parents FROM n GROUP BY 1),
    j AS (SELECT n.src, n.dst, c.sc_children, p.sc_parents, CASE WHEN p.sc_parents % 2 = 0 THEN 'protein' ELSE 'metabolite' END AS species_type FROM n JOIN c USING (src) JOIN p USING (dst))
    SELECT src, dst, round(2 + CASE species_type WHEN 'protein' THEN 1.0 ELSE 3.0 END::DOUBLE / (SELECT avg(sc_children) FROM j) * sc_children, 6) AS weight,
      round(2 + CASE species_type WHEN 'protein' THEN 1.0 ELSE 3.0 END::DOUBLE / (SELECT avg(sc_children) FROM j) * sc_parents, 6) AS weight_upstream FROM j""",
    ["supplies"],
)
def _(t: Tables) -> DataFrame:
    n = t.supplies().select("src", "dst").distinct()
    j = n.join(n.groupBy("src").agg(F.count(F.lit(1)).alias("sc_children")), "src").join(n.groupBy("dst").agg(F.count(F.lit(1)).alias("sc_parents")), "dst")
    j = j.withColumn("sc_degree", F.col("sc_children") + F.col("sc_parents")).withColumn("species_type", F.when(F.col("sc_parents") % 2 == 0, "protein").otherwise("metabolite"))
    return wiring.topology_weights(j).select("src", "dst", F.round("weight", 6).alias("weight"), F.round("weight_upstream", 6).alias("weight_upstream"))


@query(
    "mixed_weights",
    """SELECT src, dst, CASE WHEN n % 2 = 0 THEN 10.0 ELSE 1.0 END::DOUBLE AS source_weight, round(least(weight, CASE WHEN n % 3 = 0 THEN n / 20.0 END::DOUBLE, CASE WHEN n % 2 = 0 THEN 10.0 ELSE 1.0 END::DOUBLE), 6) AS weight FROM trade""",
    ["trade"],
)
def _(t: Tables) -> DataFrame:
    e = t.trade().withColumnRenamed("weight", "topology_weight").withColumn("score", F.when(F.col("n") % 3 == 0, F.col("n") / 20.0)).withColumn("string_wt", F.when(F.col("n") % 2 == 0, F.col("n")))
    out = wiring.mixed_weights(wiring.source_weights(e, {"string_wt": 10.0}), ["score"], source="source_weight")
    return out.select("src", "dst", "source_weight", F.round("weight", 6).alias("weight"))
