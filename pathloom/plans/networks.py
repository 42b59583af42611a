"""Queries over networks, sets, samples, texts and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import stats
from ..operators import consensus, context, enrichment, propagation, search, transforms, traverse
from ..runtime import shared_dir
from ..streaming import quota
from .adapters import Tables
from .registry import query

# --- traversal -------------------------------------------------------------------

HOPS = 4
_D = "d1 AS (SELECT src AS origin, dst AS dest, min(w) AS d FROM (SELECT src, dst, {w} AS w FROM trade) GROUP BY 1, 2)" + "".join(
    f", d{k} AS (SELECT origin, dest, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT a.origin, t.dst, a.d + {{w}} FROM d{k - 1} a JOIN trade t ON a.dest = t.src WHERE a.origin <> t.dst) GROUP BY 1, 2)"
    for k in range(2, HOPS + 1)
)


@query("hop_distances", _D.format(w="1.0::DOUBLE") + f" SELECT origin, dest, d AS distance FROM d{HOPS} WHERE origin <> dest", ["trade"])
def _(t: Tables) -> DataFrame:
    return traverse.distances(t.trade(), max_steps=HOPS)


@query("weighted_distances", _D.format(w="weight") + f" SELECT origin, dest, round(d, 6) AS distance FROM d{HOPS} WHERE origin <> dest", ["trade"])
def _(t: Tables) -> DataFrame:
    return traverse.distances(t.trade(), weight="weight", max_steps=HOPS).withColumn("distance", F.round("distance", 6))


_DIST = "dist AS (SELECT src AS sc_id_origin, dst AS sc_id_dest, n::DOUBLE AS path_length, weight AS path_weight FROM trade)"


def _dist(t: Tables) -> DataFrame:
    return t.trade().select(F.col("src").alias("sc_id_origin"), F.col("dst").alias("sc_id_dest"), F.col("n").cast("double").alias("path_length"), F.col("weight").alias("path_weight"))


@query("distance_quantiles", _DIST + " SELECT sc_id_origin, sc_id_dest, path_length FROM dist WHERE path_length <= (SELECT quantile_cont(path_length, 0.1) FROM dist) OR path_weight <= (SELECT quantile_cont(path_weight, 0.1) FROM dist)", ["trade"])
def _(t: Tables) -> DataFrame:
    return traverse.quantile_filter(_dist(t), ["path_length", "path_weight"], 0.1).select("sc_id_origin", "sc_id_dest", "path_length")


for _up in (False, True):
    _o = "" if _up else " DESC"

    @query(
        "distances_top_n" + ("_nearest" if _up else ""),
        _DIST + f", x AS (SELECT *, row_number() OVER (PARTITION BY sc_id_origin ORDER BY path_length{_o}, sc_id_dest) AS a, row_number() OVER (PARTITION BY sc_id_dest ORDER BY path_length{_o}, sc_id_origin) AS b FROM dist) SELECT sc_id_origin, sc_id_dest, path_length FROM x WHERE a <= 2 OR b <= 2",
        ["trade"],
    )
    def _(t: Tables, up: bool = _up) -> DataFrame:
        return traverse.top_n_pairs(_dist(t), "path_length", 2, up).select("sc_id_origin", "sc_id_dest", "path_length")


@query(
    "neighbours_two_steps",
    """e AS (SELECT DISTINCT src, dst FROM trade), f AS (SELECT n_nationkey AS focal FROM nation),
    x AS (SELECT focal, focal AS name, 0 AS hops FROM f UNION ALL SELECT focal, dst, 1 FROM f JOIN e ON focal = src UNION ALL SELECT focal, b.dst, 2 FROM f JOIN e a ON focal = a.src JOIN e b ON a.dst = b.src)
    SELECT focal, name, min(hops)::INTEGER AS hops FROM x GROUP BY 1, 2""",
    ["trade"],
)
def _(t: Tables) -> DataFrame:
    return traverse.neighbours(t.trade(), t.nation.select(F.col("n_nationkey").alias("name")), 2)


@query("pruned_neighbours", "SELECT focal, name, n FROM (SELECT src AS focal, dst AS name, n, rank() OVER (PARTITION BY src ORDER BY n) AS r FROM trade) WHERE r <= 3", ["trade"])
def _(t: Tables) -> DataFrame:
    return traverse.prune_neighbours(t.trade().select(F.col("src").alias("focal"), F.col("dst").alias("name"), "n"), 3, "n")


_REACH = "o AS (SELECT min(src::VARCHAR) AS origin FROM trade), e AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, weight FROM trade), s0 AS (SELECT origin AS name, 0.0::DOUBLE AS d FROM o)" + "".join(
    f", s{k} AS (SELECT name, min(d) AS d FROM (SELECT * FROM s{k - 1} UNION ALL SELECT e.dst, s.d + e.weight FROM s{k - 1} s JOIN e ON e.src = s.name) GROUP BY 1)" for k in range(1, 11)
)


@query(
    "shortest_paths",
    _REACH
    + """, f AS (SELECT e.src, e.dst FROM e JOIN s10 a ON a.name = e.src JOIN s10 b ON b.name = e.dst WHERE abs(a.d + e.weight - b.d) < 1e-9),
    p AS (SELECT origin AS here, origin AS path FROM o UNION ALL SELECT f.dst, p.path || '>' || f.dst FROM p JOIN f ON f.src = p.here)
    SELECT here AS dest, path, round(d, 6) AS distance FROM p JOIN s10 ON name = here WHERE here <> (SELECT origin FROM o)""",
    ["trade"],
    recursive=True,
)
def _(t: Tables) -> DataFrame:
    e = t.trade().select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    origin = e.agg(F.min("src")).first()[0] or "0"
    targets = t.nation.select(F.col("n_nationkey").cast("string").alias("name"))
    return traverse.shortest_paths(e, origin, targets, "weight").select("dest", F.array_join("path", ">").alias("path"), F.round("distance", 6).alias("distance"))


@query(
    "path_polarity",
    """l AS (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step, CASE WHEN l_returnflag = 'R' THEN 'inhibition' WHEN l_returnflag = 'A' THEN 'activation' WHEN l_linenumber % 2 = 0 THEN 'bystander' ELSE 'ambiguous' END AS p FROM lineitem),
    x AS (SELECT *, sum((p = 'inhibition')::INT) OVER w AS turns, max((p = 'ambiguous')::INT) OVER w AS seen, min((p = 'ambiguous')::INT) OVER (PARTITION BY path_id) AS solely
      FROM l WINDOW w AS (PARTITION BY path_id ORDER BY step ROWS UNBOUNDED PRECEDING))
    SELECT path_id, step, CASE WHEN solely = 1 THEN 'ambiguous' ELSE CASE WHEN seen = 1 THEN 'ambiguous ' ELSE '' END || CASE WHEN turns % 2 = 0 THEN 'activation' ELSE 'inhibition' END END AS net_polarity FROM x""".replace("l AS", "WITH l AS", 1),
)
def _(t: Tables) -> DataFrame:
    flag, odd = F.col("l_returnflag"), F.col("l_linenumber") % 2
    p = F.when(flag == "R", "inhibition").when(flag == "A", "activation").when(odd == 0, "bystander").otherwise("ambiguous")
    # line numbers repeat inside an order: its steps are numbered anew
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    links = t.lineitem.select(F.col("l_orderkey").alias("path_id"), step.alias("step"), p.alias("link_polarity"))
    return traverse.net_polarity(links).select("path_id", "step", "net_polarity")


_CC = """e AS (SELECT DISTINCT 's' || s_suppkey AS a, 'k' || (s_suppkey % 17) || '_' || s_nationkey AS b FROM supplier UNION SELECT 's' || s_suppkey, 'a' || floor(s_acctbal / 250)::BIGINT FROM supplier),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS name, a AS root FROM u UNION SELECT b, b FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.name = u.a)
    SELECT name, min(root) AS component FROM r GROUP BY 1"""


@query("weak_components", "WITH RECURSIVE " + _CC)
def _(t: Tables) -> DataFrame:
    s = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    a = t.supplier.select(s.alias("src"), F.concat(F.lit("k"), (F.col("s_suppkey") % 17).cast("string"), F.lit("_"), F.col("s_nationkey").cast("string")).alias("dst"))
    b = t.supplier.select(s.alias("src"), F.concat(F.lit("a"), F.floor(F.col("s_acctbal") / 250).cast("string")).alias("dst"))
    return traverse.components(a.unionByName(b))


@query(
    "ancestors",
    """WITH RECURSIVE p AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0),
    r AS (SELECT child, parent AS ancestor, 1 AS depth FROM p UNION ALL SELECT r.child, p.parent, r.depth + 1 FROM r JOIN p ON r.ancestor = p.child)
    SELECT child, ancestor, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")).where("parent > 0")
    return traverse.closure(p)


# --- consensus -------------------------------------------------------------------


def _two_models(t: Tables) -> DataFrame:
    s = t.species().withColumn("model", F.when(F.col("s_id") % 2 == 0, "a").otherwise("b"))
    ids = F.array(F.struct(F.lit("pair").alias("ontology"), F.concat_ws("-", F.floor(F.col("s_id") / 4).cast("string"), F.lit("x")).alias("identifier"), F.lit(None).cast("string").alias("url"), F.when(F.col("s_id") % 3 == 0, "BQB_HAS_PART").otherwise("BQB_IS").alias("bqb")))
    return s.select("model", "s_id", "s_name", ids.alias("identifiers"))


@query(
    "consensus_species",
    """WITH s AS (SELECT p_partkey AS s_id, CASE WHEN p_partkey % 3 = 0 THEN 'own' || p_partkey ELSE 'pair' || floor(p_partkey / 4) END AS cluster, p_name FROM part),
    n AS (SELECT *, length(p_name) + CASE WHEN regexp_matches(p_name, '\\s') THEN 0 ELSE 10 END + 5 * len(regexp_extract_all(p_name, '[0-9]')) AS score FROM s)
    SELECT string_agg(s_id::VARCHAR, ',' ORDER BY s_id) AS members, first(p_name ORDER BY score, p_name) AS s_name FROM n GROUP BY cluster""",
)
def _(t: Tables) -> DataFrame:
    rows = _two_models(t)
    look = consensus.number_clusters(consensus.cluster_by_identifiers(rows, "s_id"), "S")
    j = rows.join(look.select("model", "s_id", "new_id"), ["model", "s_id"])
    members = j.groupBy("new_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_id")), lambda x: x.cast("string")), ",").alias("members"))
    return consensus.best_named(j, "new_id", "s_name", ["s_name", "model"]).join(members, "new_id").select("members", "s_name")


@query(
    "consensus_reactions",
    """m AS (SELECT r_id, list_sort(list(DISTINCT sbo_term || '__' || stoichiometry)) AS k FROM participants GROUP BY 1)
    SELECT len(k)::BIGINT AS n_tokens, count(*) AS n_reactions, bool_or(r_isreversible) AS r_isreversible, min(r_id) AS first FROM m JOIN reactions USING (r_id) GROUP BY k""",
    ["participants", "reactions"],
)
def _(t: Tables) -> DataFrame:
    p = t.participants().withColumn("model", F.lit("one"))
    token = F.concat_ws("__", "sbo_term", F.col("stoichiometry").cast("string"))
    look = consensus.number_clusters(consensus.member_strings(p, ["model", "r_id"], token), "R")
    n = p.groupBy("r_id").agg(F.size(F.collect_set(token)).cast("long").alias("n_tokens"))
    r = t.reactions().withColumn("model", F.lit("one"))
    flags = consensus.merge_reversibility(r, look)
    return look.join(n, "r_id").groupBy("new_id").agg(F.min("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_reactions"), F.min("r_id").alias("first")).join(flags, "new_id").drop("new_id")


@query("differing_values", """WITH x AS (SELECT p_brand, count(DISTINCT p_size) AS p_size, count(DISTINCT p_type) AS p_type FROM part GROUP BY 1) SELECT p_brand, 'p_size' AS "column", p_size AS n FROM x WHERE p_size > 1 UNION ALL SELECT p_brand, 'p_type', p_type FROM x WHERE p_type > 1""")
def _(t: Tables) -> DataFrame:
    return consensus.differing_values(t.part.select("p_brand", "p_size", "p_type"), "p_brand")


# --- statistics ------------------------------------------------------------------

_FO, _FP = stats.fisher_sql("a", "b", "c", "d")


@query("fisher_exact", f"WITH x AS (SELECT p_partkey, p_size AS a, 1 + p_partkey % 13 AS b, 1 + p_partkey % 7 AS c, 20 + p_partkey % 31 AS d FROM part) SELECT p_partkey, round({_FO}, 6) AS odds, round({_FP}, 6) AS p FROM x")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    odds, p = stats.fisher(F.col("p_size"), 1 + k % 13, 1 + k % 7, 20 + k % 31)
    return t.part.select("p_partkey", F.round(odds, 6).alias("odds"), F.round(p, 6).alias("p"))


@query("proportion_test", f"WITH x AS (SELECT p_partkey, (p_size % 20 + 1)::DOUBLE AS k, 50.0::DOUBLE AS n, (100 + p_partkey % 300)::DOUBLE AS big_k, 1000.0::DOUBLE AS big_n FROM part) SELECT p_partkey, round(n * big_k / big_n, 6) AS expected, round((k / (n - k)) / (big_k / (big_n - big_k)), 6) AS odds, round({stats.normal_tail_sql('(k / n - big_k / big_n) / sqrt(big_k / big_n * (1 - big_k / big_n) / n)')}, 6) AS p FROM x")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    e, o, p = stats.proportion(F.col("p_size") % 20 + 1, F.lit(50), 100 + k % 300, F.lit(1000))
    return t.part.select("p_partkey", F.round(e, 6).alias("expected"), F.round(o, 6).alias("odds"), F.round(p, 6).alias("p"))


@query("binomial_tail", "WITH x AS (SELECT p_partkey, p_size % 10 + 1 AS k, 20 AS n, 0.05 + (p_partkey % 80) / 100.0 AS p FROM part), y AS (SELECT *, unnest(range(k, n + 1)) AS i FROM x) SELECT p_partkey, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))), 6) AS tail FROM y GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(stats.binomial(F.col("p_size") % 10 + 1, F.lit(20), 0.05 + (F.col("p_partkey") % 80) / 100.0), 6).alias("tail"))


def _ora_sql() -> str:
    odds, p = stats.fisher_sql("k", "(set_size - k)", "(n_hits - k)", "(universe_size - set_size - n_hits + k)")
    return f"""h AS (SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_discount >= 0.09 AND l_quantity >= 49 AND l_returnflag = 'R'),
    x AS (SELECT geneset, count(h.member) AS k, count(*) AS set_size FROM brand_sets LEFT JOIN h USING (member) GROUP BY 1),
    y AS (SELECT *, (SELECT count(*) FROM h) AS n_hits, (SELECT count(*) FROM part) AS universe_size FROM x),
    z AS (SELECT *, {odds} AS odds_ratio, {p} AS p_value FROM y),
    r AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS c FROM z)
    SELECT geneset, k, set_size, n_hits, universe_size, round(odds_ratio, 6) AS odds_ratio, round(p_value, 6) AS p_value,
      round(least(1.0, min(p_value * m / c) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)), 6) AS q_value FROM r"""


@query("vertex_ora", _ora_sql(), ["brand_sets"])
def _(t: Tables) -> DataFrame:
    hits = t.lineitem.where("l_discount >= 0.09 AND l_quantity >= 49 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("member"))
    out = enrichment.vertex_ora(hits, t.brand_sets())
    return out.select("geneset", "k", "set_size", "n_hits", "universe_size", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "p_value", "q_value")])


_EDGES = "u AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), o AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT 'b' || (p_size % 4) AS geneset, p_partkey AS member FROM part)"


def _edges(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    o = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    g = t.part.select(F.concat(F.lit("b"), (F.col("p_size") % 4).cast("string")).alias("geneset"), F.col("p_partkey").alias("member"))
    return o, u, g


@query(
    "edgelist_ora",
    f"""WITH {_EDGES}, x AS (SELECT a.geneset AS source_geneset, b.geneset AS target_geneset, count(*) AS n FROM u JOIN g a ON a.member = src JOIN g b ON b.member = dst GROUP BY 1, 2),
    y AS (SELECT a.geneset AS source_geneset, b.geneset AS target_geneset, count(*) AS n FROM o JOIN g a ON a.member = src JOIN g b ON b.member = dst GROUP BY 1, 2),
    z AS (SELECT source_geneset, target_geneset, coalesce(y.n, 0) AS k, x.n AS bk, (SELECT count(*) FROM o)::DOUBLE AS n, (SELECT count(*) FROM u)::DOUBLE AS bn FROM x LEFT JOIN y USING (source_geneset, target_geneset))
    SELECT source_geneset, target_geneset, k AS n_observed, bk AS n_universe, round(n * bk / bn, 6) AS expected, round((k / (n - k)) / (bk / (bn - bk)), 6) AS odds_ratio,
      round(CASE WHEN k = 0 OR bk = 0 THEN 1.0 ELSE {stats.normal_tail_sql('(k / n - bk / bn) / sqrt(bk / bn * (1 - bk / bn) / n)')} END, 6) AS p_value FROM z""",
)
def _(t: Tables) -> DataFrame:
    o, u, g = _edges(t)
    out = enrichment.edgelist_ora(o, g, u)
    return out.select("source_geneset", "target_geneset", "n_observed", "n_universe", *[F.round(c, 6).alias(c) for c in ("expected", "odds_ratio", "p_value")])


@query(
    "edgelist_ora_binomial",
    f"""WITH {_EDGES}, x AS (SELECT a.geneset AS source_geneset, b.geneset AS target_geneset, count(*) AS n FROM u JOIN g a ON a.member = src JOIN g b ON b.member = dst GROUP BY 1, 2),
    y AS (SELECT a.geneset AS source_geneset, b.geneset AS target_geneset, count(*) AS n FROM o JOIN g a ON a.member = src JOIN g b ON b.member = dst GROUP BY 1, 2),
    z AS (SELECT source_geneset, target_geneset, coalesce(y.n, 0) AS k, x.n AS bk, (SELECT count(*) FROM o) AS n, x.n::DOUBLE / (SELECT count(*) FROM u) AS p FROM x LEFT JOIN y USING (source_geneset, target_geneset)),
    w AS (SELECT *, unnest(range(k, n + 1)) AS i FROM z)
    SELECT source_geneset, target_geneset, any_value(k) AS n_observed, any_value(bk) AS n_universe, round(any_value(n * p), 6) AS expected,
      round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))), 4) AS p_value FROM w GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    o, u, g = _edges(t)
    out = enrichment.edgelist_ora(o, g, u, test="binomial")
    return out.select("source_geneset", "target_geneset", "n_observed", "n_universe", F.round("expected", 6).alias("expected"), F.round("p_value", 4).alias("p_value"))


@query(
    "midrank_quantiles",
    """WITH o AS (SELECT l_partkey AS name, max(l_quantity) AS v FROM lineitem GROUP BY 1), z AS (SELECT l_partkey AS name, l_quantity AS v FROM lineitem)
    SELECT name, CASE WHEN min((z.v::FLOAT = o.v::FLOAT)::INT) = 1 THEN NULL ELSE round(avg(CASE WHEN z.v::FLOAT < o.v::FLOAT THEN 1.0 WHEN z.v::FLOAT = o.v::FLOAT THEN 0.5 ELSE 0.0 END), 6) END AS quantile FROM o JOIN z USING (name) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    z = t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_quantity").alias("value"))
    return stats.midrank_quantile(z.groupBy("name").agg(F.max("value").alias("value")), z, ["name"]).withColumn("quantile", F.round("quantile", 6))


@query("log2_enrichment", "WITH z AS (SELECT l_partkey AS name, avg(l_quantity) AS m, max(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT name, round(log2(v / (m + 1e-10)), 6) AS log2_enrichment FROM z")
def _(t: Tables) -> DataFrame:
    z = t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_quantity").alias("value"))
    return propagation.log2_enrichment(z.groupBy("name").agg(F.max("value").alias("value")), z, ["name"]).withColumn("log2_enrichment", F.round("log2_enrichment", 6))


# --- propagation -----------------------------------------------------------------

STEPS = 4
_PR = """v AS (SELECT n_nationkey AS name, n_regionkey::DOUBLE / (SELECT sum(n_regionkey) FROM nation) AS r FROM nation), o AS (SELECT src, count(*) AS n FROM trade GROUP BY 1), p0 AS (SELECT name, r AS x FROM v)""" + "".join(
    f""", p{k} AS (SELECT v.name, 0.85 * coalesce((SELECT sum(p.x / o.n) FROM trade t JOIN o USING (src) JOIN p{k - 1} p ON p.name = t.src WHERE t.dst = v.name), 0)
      + v.r * (0.15 + 0.85 * coalesce((SELECT sum(x) FROM p{k - 1} WHERE name NOT IN (SELECT src FROM o)), 0)) AS x FROM v)"""
    for k in range(1, STEPS + 1)
)


@query("pagerank_steps", _PR + f" SELECT name, round(x, 9) AS value FROM p{STEPS}", ["trade"])
def _(t: Tables) -> DataFrame:
    vertices = t.nation.select(F.col("n_nationkey").alias("name"))
    resets = t.nation.select(F.lit("region").alias("run"), F.col("n_nationkey").alias("name"), F.col("n_regionkey").cast("double").alias("value"))
    return propagation.pagerank(t.trade(), vertices, resets, iterations=STEPS, tolerance=0.0).select("name", F.round("value", 9).alias("value"))


@query("propagation_with_null")
def _(t: Tables) -> DataFrame:
    vertices = t.nation.select(F.col("n_nationkey").alias("name"))
    attributes = t.nation.select(F.lit("region").alias("attribute"), F.col("n_nationkey").alias("name"), F.col("n_regionkey").cast("double").alias("value"))
    return propagation.with_null(t.trade(), vertices, attributes)


# --- context ---------------------------------------------------------------------


@query(
    "disconnected_reactions",
    """p AS (SELECT DISTINCT r_id, s_id AS member FROM participants WHERE sbo_term IN ('SBO:0000010', 'SBO:0000011')), l AS (SELECT DISTINCT l_partkey AS member, l_suppkey AS sample FROM lineitem),
    x AS (SELECT a.r_id, a.member AS a, b.member AS b FROM p a JOIN p b ON a.r_id = b.r_id AND a.member < b.member),
    t AS (SELECT a, b FROM x JOIN l m ON m.member = a JOIN l n ON n.member = b AND m.sample = n.sample GROUP BY 1, 2, x.r_id HAVING count(*) > 5)
    SELECT DISTINCT r_id FROM x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = x.a AND t.b = x.b)""",
    ["participants"],
)
def _(t: Tables) -> DataFrame:
    p = t.participants().where(F.col("sbo_term").isin("SBO:0000010", "SBO:0000011")).select("r_id", F.col("s_id").alias("member"))
    return context.disconnected_reactions(p, t.lineitem.select(F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("sample")), 5)


@query("attribute_filter", "SELECT p_partkey FROM part WHERE NULLIF(p_brand, 'Brand#11') IS NOT NULL AND p_brand NOT IN ('Brand#12', 'Brand#23')")
def _(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("kind"))
    return context.matching_attribute(df, "kind", ["Brand#12", "Brand#23"], negate=True).select("p_partkey")


@query("zfpkm")
def _(t: Tables) -> DataFrame:
    return context.zfpkm(t.lineitem.select(F.col("l_suppkey").alias("sample"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("gene"), F.col("l_extendedprice").alias("value")))


# --- source-specific steps -------------------------------------------------------


@query(
    "signed_pairs",
    """WITH x AS (SELECT l_partkey AS src, l_suppkey AS dst, bool_or(l_returnflag = 'A') AS u, bool_or(l_returnflag = 'R') AS d, list(l_shipdate::DATE::VARCHAR) AS r FROM lineitem GROUP BY 1, 2)
    SELECT src, dst, CASE WHEN u AND d THEN 'modifier' WHEN u THEN 'stimulator' WHEN d THEN 'inhibitor' ELSE 'modifier' END AS role, array_to_string(list_sort(list_distinct(r)), ';') AS reference FROM x""",
)
def _(t: Tables) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "A", "Activation").when(F.col("l_returnflag") == "R", "Repression").otherwise("Unknown")
    return transforms.signed_pairs(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), sign.alias("sign"), F.to_date("l_shipdate").cast("string").alias("reference")))


@query(
    "earliest_pairs",
    """WITH x AS (SELECT l_partkey AS src, l_suppkey AS dst, l_linenumber AS t, l_discount - 0.05 AS v FROM lineitem)
    SELECT src, dst, min(t) AS t_rise, round(arg_min(v, (t, v)), 6) AS v_inter, CASE WHEN bool_and(v > 0) THEN 'stimulator' WHEN bool_and(v < 0) THEN 'inhibitor' ELSE 'modifier' END AS role FROM x GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("t_rise"), (F.col("l_discount") - 0.05).alias("v_inter"))
    return transforms.earliest_pairs(rows).withColumn("v_inter", F.round("v_inter", 6))


@query("unique_names", "WITH x AS (SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type, p_size) AS n, p_type || p_size AS name FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN p_partkey || ' ' || name ELSE name END AS name FROM x")
def _(t: Tables) -> DataFrame:
    return transforms.unique_names(t.part.select("p_partkey", F.concat(F.col("p_type"), F.col("p_size").cast("string")).alias("name")), "p_partkey", "name")


@query("annotation_rows", "SELECT event_id, unnest(['k', 'type']) AS name, unnest([regexp_extract(props, '([0-9]+)', 1), event_type]) AS value FROM events")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("k: "), F.regexp_extract("props", "([0-9]+)", 1), F.lit(" ;type:"), F.col("event_type"), F.lit(";"))
    return transforms.annotation_rows(t.events.select("event_id", text.alias("annotation")), "event_id", "annotation")


@query(
    "mi_scores",
    """WITH c AS (SELECT l_partkey AS pair, l_returnflag AS term, CASE l_returnflag WHEN 'A' THEN 0.33 WHEN 'R' THEN 0.66 ELSE 1.0 END::DOUBLE AS score, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT pair, sum(score * n) AS a, sum(score * n) + sum(n) AS b FROM c GROUP BY 1), p AS (SELECT l_partkey AS pair, count(DISTINCT l_orderkey) AS m FROM lineitem GROUP BY 1)
    SELECT pair, round(CASE WHEN m >= 7 THEN 1.0 ELSE ln(m + 1) / ln(8) END, 6) AS publication_score, round(ln(a + 1) / ln(b + 1), 6) AS method_score, 0.0::DOUBLE AS type_score,
      round((CASE WHEN m >= 7 THEN 1.0 ELSE ln(m + 1) / ln(8) END + ln(a + 1) / ln(b + 1)) / 3, 6) AS mi_score FROM s JOIN p USING (pair)""",
)
def _(t: Tables) -> DataFrame:
    score = S.mapped(F.col("l_returnflag"), {"A": 0.33, "R": 0.66}, 1.0)
    rows = t.lineitem.select(F.col("l_partkey").alias("pair"), F.col("l_orderkey").alias("study"), F.lit("method").alias("attribute"), F.col("l_returnflag").alias("term"), score.alias("score"))
    counts = transforms.study_counts(rows)
    out = transforms.mi_score(counts, rows.groupBy("pair").agg(F.countDistinct("study").alias("n_publications")))
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("publication_score", "method_score", "type_score", "mi_score")])


@query(
    "perturbation_directions",
    """WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'knockdown' WHEN 1 THEN 'overexpression' ELSE 'other' END AS k, value - 50 AS v FROM events)
    SELECT event_id, CASE WHEN abs(v) < 5 THEN 'weak' WHEN k = 'other' THEN 'ambiguous' WHEN (k = 'knockdown') = (v > 0) THEN 'inhibition' ELSE 'activation' END AS direction FROM x""",
)
def _(t: Tables) -> DataFrame:
    kind = S.mapped(F.col("event_id") % 3, {0: "knockdown", 1: "overexpression"}, "other")
    return t.events.select("event_id", transforms.perturbation_direction(kind, F.col("value") - 50, F.lit(5.0)).alias("direction"))


@query("strongest_effects", "SELECT user_id, event_type, round(arg_max(value - 50, (abs(value - 50), value - 50)), 6) AS v, count(*) AS n_measurements FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return transforms.strongest(t.events.select("user_id", "event_type", (F.col("value") - 50).alias("v")), ["user_id", "event_type"], "v").withColumn("v", F.round("v", 6))


@query("presence_table", """SELECT l_orderkey, max((l_returnflag = 'A')::INT)::INTEGER AS "A", max((l_returnflag = 'N')::INT)::INTEGER AS "N", max((l_returnflag = 'R')::INT)::INTEGER AS "R" FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_set("l_returnflag"), "; ").alias("flags"))
    return transforms.presence_table(lists, "l_orderkey", "flags", ["A", "N", "R"])


@query("wide_to_long", "SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_name', NULL FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(t: Tables) -> DataFrame:
    wide = transforms.numeric_columns(t.part.select("p_partkey", "p_size", "p_name", "p_retailprice"), ["p_partkey"])
    return transforms.wide_to_long(wide, ["p_partkey"], "name", "value")


@query("model_from_edges", """WITH e AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part), n AS (SELECT a AS s FROM e UNION SELECT b FROM e) SELECT 'compartmentalized_species' AS "table", (SELECT count(*) FROM n) AS n_rows UNION ALL SELECT 'compartments', 1 UNION ALL SELECT 'reaction_species', (SELECT 2 * count(*) FROM e) UNION ALL SELECT 'reactions', (SELECT count(*) FROM e) UNION ALL SELECT 'species', (SELECT count(*) FROM n)""")
def _(t: Tables) -> DataFrame:
    from ..operators.summaries import profile

    e = t.part.select(F.col("p_brand").alias("name_upstream"), F.col("p_type").alias("name_downstream")).distinct().withColumn("r_name", F.concat_ws(" -- ", "name_upstream", "name_downstream"))
    s = t.part.select(F.col("p_brand").alias("s_name")).union(t.part.select("p_type")).distinct()
    c = t.spark.createDataFrame([("cellular_component",)], "c_name string")
    return profile(transforms.model_from_edgelist(e, s, c))


# --- text and vectors ------------------------------------------------------------


@query("exact_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot')")
def _(t: Tables) -> DataFrame:
    return search.exact(t.documents, "Idiot").select("doc_id")


@query(
    "snippets",
    """WITH x AS (SELECT item_id, text, instr(lower(text), 'the') AS a FROM benchmark), y AS (SELECT *, greatest(1, a - 20) AS s, least(length(text), a + 2 + 20) AS e FROM x)
    SELECT item_id, CASE WHEN a = 0 THEN text[:40] || CASE WHEN length(text) > 40 THEN '...' ELSE '' END ELSE CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END END AS snippet FROM y""",
)
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", S.snippet(F.col("text"), F.lit("The"), 20).alias("snippet"))


@query("document_chunks")
def _(t: Tables) -> DataFrame:
    return search.chunks(t.documents.select("doc_id", "text"))


@query(
    "cosine_nearest",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    x AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))) AS s FROM embeddings, q WHERE vec_id <> query_id)
    SELECT query_id, vec_id, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS r FROM x) WHERE r <= 3""",
)
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "embedding")
    return search.nearest(e, e.where("vec_id % 20 = 0"), 3).withColumn("score", F.round("score", 6))


# --- time ------------------------------------------------------------------------


@query(
    "sliding_quota",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_hour,
    count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_day FROM events""",
)
def _(t: Tables) -> DataFrame:
    return quota.sliding_counts(t.events).select("event_id", "n_hour", "n_day")


@query("daily_cost", "SELECT ts::DATE AS day, count(*) AS n, round(sum(value * 3.0 + event_id % 100 * 15.0) / 1000000, 6) AS cost FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return quota.daily_cost(t.events, quota.cost(F.col("value"), F.col("event_id") % 100)).withColumn("cost", F.round("cost", 6))


@query(
    "user_sessions",
    """WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x) SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM y GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return quota.sessions(t.events)


@query("tumbling_counts", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    out = quota.windowed_counts(t.events)  # the plan of the stream, over the table at rest
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query("streamed_counts")
def _(t: Tables) -> DataFrame:
    """The same plan run as a stream over the table's file, written once and read back."""
    import uuid

    schema = t.events.schema
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    quota.run_available(quota.windowed_counts(stream), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out")
