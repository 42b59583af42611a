"""Over-representation of sets among vertices and of set pairs among edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def bounded_sets(sets: DataFrame, universe: DataFrame | None, least: int, most: int | None) -> DataFrame:
    """(geneset, member) within the universe, of sets with a number of members in bounds."""
    rows = sets.select("geneset", "member").distinct()
    if universe is not None:
        rows = rows.join(universe.select("member").distinct(), "member", "left_semi")
    size = rows.groupBy("geneset").agg(F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") >= least) & (F.col("n") <= most if most is not None else F.lit(True))
    return rows.join(size.where(ok).select("geneset"), "geneset", "left_semi")


def vertex_ora(hits: DataFrame, sets: DataFrame, universe: DataFrame | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """geneset, k (hits in it), set_size, n_hits, universe_size, odds_ratio, p_value, q_value;
    without a universe, that is the union of the sets."""
    universe = (universe if universe is not None else sets).select("member").distinct()
    rows = bounded_sets(sets, universe, least, most)
    found = hits.select("member").distinct().join(universe, "member", "left_semi").withColumn("hit", F.lit(1))
    per = rows.join(found, "member", "left").groupBy("geneset").agg(F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("k"), F.count(F.lit(1)).alias("set_size"))
    total = universe.agg(F.count(F.lit(1)).alias("universe_size")).withColumn("__k", F.lit(1))
    count = found.agg(F.count(F.lit(1)).alias("n_hits")).withColumn("__k", F.lit(1))
    one = total.join(count, "__k")
    j = per.withColumn("__k", F.lit(1)).join(F.broadcast(one), "__k").drop("__k")
    a, b = F.col("k"), F.col("set_size") - F.col("k")
    c = F.col("n_hits") - F.col("k")
    odds, p = stats.fisher(a, b, c, F.col("universe_size") - a - b - c)
    out = j.select("geneset", "k", "set_size", "n_hits", "universe_size", odds.alias("odds_ratio"), p.alias("p_value"))
    return stats.benjamini_hochberg(out, "p_value")


def pair_counts(edges: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """How many edges go from a member of one set to a member of another."""
    a = sets.select(F.col("geneset").alias("source_geneset"), F.col("member").alias("src"))
    b = sets.select(F.col("geneset").alias("target_geneset"), F.col("member").alias("dst"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy("source_geneset", "target_geneset").agg(F.count(F.lit(1)).alias(name))


def edgelist_ora(edges: DataFrame, sets: DataFrame, universe: DataFrame, test: str = "proportion", directed: bool = True, least_possible: int = 1) -> DataFrame:
    """Set pairs with as many observed edges between them as n_observed, of n_universe that the
    universe has, tested by ``fisher``, ``proportion`` or ``binomial``.

    Undirected, an observed edge counts in both directions, the universe's edges in the one
    that they are stored in, and a pair once (source <= target).  Pairs come from the counts,
    which hold every pair that the universe makes possible."""
    observed = edges.select("src", "dst")
    if not directed:
        observed = observed.unionByName(observed.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen, possible = pair_counts(observed, sets, "n_observed"), pair_counts(universe, sets, "n_universe")
    pairs = possible.join(seen, ["source_geneset", "target_geneset"], "left").na.fill(0, ["n_observed"])
    if not directed:
        pairs = pairs.where("source_geneset <= target_geneset")
    totals = observed.agg(F.count(F.lit(1)).alias("n_edges")).withColumn("__k", F.lit(1)).join(universe.agg(F.count(F.lit(1)).alias("n_all")).withColumn("__k", F.lit(1)), "__k")
    j = pairs.where(F.col("n_universe") >= least_possible).withColumn("__k", F.lit(1)).join(F.broadcast(totals), "__k").drop("__k")
    k, n, big_k, big_n = F.col("n_observed"), F.col("n_edges"), F.col("n_universe"), F.col("n_all")
    if test == "fisher":
        odds, p = stats.fisher(k, big_k - k, n - k, big_n - n - big_k + k)
        j = j.withColumn("odds_ratio", odds).withColumn("p_value", p)
    elif test == "proportion":
        expected, odds, p = stats.proportion(k, n, big_k, big_n)
        j = j.withColumn("expected", expected).withColumn("odds_ratio", odds).withColumn("p_value", p)
    elif test == "binomial":
        share = big_k / big_n
        j = j.withColumn("expected", n * share).withColumn("p_value", stats.binomial(k, n, share))
    else:
        raise ValueError(f"unknown test {test!r}")
    return stats.benjamini_hochberg(j, "p_value")
