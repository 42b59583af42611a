"""Occurrence and co-occurrence tables, degrees and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocabulary as V

REACTANT, PRODUCT, INTERACTOR = V.ROLE_CODES["reactant"], V.ROLE_CODES["product"], V.ROLE_CODES["interactor"]


def cspecies_features(participants: DataFrame, cspecies: DataFrame) -> DataFrame:
    """sc_degree, sc_children (it is consumed or acts) and sc_parents (it is made) of every
    compartmentalized species; 0 without reactions."""
    s = F.col("stoichiometry")
    counted = participants.groupBy("sc_id").agg(
        F.count(F.lit(1)).alias("sc_degree"), F.count_if(s <= 0).alias("sc_children"), F.count_if(s > 0).alias("sc_parents")
    )
    return cspecies.join(counted, "sc_id", "left").na.fill(0, ["sc_degree", "sc_children", "sc_parents"])


def occurrence(long: DataFrame, key: str, column: str, values: list[str] | None = None, binarise: bool = False) -> DataFrame:
    """Key by value counts (or 0/1), a column for each value.  ``values`` names the columns;
    without it they are looked up, which is for vocabularies of a bounded size."""
    pivoted = long.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key)
    out = (pivoted.pivot(column, values) if values else pivoted.pivot(column)).count().na.fill(0)
    if binarise:
        out = out.select(key, *[F.least(F.col(f"`{c}`"), F.lit(1)).alias(c) for c in out.columns if c != key])
    return out


def cooccurrence(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """How many keys have both an ``a`` of the left and a ``b`` of the right, long: (a, b, n).

    Per key both sides are small sets of a bounded vocabulary; they meet as arrays inside a
    row, so that a key's pairs are made from its two sets without a join of its rows."""
    sets_a = left.where(F.col(key).isNotNull() & F.col(a).isNotNull()).groupBy(key).agg(F.collect_set(a).alias("__a"))
    if left is right and a == b:
        sets = sets_a.withColumn("__b", F.col("__a"))
    else:
        sets_b = right.where(F.col(key).isNotNull() & F.col(b).isNotNull()).groupBy(key).agg(F.collect_set(b).alias("__b"))
        sets = sets_a.join(sets_b, key)
    return sets.select(F.explode("__a").alias("a"), "__b").select("a", F.explode("__b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def with_other(long: DataFrame, entities: DataFrame, key: str, column: str, other: str = "other") -> DataFrame:
    """(key, column) rows, and ``other`` for every entity that has none."""
    rows = long.where(F.col(column).isNotNull()).select(key, column)
    missing = entities.select(key).distinct().join(rows, key, "left_anti").select(key, F.lit(other).alias(column))
    return rows.unionByName(missing)


def add_missing_ids(table: DataFrame, entities: DataFrame, key: str, other: str = "other") -> DataFrame:
    """A wide table with a row for every entity: zeros, and 1 in ``other``, if it had none."""
    columns = [c for c in table.columns if c != key]
    missing = entities.select(key).distinct().join(table, key, "left_anti")
    zeros = missing.select(key, *[F.lit(0).cast("long").alias(c) for c in columns], F.lit(1).cast("long").alias(other))
    return table.select(key, *[F.col(f"`{c}`").cast("long").alias(c) for c in columns], F.lit(0).cast("long").alias(other)).unionByName(zeros)


def non_interactor_reactions(participants: DataFrame) -> DataFrame:
    """Reactions with a participant that isn't just an interactor."""
    return participants.where(F.col("sbo_term") != INTERACTOR).select("r_id").distinct()


def role_occurrence(participants: DataFrame, names: bool = True, with_interactors: bool = False) -> DataFrame:
    """Reaction by role counts; reactions of interactors only are left out by default."""
    if not with_interactors:
        participants = participants.join(non_interactor_reactions(participants), "r_id", "left_semi")
    out = occurrence(participants, "r_id", "sbo_term", sorted(V.ROLE_NAMES))
    return out.withColumnsRenamed(V.ROLE_NAMES) if names else out


def total_counts(long: DataFrame, column: str) -> DataFrame:
    return long.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("total_counts"))


def identical_members(long: DataFrame, group: str, member: str) -> DataFrame:
    """Groups with the same members as one row: a digest of the members, how many they are,
    and the groups."""
    sets = long.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy(F.sha2(F.to_json("members"), 256).alias("membership"), F.size("members").cast("long").alias("n_members")).agg(F.array_join(F.array_sort(F.collect_list(F.col(group).cast("string"))), " OR ").alias("groups"), F.count(F.lit(1)).alias("n_groups"))


def collapse(long: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: distinct values of each column, sorted and joined, and the number of
    rows."""
    joined = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), " OR ").alias(c) for c in columns]
    return long.groupBy(*keys).agg(*joined, F.count(F.lit(1)).alias("n_collapsed"))


def set_cover(members: DataFrame, group: str, member: str, least: int = 3, totals: DataFrame | None = None, n_entities: int | None = None) -> DataFrame:
    """Greedy set cover: the group with most uncovered members (or, given the groups' total
    counts, the highest odds ratio) is taken, its members are covered, until no group has
    ``least`` uncovered members.  Returns (step, group, n_covered).  Ties go to the name.

    A step is an aggregation and an anti join; only the name taken comes to the driver."""
    from ..functions.stats import fisher
    from ..runtime import drop, materialise

    spark = members.sparkSession
    left = materialise(members.select(group, member).where(F.col(group).isNotNull()).distinct(), "cover")
    taken = []
    while True:
        counts = left.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        if totals is None:
            best = counts.orderBy(F.desc("n"), group).limit(1).collect()
        else:
            seen = left.select(member).distinct().count()
            odds = counts.join(totals, group)
            a, b = F.col("n"), F.col("total_counts") - F.col("n")
            c = F.lit(seen) - a
            odds = odds.withColumn("o", fisher(a, b, c, F.lit(n_entities) - c - b - a)[0])
            best = odds.orderBy(F.desc("o"), group).limit(1).collect()
        if not best:
            break
        name = best[0][group]
        taken.append((len(taken), name, best[0]["n"]))
        covered = left.where(F.col(group) == F.lit(name)).select(member)
        rest = materialise(left.join(covered, member, "left_anti"), "cover")
        drop(left)
        left = rest
    drop(left)
    kind = dict(members.dtypes)[group]
    return spark.createDataFrame(taken, f"step long, {group} {kind}, n_covered long")


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of a model's tables."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


# --- identifiers -----------------------------------------------------------------


def explode_identifiers(entities: DataFrame, key: str, column: str = "identifiers") -> DataFrame:
    """A row for each identifier, with its place (``entry``)."""
    return entities.select(key, F.posexplode(column).alias("entry", "x")).select(key, "entry", "x.*")


def best_identifier(identifiers: DataFrame, keys: list[str]) -> DataFrame:
    """The best row per key: best qualifier, then one with an address, then the smallest."""
    from ..functions.scalars import mapped

    rank = mapped(F.col("bqb"), V.QUALIFIER_RANK, 99)
    w = Window.partitionBy(*keys).orderBy(rank, F.col("url").isNull(), "ontology", "identifier")
    return identifiers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def characteristic(identifiers: DataFrame, max_complex: int = 4, max_promiscuity: int = 20, defining: tuple[str, ...] = V.DEFINING) -> DataFrame:
    """Identifiers that say what a species is: those with defining qualifiers, and the parts of
    small complexes unless they are part of very many."""
    own = identifiers.where(F.col("bqb").isin(*defining))
    parts = identifiers.where(F.col("bqb") == "BQB_HAS_PART")
    small = parts.groupBy("s_id", "ontology").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_complex).select("s_id", "ontology")
    wide = parts.select("s_id", "ontology", "identifier").distinct().groupBy("ontology", "identifier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_promiscuity).select("ontology", "identifier")
    kept = parts.join(small, ["s_id", "ontology"], "left_semi").join(wide, ["ontology", "identifier"], "left_anti")
    return own.unionByName(kept.select(*own.columns))
