"""Merging models: entity resolution by shared identifiers or equal members."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocabulary as V
from ..functions import scalars as S
from ..runtime import materialise
from .traverse import components


def stack(models: dict[str, DataFrame]) -> DataFrame:
    """One table of all models under each other, with the model's name."""
    out = None
    for name, df in sorted(models.items()):
        part = df.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cluster_by_identifiers(entities: DataFrame, key: str, qualifiers: tuple[str, ...] = V.DEFINING) -> DataFrame:
    """(model, key, cluster): entities that share a defining identifier, directly or through
    others, are one cluster; an entity without any is a cluster of its own."""
    token = F.concat_ws("\u0001", F.lit("e"), "model", F.col(key).cast("string"))
    ids = entities.select("model", key, F.explode("identifiers").alias("x")).where(F.col("x.bqb").isin(*qualifiers))
    edges = ids.select(token.alias("src"), F.concat_ws("\u0001", F.lit("i"), "x.ontology", "x.identifier").alias("dst")).distinct()
    found = components(edges)
    own = entities.select("model", key, token.alias("name")).distinct()
    return own.join(found, "name", "left").select("model", key, F.coalesce("component", "name").alias("cluster"))


def number_clusters(lookup: DataFrame, prefix: str, column: str = "cluster") -> DataFrame:
    """Dense ids for clusters, in the order of their names: numbers inside range partitions,
    shifted by the sizes of the partitions before."""
    names = lookup.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = materialise(names.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "clusters")
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"), F.min("__i").alias("f"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = placed.join(F.broadcast(sizes.select("__p", "f", before.alias("b"))), "__p").select(column, S.entity_id(F.col("__i") - F.col("f") + F.col("b"), prefix).alias("new_id"))
    return lookup.join(ids, column)


def best_named(rows: DataFrame, cluster: str, name: str, columns: list[str]) -> DataFrame:
    """One row per cluster: that of the best name (least nameness score, then the name, model
    and key)."""
    order = F.struct(S.nameness(F.col(name)).alias("score"), F.col(name).alias("name"), *[F.col(c) for c in columns if c != name])
    return rows.groupBy(cluster).agg(F.min_by(F.struct(name, *[c for c in columns if c != name]), order).alias("x")).select(cluster, "x.*")


def merged_identifiers(rows: DataFrame, cluster: str) -> DataFrame:
    """All identifiers of a cluster, once each, in order."""
    x = rows.select(cluster, F.explode_outer("identifiers").alias("x"))
    return x.groupBy(cluster).agg(F.array_sort(F.collect_set("x")).alias("identifiers"))


def member_strings(members: DataFrame, key: list[str], token: Column) -> DataFrame:
    """What an entity is made of: its distinct member tokens, sorted, as a digest."""
    return members.groupBy(*key).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(token))), 256).alias("cluster"))


def update_keys(table: DataFrame, lookup: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """``table`` (model, key) with the merged key; an error if a key is in one of both only."""
    if strict:
        pairs = table.select("model", key).distinct()
        if not pairs.join(lookup, ["model", key], "left_anti").isEmpty():
            raise ValueError(f"{key} without an entry in the lookup")
        if not lookup.join(pairs, ["model", key], "left_anti").isEmpty():
            raise ValueError(f"{key} of the lookup that no row has")
    return table.join(lookup.select("model", key, F.col("new_id").alias("__new")), ["model", key]).drop(key).withColumnRenamed("__new", key)


def merge_reversibility(reactions: DataFrame, lookup: DataFrame) -> DataFrame:
    """A merged reaction is reversible if one of its reactions is."""
    return reactions.join(lookup, ["model", "r_id"]).groupBy("new_id").agg(F.bool_or("r_isreversible").alias("r_isreversible"))


def merge_entity_data(data: DataFrame, lookup: DataFrame, key: str, order: str = "row") -> DataFrame:
    """Side tables of several models by merged key: the first value in the order of the row
    numbers read as text, for numbers and booleans; distinct values in one field for strings."""
    from pyspark.sql import types as T

    j = data.join(lookup.select("model", key, "new_id"), ["model", key])
    out = []
    for f in data.schema.fields:
        if f.name in ("model", key, order):
            continue
        if isinstance(f.dataType, T.StringType):
            out.append(F.array_join(F.array_sort(F.collect_set(f.name)), ",").alias(f.name))
        else:
            out.append(F.min_by(f.name, F.when(F.col(f.name).isNotNull(), F.col(order).cast("string"))).alias(f.name))
    return j.groupBy("new_id").agg(*out)


def differing_values(data: DataFrame, key: str) -> DataFrame:
    """(column, key) with more than one value: what a merge has to choose from."""
    columns = [c for c in data.columns if c not in (key, "model")]
    counts = data.groupBy(key).agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counts.unpivot([key], columns, "column", "n").where("n > 1")


@dataclass
class Model:
    """The five tables of a pathway model; ``model`` tells stacked ones apart."""

    compartments: DataFrame
    species: DataFrame
    cspecies: DataFrame
    reactions: DataFrame
    participants: DataFrame


def merge_models(models: dict[str, Model], qualifiers: tuple[str, ...] = V.DEFINING) -> Model:
    """Merge models in five steps: compartments and species by shared identifiers, then their
    combinations by keys, reactions by equal participants, participants by keys."""
    compartments = stack({n: m.compartments for n, m in models.items()})
    species = stack({n: m.species for n, m in models.items()})
    cspecies = stack({n: m.cspecies for n, m in models.items()})
    reactions = stack({n: m.reactions for n, m in models.items()})
    participants = stack({n: m.participants for n, m in models.items()})
    c_look = materialise(number_clusters(cluster_by_identifiers(compartments, "c_id", qualifiers), "C"), "c-look")
    s_look = materialise(number_clusters(cluster_by_identifiers(species, "s_id", qualifiers), "S"), "s-look")

    def entities(rows: DataFrame, look: DataFrame, key: str, name: str) -> DataFrame:
        j = rows.join(look.select("model", key, "new_id"), ["model", key])
        return best_named(j, "new_id", name, [name, "model"]).drop("model").join(merged_identifiers(j, "new_id"), "new_id").withColumnRenamed("new_id", key)

    sc = update_keys(update_keys(cspecies, c_look, "c_id", False), s_look, "s_id", False)
    sc_look = sc.select("model", "sc_id", F.concat_ws("__", "s_id", "c_id").alias("cluster"))
    sc_look = materialise(number_clusters(sc_look, "SC"), "sc-look")
    merged_sc = best_named(sc.join(sc_look.select("model", "sc_id", "new_id"), ["model", "sc_id"]), "new_id", "sc_name", ["sc_name", "s_id", "c_id", "model"]).drop("model").withColumnRenamed("new_id", "sc_id")
    p = participants.join(sc_look.select("model", "sc_id", F.col("new_id").alias("__sc")), ["model", "sc_id"]).drop("sc_id").withColumnRenamed("__sc", "sc_id")
    token = F.concat_ws("__", "sc_id", F.format_number(F.col("stoichiometry").cast("double"), 6), "sbo_term")
    r_look = materialise(number_clusters(member_strings(p, ["model", "r_id"], token), "R"), "r-look")
    merged_r = best_named(reactions.join(r_look.select("model", "r_id", "new_id"), ["model", "r_id"]), "new_id", "r_name", ["r_name", "model"]).drop("model")
    merged_r = merged_r.join(merge_reversibility(reactions, r_look), "new_id").withColumnRenamed("new_id", "r_id")
    merged_p = p.join(r_look.select("model", "r_id", F.col("new_id").alias("__r")), ["model", "r_id"]).select(F.col("__r").alias("r_id"), "sc_id", "stoichiometry", "sbo_term").distinct()
    return Model(entities(compartments, c_look, "c_id", "c_name"), entities(species, s_look, "s_id", "s_name"), merged_sc, merged_r, merged_p)


def uncompartmentalise(model: Model) -> Model:
    """One compartment for all: a form per species, participants by these, net stoichiometries
    of 0 and reactions without participants left out, equal reactions merged."""
    from .integrity import trivial_participants

    spark = model.species.sparkSession
    compartments = spark.createDataFrame([("C00000000", "cellular_component")], "c_id string, c_name string")
    forms = model.species.select("s_id", F.col("s_name").alias("sc_name"), F.concat(F.lit("SC"), F.col("s_id").cast("string")).alias("sc_id"), F.lit("C00000000").alias("c_id"))
    look = model.cspecies.select(F.col("sc_id").alias("old"), "s_id").join(forms.select("s_id", "sc_id"), "s_id").select("old", "sc_id")
    p = model.participants.withColumnRenamed("sc_id", "old").join(look, "old").groupBy("r_id", "sc_id", "sbo_term").agg(F.sum("stoichiometry").alias("stoichiometry"))
    moving = p.where("stoichiometry <> 0")
    p = p.join(trivial_participants(moving), ["r_id", "sc_id"], "left_anti")
    p = materialise(p, "uncompartmentalised")
    token = F.concat_ws("__", "sc_id", F.format_number(F.col("stoichiometry").cast("double"), 6), "sbo_term")
    rows = p.withColumn("model", F.lit("one"))
    look = materialise(number_clusters(member_strings(rows, ["model", "r_id"], token), "R"), "r-look")
    kept = model.reactions.withColumn("model", F.lit("one"))
    reactions = best_named(kept.join(look.select("model", "r_id", "new_id"), ["model", "r_id"]), "new_id", "r_name", ["r_name", "model"]).drop("model").join(merge_reversibility(kept, look), "new_id").withColumnRenamed("new_id", "r_id")
    merged = rows.join(look.select("model", "r_id", "new_id"), ["model", "r_id"]).select(F.col("new_id").alias("r_id"), "sc_id", "stoichiometry", "sbo_term").distinct()
    return Model(compartments, model.species, forms.select("sc_id", "sc_name", "s_id", "c_id"), reactions, merged)


def unconnected_models(entities: DataFrame) -> DataFrame:
    """component, models, ontologies: more than one row says that some models share no
    ontology, directly or through others, so that merging them can't match anything."""
    rows = entities.select("model", F.explode("identifiers").alias("x")).select("model", "x.ontology").distinct()
    found = components(rows.select(F.concat(F.lit("m "), "model").alias("src"), F.concat(F.lit("o "), "ontology").alias("dst")))

    def part(prefix: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("name").startswith(prefix), F.substr("name", F.lit(3)))))

    return found.groupBy("component").agg(part("m ").alias("models"), part("o ").alias("ontologies")).drop("component")
