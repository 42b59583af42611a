"""What is made of results: labelled paths, gene sets of species, melted metrics, reports, and
hand-made changes to a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from ..functions import scalars as S
from ..runtime import small_or_shuffled

#: Primary key to the entity that has it.
KEYS = {"rsc_id": "reaction_species", "sc_id": "compartmentalized_species", "r_id": "reactions", "s_id": "species", "c_id": "compartments"}


# --- columns ---------------------------------------------------------------------


def entity_type(columns: list[str]) -> str:
    """The entity whose table has these columns: that of the one primary key, or, as foreign
    keys are primary keys elsewhere, of the first in the order participants, forms, reactions,
    species, compartments."""
    for key, entity in KEYS.items():
        if key in columns:
            return entity
    raise ValueError(f"no primary key among {columns}")


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats."""
    return df.select(*[F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def without_attributes(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns; an error if one isn't there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such attributes: {missing}")
    return df.drop(*names)


def wrapped(text: Column, width: int) -> Column:
    """Text with line ends instead of the white space at which a line would pass ``width``
    characters; longer words stand alone."""
    space = F.lit(" ")

    def add(state: Column, word: Column) -> Column:
        longer = state["used"] + 1 + F.length(word)
        fits = (state["text"] != "") & (longer <= width)
        joined = F.when(state["text"] == "", word).when(fits, F.concat(state["text"], space, word)).otherwise(F.concat(state["text"], F.lit("\n"), word))
        return F.struct(joined.alias("text"), F.when(fits, longer).otherwise(F.length(word)).alias("used"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.struct(F.lit("").alias("text"), F.lit(0).alias("used")), add)["text"]


def melted(wide: DataFrame, key: str, metric: str = "metric", attribute: str = "attribute", sep: str = "::") -> DataFrame:
    """Columns named ``attribute::metric`` as rows (key, attribute, metric, value)."""
    long = wide.unpivot([key], [c for c in wide.columns if c != key], "__name", "value")
    parts = F.split("__name", sep)
    return long.select(key, parts[0].alias(attribute), parts[1].alias(metric), "value")


# --- identifiers, sets, paths ----------------------------------------------------


def cspecies_identifiers(identifiers: DataFrame, cspecies: DataFrame) -> DataFrame:
    """Identifiers of species by their compartmentalized forms; an error if a species with
    identifiers has none."""
    rows = identifiers.join(cspecies.select("s_id", "sc_id").distinct(), "s_id", "left")
    if not rows.where("sc_id IS NULL").isEmpty():
        raise ValueError("species without a compartmentalized form")
    return rows


def sets_of_species(sets: DataFrame, identifiers: DataFrame, ontology: str, qualifiers: tuple[str, ...] = V.DEFINING) -> DataFrame:
    """(geneset, s_id): sets of identifiers (``member``) as sets of species, each once."""
    known = identifiers.where((F.col("ontology") == ontology) & F.col("bqb").isin(*qualifiers)).select(F.col("identifier").alias("member"), "s_id")
    # a member counts once in a set, before its species multiply it
    wanted = sets.select("geneset", "member").distinct()
    return small_or_shuffled(wanted).join(known, "member").select("geneset", "s_id").distinct()


def path_attributes(steps: DataFrame, weight: str = "weight") -> DataFrame:
    """path, n_steps, the sum of the weights and the polarity that the last step ends with.
    ``steps``: path, step, the weight and net_polarity."""
    return steps.groupBy("path").agg(F.count(F.lit(1)).alias("n_steps"), F.sum(weight).alias("path_weight"), F.max_by("net_polarity", "step").alias("net_polarity"))


def labelled_paths(nodes: DataFrame, reactions: DataFrame, urls: DataFrame) -> DataFrame:
    """Nodes of paths (path, step, node) that are reactions, with name, formula and address."""
    named = nodes.withColumnRenamed("node", "r_id").join(reactions.select("r_id", "r_name", "formula"), "r_id")
    return named.join(urls.select("r_id", "url"), "r_id", "left")


def connected_neighbourhood(vertices: DataFrame, edges: DataFrame, focal: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (name, weight) without those of weight 0 other than the focal one, and the
    edges between what is left."""
    kept = vertices.where((F.col("weight") != 0) | (F.col("name") == F.lit(focal)))
    names = kept.select("name")
    e = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return kept, e


def minimal_sources(vertices: DataFrame, participants: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """The fewest sources (greedily) that cover the reactions among the vertices (``name``), or
    that these take part in."""
    from .summaries import set_cover

    own = vertices.select(F.col("name").alias("r_id")).join(sources.select("r_id").distinct(), "r_id", "left_semi")
    through = participants.join(vertices.select(F.col("name").alias("sc_id")), "sc_id", "left_semi").select("r_id")
    reactions = own.union(through).distinct()
    return set_cover(sources.join(reactions, "r_id", "left_semi"), "pathway_id", "r_id", least)


def by_modality(results: DataFrame, members: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Result rows split by the modality that their feature is in; an error for features of
    none."""
    out = {m: results.join(df.select(key).distinct(), key, "left_semi") for m, df in members.items()}
    known = reduce(DataFrame.union, [df.select(key) for df in members.values()]).distinct()
    if not results.join(known, key, "left_anti").isEmpty():
        raise ValueError("features that no modality has")
    return out


def vertex_summaries(vertices: DataFrame, tables: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """Counts of several tables (``name`` and columns) side by side for every vertex, the
    columns with the table's name before them, 0 where there is nothing."""
    out = vertices.select(key).distinct()
    for name, df in tables.items():
        columns = [c for c in df.columns if c != key]
        out = out.join(df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in columns]), key, "left")
    return out.na.fill(0)


# --- merges and hand-made changes ------------------------------------------------


def merge_report(lookup: DataFrame, names: DataFrame, key: str, name: str, most: int = 3) -> DataFrame:
    """new_id, n_merged and up to ``most`` names (the first in order) of what was merged from
    several entities, the largest merges first."""
    rows = lookup.join(names.select("model", key, name), ["model", key])
    found = rows.groupBy("new_id").agg(F.count(F.lit(1)).alias("n_merged"), F.array_sort(F.collect_set(name)).alias("names")).where("n_merged > 1")
    return found.withColumn("names", F.slice("names", 1, most))


def stub_compartment(spark: SparkSession, name: str = "cellular_component") -> DataFrame:
    """The one compartment of a model that doesn't tell compartments apart."""
    item = F.struct(F.lit("go").alias("ontology"), F.lit("GO:0005575").alias("identifier"), F.lit("https://www.ebi.ac.uk/QuickGO/term/GO:0005575").alias("url"), F.lit("BQB_IS").alias("bqb"))
    return spark.range(1).select(S.entity_id(F.col("id"), "C").alias("c_id"), F.lit(name).alias("c_name"), F.array(item).alias("identifiers"))


def curated(tables: dict[str, DataFrame], keys: dict[str, tuple[str, dict[str, str]]], removed: dict[str, DataFrame], added: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` without the removed rows and all that refers to them, and with the added
    ones; an error if an added row refers to nothing.  ``keys``: see ``closed_removal``."""
    from .ingest import closed_removal

    gone = closed_removal(tables, keys, removed) if removed else {}
    out = {t: df.join(gone[t], keys[t][0], "left_anti") if t in gone else df for t, df in tables.items()}
    out = {t: df.unionByName(added[t], allowMissingColumns=True) if t in added else df for t, df in out.items()}
    for t, df in added.items():
        for fk, target in keys[t][1].items():
            if target in out and not df.join(out[target].select(F.col(keys[target][0]).alias(fk)), fk, "left_anti").isEmpty():
                raise ValueError(f"added {t} with {fk} that no row of {target} has")
    return out
