"""Matching features to species, and resolving what matches several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import multiplied


def with_feature_id(features: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``features`` with a feature id: the number of the row in the given order."""
    if name in features.columns:
        return features
    from ..runtime import numbered

    return numbered(features, order, name)


def features_to_species(features: DataFrame, identifiers: DataFrame, ontologies: list[str], column: str = "identifier", delimiter: str | None = "/") -> DataFrame:
    """Features joined to the species that have one of their identifiers in the ontologies;
    several identifiers in one field are taken apart at the delimiter and trimmed."""
    if delimiter is not None:
        parts = F.split(F.col(column), f"\\Q{delimiter}\\E")
        features = features.withColumn(column, F.explode(F.transform(parts, lambda x: F.trim(x))))
    known = identifiers.where(F.col("ontology").isin(ontologies)).select("ontology", F.col("identifier").alias(column), "s_id", "s_name", "bqb")
    return multiplied(features.where(F.col(column).isNotNull()), known, [column])


def match_by_ontology(features: DataFrame, identifiers: DataFrame, ontologies: list[str]) -> DataFrame:
    """Features with (ontology, identifier) joined to species on both."""
    known = identifiers.where(F.col("ontology").isin(ontologies)).select("ontology", "identifier", "s_id", "s_name", "bqb")
    return multiplied(features.where(F.col("identifier").isNotNull()), known, ["ontology", "identifier"])


def match_wide(wide: DataFrame, identifiers: DataFrame, ontologies: list[str], feature_id: str = "feature_id") -> DataFrame:
    """A table with a column for each ontology: unpivoted, then matched."""
    rest = [c for c in wide.columns if c not in ontologies]
    long = wide.unpivot(rest, ontologies, "ontology", "identifier").where(F.col("identifier").isNotNull())
    return match_by_ontology(long, identifiers, ontologies)


def edgelist_to_species(edges: DataFrame, identifiers: DataFrame, ontologies: list[str]) -> DataFrame:
    """Edges of identifiers (identifier_upstream, identifier_downstream) as edges of species."""
    known = identifiers.where(F.col("ontology").isin(ontologies)).select("identifier", "s_id", "s_name").distinct()
    up = known.select(F.col("identifier").alias("identifier_upstream"), F.col("s_id").alias("s_id_upstream"), F.col("s_name").alias("s_name_upstream"))
    down = known.select(F.col("identifier").alias("identifier_downstream"), F.col("s_id").alias("s_id_downstream"), F.col("s_name").alias("s_name_downstream"))
    return multiplied(multiplied(edges, up, ["identifier_upstream"]), down, ["identifier_downstream"], tiled=True)


def edgelist_to_cspecies(edges: DataFrame, cspecies: DataFrame) -> DataFrame:
    """Edges of species with every pair of their compartmentalized forms."""
    up = cspecies.select(F.col("s_id").alias("s_id_upstream"), F.col("sc_id").alias("sc_id_upstream"))
    down = cspecies.select(F.col("s_id").alias("s_id_downstream"), F.col("sc_id").alias("sc_id_downstream"))
    pairs = edges.select("s_id_upstream", "s_id_downstream").distinct().join(up, "s_id_upstream").join(down, "s_id_downstream")
    return edges.join(pairs, ["s_id_upstream", "s_id_downstream"])


def direct_interactions(edges: DataFrame, participants: DataFrame) -> DataFrame:
    """Edges whose upstream form acts on the downstream form in one reaction: a substrate or
    modifier and a product, or a modifier and a substrate."""
    a = participants.select("r_id", F.col("sc_id").alias("sc_id_upstream"), F.col("stoichiometry").alias("__a"))
    b = participants.select("r_id", F.col("sc_id").alias("sc_id_downstream"), F.col("stoichiometry").alias("__b"))
    acts = ((F.col("__a") < 0) & (F.col("__b") > 0)) | ((F.col("__a") == 0) & (F.col("__b") > 0)) | ((F.col("__a") == 0) & (F.col("__b") < 0))
    # the edges narrow the participants before these are joined to each other
    ups = edges.select("sc_id_upstream").distinct()
    downs = edges.select("sc_id_downstream").distinct()
    pairs = a.join(ups, "sc_id_upstream", "left_semi").join(b.join(downs, "sc_id_downstream", "left_semi"), "r_id").where(acts)
    pairs = pairs.select("sc_id_upstream", "sc_id_downstream", "r_id").distinct()
    return edges.join(pairs, ["sc_id_upstream", "sc_id_downstream"])


# --- many to one -----------------------------------------------------------------


def _numeric(method: str, c: str, feature_id: str) -> Column:
    v = F.col(c).cast("double")
    if method == "weighted_mean":  # a null drops from the sum, its weight doesn't; no value at all sums to 0
        return F.coalesce(F.sum(v * F.col("__w")), F.lit(0.0)) / F.sum("__w")
    if method == "mean":
        return F.avg(v)
    if method == "first":
        return F.min_by(v, F.when(v.isNotNull(), F.col(feature_id)))
    if method == "max":
        return F.max(v)
    raise ValueError(f"unknown aggregator {method!r}")


def resolve(matched: DataFrame, key: str = "s_id", feature_id: str = "feature_id", numeric: str = "weighted_mean", keep_ids: bool = True) -> DataFrame:
    """One row per key: one row per (key, feature) first (that of the smallest values), then
    numbers by the named aggregator, booleans of the first feature id, strings as sorted
    distinct values in one field, and the number of features.  A feature's weight is one
    over the number of keys that it matches."""
    values = [f for f in matched.schema.fields if f.name not in (key, feature_id)]
    one = matched.groupBy(key, feature_id).agg(*[F.min(f.name).alias(f.name) for f in values])
    n = F.count(F.lit(1)).over(Window.partitionBy(feature_id))
    weighted = one.where(F.col(key).isNotNull()).withColumn("__w", 1.0 / n)
    out = []
    for f in values:
        if isinstance(f.dataType, T.BooleanType):
            out.append(F.min_by(f.name, F.when(F.col(f.name).isNotNull(), F.col(feature_id))).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(_numeric(numeric, f.name, feature_id).alias(f.name))
        else:
            out.append(F.array_join(F.array_sort(F.collect_set(F.col(f.name).cast("string"))), ",").alias(f.name))
    if keep_ids:
        out.append(F.array_join(F.array_sort(F.collect_set(F.col(feature_id).cast("string"))), ",").alias(feature_id))
    return weighted.groupBy(key).agg(*out, F.countDistinct(feature_id).alias("n_match"))


def bind_tables(tables: dict[str, DataFrame], key: str, strategy: str = "contiguous") -> DataFrame:
    """Results of several modalities in one table: rows under each other (``contiguous``) or
    columns side by side with the modality as a suffix (``stagger``)."""
    if strategy == "contiguous":
        parts = list(tables.values())
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    out = None
    for name, df in tables.items():
        part = df.withColumnsRenamed({c: f"{c}_{name}" for c in df.columns if c != key})
        out = part if out is None else out.join(part, key, "full")
    return out


def pluck(tables: dict[str, DataFrame], wanted: dict[str, tuple[str, str]], key: str) -> DataFrame:
    """Chosen columns (name: (table, variable)) of several tables, aligned on the key."""
    by_table: dict[str, list[Column]] = {}
    for name, (table, variable) in wanted.items():
        by_table.setdefault(table, []).append(F.col(variable).alias(name))
    out = None
    for table, columns in by_table.items():
        part = tables[table].select(key, *columns)
        out = part if out is None else out.join(part, key, "full")
    return out
