"""Attributes of vertices and edges: attaching, transforming, masks, and what follows from
neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import TRANSFORMATIONS


def attach(entities: DataFrame, data: DataFrame, key: str, prefix: str = "", overwrite: bool = False) -> DataFrame:
    """A side table's columns on an entity's rows; a key that repeats there, or a column that
    is there already (without ``overwrite``), is an error."""
    if not data.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats in the side table")
    data = data.withColumnsRenamed({c: prefix + c for c in data.columns if c != key})
    clash = [c for c in data.columns if c != key and c in entities.columns]
    if clash and not overwrite:
        raise ValueError(f"columns {clash} are there already")
    return entities.drop(*clash).join(data, key, "left")


def attach_by_pattern(entities: DataFrame, data: DataFrame, key: str, names: str | list[str] | dict[str, str] | None = None) -> DataFrame:
    """Chosen columns: one name, a list, a rename map, or a pattern (``re:...``); all for None."""
    import re

    rest = [c for c in data.columns if c != key]
    if names is None:
        chosen = {c: c for c in rest}
    elif isinstance(names, dict):
        chosen = names
    elif isinstance(names, str) and names.startswith("re:"):
        chosen = {c: c for c in rest if re.search(names[3:], c)}
    else:
        chosen = {c: c for c in ([names] if isinstance(names, str) else names)}
    if not chosen or any(c not in rest for c in chosen):
        raise ValueError(f"no such columns: {names!r}")
    return attach(entities, data.select(key, *[F.col(c).alias(n) for c, n in chosen.items()]), key)


def transform(df: DataFrame, spec: dict[str, str], custom: dict[str, Callable[[Column], Column]] | None = None, keep_raw: bool = True) -> DataFrame:
    """Columns by named transformations.  The raw values stay as ``raw_*``; a column that has
    them is made anew from them, so a transformation is never applied twice."""
    known = TRANSFORMATIONS | (custom or {})
    for column, name in spec.items():
        if name not in known:
            raise ValueError(f"unknown transformation {name!r}")
        raw = f"raw_{column}"
        source = F.col(raw) if raw in df.columns else F.col(column)
        if keep_raw and raw not in df.columns:
            df = df.withColumn(raw, F.col(column))
        df = df.withColumn(column, F.when(source.isNotNull(), known[name](source)))
    return df


def compile_spec(spec: dict[str, dict[str, str]], tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Attributes from a declaration: name -> table, variable, trans."""
    from .matching import pluck

    out = pluck(tables, {n: (s["table"], s["variable"]) for n, s in spec.items()}, key)
    return transform(out, {n: s.get("trans", "identity") for n, s in spec.items()}, keep_raw=False)


def masks(vertices: DataFrame, attributes: list[str], spec: str | list[str] | dict[str, str | None] | None) -> DataFrame:
    """mask_* columns: all vertices (None), an attribute's positive ones (``attr``: its own, or
    a name), or a list of names; a dict gives one for each attribute."""
    out = vertices
    for a in attributes:
        one = spec.get(a) if isinstance(spec, dict) else spec
        if one is None:
            m = F.lit(True)
        elif isinstance(one, str):
            m = F.coalesce(F.col(a if one == "attr" else one) > 0, F.lit(False))
        else:
            m = F.col("name").isin(list(one))
        out = out.withColumn(f"mask_{a}", m)
    return out


def of_species_type(vertices: DataFrame, edges: DataFrame, types: list[str], negate: bool = False, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Vertices of the types (or of the others), and the edges between them; reaction vertices
    stay if an edge is left."""
    hit = F.coalesce(F.col("species_type").isin(types), F.lit(False))
    reaction = F.col("node_type") == "reaction"
    kept = vertices.where(reaction | (~hit if negate else hit))
    e = edges.join(kept.select(F.col("name").alias(src)), src, "left_semi").join(kept.select(F.col("name").alias(dst)), dst, "left_semi")
    used = e.select(F.col(src).alias("name")).union(e.select(F.col(dst).alias("name"))).distinct()
    return kept.join(used, "name", "left_semi"), e


def augment_edges(edges: DataFrame, features: DataFrame, reactions: DataFrame) -> DataFrame:
    """Features of an edge's species end (the upstream one, or the downstream one of a
    reaction's edge) and its reaction's reversibility."""
    species = F.when(F.col("src") == F.col("r_id"), F.col("dst")).otherwise(F.col("src"))
    return edges.withColumn("sc_id", species).join(features, "sc_id", "left").join(reactions.select("r_id", "r_isreversible"), "r_id", "left")


def species_status(participants: DataFrame, formulas: DataFrame, species: DataFrame) -> DataFrame:
    """Every participation of the species (``sc_id``) with the reaction's formula."""
    return participants.join(species.select("sc_id").distinct(), "sc_id", "left_semi").join(formulas, "r_id")


def compartment_pairs(cspecies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of species (origin, dest) as all pairs of their compartmentalized forms."""
    a = cspecies.select(F.col("s_id").alias("origin"), F.col("sc_id").alias("sc_id_origin"))
    b = cspecies.select(F.col("s_id").alias("dest"), F.col("sc_id").alias("sc_id_dest"))
    return pairs.select("origin", "dest").distinct().join(a, "origin").join(b, "dest")


def shared_reactions(neighbours: DataFrame, participants: DataFrame, least: int = 2) -> DataFrame:
    """(focal, r_id): reactions with at least two participants among a focal vertex and its
    neighbours."""
    members = neighbours.select("focal", F.col("name").alias("sc_id"))
    return members.join(participants.select("r_id", "sc_id"), "sc_id").groupBy("focal", "r_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("focal", "r_id")


def precomputed_neighbours(distances: DataFrame, focal: DataFrame, order: int, n: int, weight: str = "path_weight", direction: str = "hourglass") -> DataFrame:
    """focal, name, hops of the n nearest (without ties) up, down or both, from a table of
    distances; the focal vertex itself at 0."""
    d = distances.where(F.col("path_length") <= order)
    out = focal.select(F.col("name").alias("focal"), "name", F.lit(0.0).alias("hops"))
    sides = {"downstream": [("sc_id_origin", "sc_id_dest")], "upstream": [("sc_id_dest", "sc_id_origin")], "hourglass": [("sc_id_origin", "sc_id_dest"), ("sc_id_dest", "sc_id_origin")]}[direction]
    for a, b in sides:
        own = d.join(focal.select(F.col("name").alias(a)), a, "left_semi")
        near = own.withColumn("__n", F.row_number().over(Window.partitionBy(a).orderBy(weight, b))).where(F.col("__n") <= n)
        out = out.unionByName(near.select(F.col(a).alias("focal"), F.col(b).alias("name"), F.col("path_length").alias("hops")))
    return out.groupBy("focal", "name").agg(F.min("hops").alias("hops"))


def indirect_interactions(edges: DataFrame, distances: DataFrame, most: int) -> DataFrame:
    """Edges of compartmentalized species with a path of at most ``most`` steps."""
    d = distances.where(F.col("path_length") <= most).select(F.col("sc_id_origin").alias("sc_id_upstream"), F.col("sc_id_dest").alias("sc_id_downstream"), "path_length")
    return edges.join(d, ["sc_id_upstream", "sc_id_downstream"])


def graph_summary(vertices: DataFrame, edges: DataFrame, top: int = 10) -> dict[str, object]:
    """Counts, components and the best connected vertices."""
    from .edgelist import degrees
    from .traverse import components

    c = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = c.agg(F.count(F.lit(1)), F.max("size"), F.avg("size")).first()
    best = degrees(edges).orderBy(F.desc("degree"), "name").limit(top).collect()
    return {
        "n_vertices": vertices.count(),
        "n_edges": edges.count(),
        "n_components": sizes[0],
        "largest_component": sizes[1],
        "mean_component": sizes[2],
        "top_components": [r.asDict() for r in c.orderBy(F.desc("size"), "component").limit(top).collect()],
        "top_degree": [r.asDict() for r in best],
    }


def identical_columns(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """Groups of columns with equal values in every row, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    same = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first() if pairs else None
    groups: list[list[str]] = []
    for c in columns:
        for g in groups:
            if same[f"p{pairs.index((g[0], c))}"]:
                g.append(c)
                break
        else:
            groups.append([c])
    return groups
