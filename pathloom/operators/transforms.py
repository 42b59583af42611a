"""Relational steps that particular sources need before they become models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- interaction databases -------------------------------------------------------


def signed_pairs(rows: DataFrame) -> DataFrame:
    """(src, dst, sign, reference) as one row per pair: its role (both signs: modifier) and
    all references, taken apart at ``;``, once each."""
    up, down = F.bool_or(F.col("sign") == "Activation"), F.bool_or(F.col("sign") == "Repression")
    role = F.when(up & down, "modifier").when(up, "stimulator").when(down, "inhibitor").otherwise("modifier")
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("reference", ";")))))
    return rows.groupBy("src", "dst").agg(role.alias("role"), F.array_join(refs, ";").alias("reference"))


def earliest_pairs(rows: DataFrame, time: str = "t_rise", value: str = "v_inter") -> DataFrame:
    """(src, dst) with the earliest record, and a role by whether all signs agree."""
    best = F.min_by(F.col(value), F.struct(time, value))
    role = F.when(F.bool_and(F.col(value) > 0), "stimulator").when(F.bool_and(F.col(value) < 0), "inhibitor").otherwise("modifier")
    return rows.groupBy("src", "dst").agg(F.min(time).alias(time), best.alias(value), role.alias("role"))


def unique_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """Names that several rows have get the key in front."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 1, F.concat_ws(" ", F.col(key).cast("string"), name)).otherwise(F.col(name))).drop("__n")


def annotation_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """``a:b;c:d`` as rows (name, value), cut at the first colon."""
    part = F.explode(F.filter(F.split(column, ";"), lambda x: F.trim(x) != ""))
    return df.select(key, part.alias("x")).select(key, F.trim(F.split("x", ":", 2)[0]).alias("name"), F.trim(F.get(F.split("x", ":", 2), F.lit(1))).alias("value"))


def both_directions(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges and their reverses."""
    swapped = edges.select(*[F.col(dst).alias(src) if c == src else F.col(src).alias(dst) if c == dst else F.col(c) for c in edges.columns])
    return edges.unionByName(swapped)


#: What an annotation says of an interaction, the first pattern that matches.
ANNOTATION_ROLES = (
    (r"inhibit|repress|dephosphorylat|degrad", "inhibitor"),
    (r"activat|express|phosphorylat|catalyz", "stimulator"),
    (r"complex|input|interact|bind", "interactor"),
)


def annotation_roles(annotation: Column, direction: Column) -> Column:
    """Array of (role, reverse) that an annotation and a direction symbol such as ``->``,
    ``|-`` or ``<->`` stand for."""
    role = None
    for pattern, name in ANNOTATION_ROLES:
        hit = F.lower(annotation).rlike(pattern)
        role = F.when(hit, name) if role is None else role.when(hit, name)
    ahead = F.when(direction.endswith(">"), F.coalesce(role, F.lit("stimulator"))).when(direction.endswith("|"), "inhibitor")
    back = F.when(direction.startswith("<"), F.coalesce(role, F.lit("stimulator"))).when(direction.startswith("|"), "inhibitor")
    made = F.array_compact(F.array(F.when(ahead.isNotNull(), F.struct(ahead.alias("role"), F.lit(False).alias("reverse"))), F.when(back.isNotNull(), F.struct(back.alias("role"), F.lit(True).alias("reverse")))))
    plain = F.array(F.struct(F.coalesce(role, F.lit("interactor")).alias("role"), F.lit(False).alias("reverse")))
    return F.when(F.size(made) > 0, made).otherwise(plain)


# --- interaction scores ----------------------------------------------------------


def study_counts(rows: DataFrame) -> DataFrame:
    """(pair, attribute, term, score) with the number of distinct studies."""
    return rows.select("pair", "study", "attribute", "term", "score").distinct().groupBy("pair", "attribute", "term", "score").agg(F.count(F.lit(1)).alias("n"))


def category_scores(counts: DataFrame) -> DataFrame:
    """(pair, attribute, category_score): ln(a + 1) / ln(b + 1) with a the sum of score times
    count and b that plus, for each score, its greatest count; 0 if a is 0."""
    per = counts.groupBy("pair", "attribute", "score").agg(F.sum(F.col("score") * F.col("n")).alias("a"), F.max("n").alias("m"))
    both = per.groupBy("pair", "attribute").agg(F.sum("a").alias("a"), F.sum("m").alias("m"))
    b = F.col("a") + F.col("m")
    return both.select("pair", "attribute", F.when(F.col("a") == 0, 0.0).otherwise(F.log(F.col("a") + 1) / F.log(b + 1)).alias("category_score"))


def mi_score(counts: DataFrame, publications: DataFrame, most: int = 7, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """pair, publication_score, method_score, type_score and their weighted mean."""
    cat = category_scores(counts)
    method = cat.where("attribute = 'method'").select("pair", F.col("category_score").alias("method_score"))
    kind = cat.where("attribute = 'type'").select("pair", F.col("category_score").alias("type_score"))
    capped = F.least(F.col("n_publications"), F.lit(most))
    pub = publications.select("pair", F.when(F.col("n_publications") >= most, 1.0).otherwise(F.log(capped + 1) / F.log(F.lit(most + 1.0))).alias("publication_score"))
    j = pub.join(method, "pair", "left").join(kind, "pair", "left").na.fill(0.0, ["method_score", "type_score"])
    p, m, t = weights
    return j.withColumn("mi_score", (p * F.col("publication_score") + m * F.col("method_score") + t * F.col("type_score")) / (p + m + t))


# --- perturbations and expression ------------------------------------------------


def perturbation_direction(kind: Column, value: Column, threshold: Column) -> Column:
    """What a change after a gain or loss of a gene says: with a loss, a rise means that the
    gene holds the target down."""
    loss = F.lower(kind).isin("knockdown", "knockout", "crispri", "loss")
    gain = F.lower(kind).isin("overexpression", "activation", "crispra", "gain")
    rise = value > 0
    return (
        F.when(value.isNull() | kind.isNull(), "unknown")
        .when(threshold.isNotNull() & (F.abs(value) < threshold), "weak")
        .when(~loss & ~gain, "ambiguous")
        .when(loss == rise, "inhibition")
        .otherwise("activation")
    )


def strongest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The row of the greatest absolute value per key, and the number of rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.abs(value), value))
    return rows.groupBy(*keys).agg(best.alias("x"), F.count(F.lit(1)).alias("n_measurements")).select(*keys, "x.*", "n_measurements")


def presence_table(rows: DataFrame, key: str, column: str, values: list[str], sep: str = ";") -> DataFrame:
    """Lists in a field as a 0/1 table."""
    long = rows.select(key, F.explode(F.split(column, sep)).alias("v")).select(key, F.trim("v").alias("v"))
    return long.groupBy(key).pivot("v", values).agg(F.lit(1)).na.fill(0)


def numeric_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """All columns but the keys as numbers; what is none becomes null."""
    return df.select(*keys, *[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in df.columns if c not in keys])


def wide_to_long(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


# --- edge lists to models --------------------------------------------------------


def model_from_edgelist(edges: DataFrame, species: DataFrame, compartments: DataFrame, default_role: str = "SBO:0000336") -> dict[str, DataFrame]:
    """The five tables of a model from flat edges (name_upstream, name_downstream,
    compartment_upstream, compartment_downstream, r_name, r_isreversible and optional roles and
    stoichiometries), species (s_name, identifiers) and compartments (c_name)."""
    from ..functions.scalars import entity_id

    from ..runtime import numbered as number

    def numbered(df: DataFrame, prefix: str, key: str, order: list[str]) -> DataFrame:
        return number(df, order, key).withColumn(key, entity_id(F.col(key), prefix))

    defaults = {
        "compartment_upstream": F.lit("cellular_component"),
        "compartment_downstream": F.lit("cellular_component"),
        "sbo_term_upstream": F.lit(default_role),
        "sbo_term_downstream": F.lit(default_role),
        "stoichiometry_upstream": F.lit(0.0),
        "stoichiometry_downstream": F.lit(0.0),
        "r_isreversible": F.lit(False),
    }
    e = edges
    for c, v in defaults.items():
        e = e.withColumn(c, F.coalesce(F.col(c), v) if c in e.columns else v)
    names = e.select(F.col("name_upstream").alias("s_name")).union(e.select(F.col("name_downstream").alias("s_name"))).distinct()
    s = numbered(species.dropDuplicates(["s_name"]).join(names, "s_name", "left_semi"), "S", "s_id", ["s_name"])
    c = numbered(compartments.dropDuplicates(["c_name"]), "C", "c_id", ["c_name"])
    at = e.select(F.col("name_upstream").alias("s_name"), F.col("compartment_upstream").alias("c_name")).union(e.select(F.col("name_downstream"), F.col("compartment_downstream"))).distinct()
    sc = at.join(s.select("s_name", "s_id"), "s_name").join(c.select("c_name", "c_id"), "c_name")
    sc = numbered(sc.withColumn("sc_name", F.format_string("%s [%s]", "s_name", "c_name")), "SC", "sc_id", ["s_name", "c_name"])
    r = numbered(e, "R", "r_id", ["r_name", "name_upstream", "name_downstream", "compartment_upstream", "compartment_downstream"])
    p = None
    for side in ("upstream", "downstream"):
        look = sc.select(F.col("s_name").alias(f"name_{side}"), F.col("c_name").alias(f"compartment_{side}"), "sc_id")
        part = r.join(look, [f"name_{side}", f"compartment_{side}"]).select("r_id", "sc_id", F.col(f"stoichiometry_{side}").cast("double").alias("stoichiometry"), F.col(f"sbo_term_{side}").alias("sbo_term"))
        p = part if p is None else p.unionByName(part)
    p = numbered(p, "RSC", "rsc_id", ["r_id", "stoichiometry", "sc_id"])
    return {"compartments": c, "species": s, "compartmentalized_species": sc.select("sc_id", "sc_name", "s_id", "c_id"), "reactions": r.select("r_id", "r_name", "r_isreversible"), "reaction_species": p}


def consistent_edges(edges: DataFrame, species: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are both known, and the species that these use."""
    known = species.select("s_name").distinct()
    kept = edges.join(known.withColumnRenamed("s_name", "name_upstream"), "name_upstream", "left_semi").join(known.withColumnRenamed("s_name", "name_downstream"), "name_downstream", "left_semi")
    used = kept.select(F.col("name_upstream").alias("s_name")).union(kept.select(F.col("name_downstream").alias("s_name"))).distinct()
    return kept, species.join(used, "s_name", "left_semi")
