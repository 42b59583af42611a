"""From a model's participants to a weighted, directed network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocabulary as V
from ..functions import scalars as S

INTERACTOR = V.ROLE_CODES["interactor"]
#: The stoichiometry and role columns of an edge's two ends.
EDGE = ["src", "dst", "sbo_term_upstream", "sbo_term_downstream", "stoichiometry_upstream", "stoichiometry_downstream", "r_id"]


def tier_of(approach: str) -> dict[str, int]:
    """Role (or ``reaction``) to its tier, upstream first."""
    return {role: i for i, tier in enumerate(V.TIERS[approach]) for role in tier}


def wire(participants: DataFrame, approach: str = "regulatory", drop_reactions: str = "same_tier") -> DataFrame:
    """Edges between the consecutive tiers that a reaction's participants occupy.

    Reactions of exactly two interactors become one edge.  All other reactions get a row for
    themselves, at the reaction's tier, unless ``drop_reactions`` leaves it out: ``always``,
    ``edgelist`` (two participants) or ``same_tier`` (never here).  Participants of a reaction
    that all stand in one tier are paired with each other if they are alike in role and
    stoichiometry, and have no edges otherwise.

    Participants of unknown role have no tier and no edges.

    Participants are dealt by reaction once.  A reaction's shape (its tiers, a bounded set) is
    an aggregate, from which every participant knows the next tier, so the only other shuffle
    is the join of (reaction, tier), which deals a large reaction out by its tiers."""
    tiers = tier_of(approach)
    p = participants.select("r_id", "sc_id", "sbo_term", F.col("stoichiometry").cast("double").alias("stoichiometry"))
    base = p.withColumn("tier", S.mapped(S.role_name(F.col("sbo_term")), tiers)).repartition("r_id")
    kind = F.struct("sbo_term", "stoichiometry")
    shape = base.groupBy("r_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("sbo_term") == INTERACTOR).alias("pair"),
        F.min("sc_id").alias("first"),
        F.max("sc_id").alias("last"),
        F.collect_set("tier").alias("tiers"),
        F.min(kind).eqNullSafe(F.max(kind)).alias("alike"),
    )
    is_pair = F.coalesce((F.col("n") == 2) & F.col("pair"), F.lit(False))
    keep = {"always": F.lit(False), "edgelist": F.col("n") != 2, "same_tier": F.lit(True)}[drop_reactions]
    shape = shape.select("r_id", "first", "last", is_pair.alias("is_pair"), F.size("tiers").alias("n_tiers"), "alike", keep.alias("keep"), "tiers")
    every = F.when(F.col("keep"), F.array_union("tiers", F.array(F.lit(tiers["reaction"])))).otherwise(F.col("tiers"))
    shape = shape.withColumn("tiers", every)
    duo = shape.where("is_pair").select(
        F.col("first").alias("src"), F.col("last").alias("dst"), F.lit(INTERACTOR).alias("sbo_term_upstream"), F.lit(INTERACTOR).alias("sbo_term_downstream"), F.lit(0.0).alias("stoichiometry_upstream"), F.lit(0.0).alias("stoichiometry_downstream"), "r_id"
    )
    rest = base.join(shape.where("NOT is_pair").select("r_id", "n_tiers", "alike", "tiers"), "r_id")
    number = F.row_number().over(Window.partitionBy("r_id").orderBy("sc_id"))
    alike = rest.where("n_tiers = 1 AND alike").withColumn("k", number)
    a = alike.select("r_id", F.col("k").alias("i"), F.col("sc_id").alias("src"), F.col("sbo_term").alias("sbo_term_upstream"), F.col("stoichiometry").alias("stoichiometry_upstream"))
    b = alike.select("r_id", F.col("k").alias("j"), F.col("sc_id").alias("dst"), F.col("sbo_term").alias("sbo_term_downstream"), F.col("stoichiometry").alias("stoichiometry_downstream"))
    same = a.join(b, "r_id").where("i < j").select(*EDGE)
    members = rest.where("n_tiers > 1 AND tier IS NOT NULL").select("r_id", F.col("sc_id").alias("node"), "sbo_term", "stoichiometry", "tier", "tiers")
    own = shape.where("NOT is_pair AND n_tiers > 1 AND keep").select(
        "r_id", F.col("r_id").alias("node"), F.lit(None).cast("string").alias("sbo_term"), F.lit(None).cast("double").alias("stoichiometry"), F.lit(tiers["reaction"]).alias("tier"), "tiers"
    )
    placed = members.unionByName(own)
    above = F.array_min(F.filter("tiers", lambda t: t > F.col("tier")))
    up = placed.select("r_id", above.alias("k"), F.col("node").alias("src"), F.col("sbo_term").alias("sbo_term_upstream"), F.col("stoichiometry").alias("stoichiometry_upstream")).where("k IS NOT NULL")
    down = placed.select("r_id", F.col("tier").alias("k"), F.col("node").alias("dst"), F.col("sbo_term").alias("sbo_term_downstream"), F.col("stoichiometry").alias("stoichiometry_downstream"))
    cross = up.join(down, ["r_id", "k"]).select(*EDGE)
    return duo.select(*EDGE).unionByName(same).unionByName(cross)


def bipartite(participants: DataFrame) -> DataFrame:
    """Species to reaction for what is consumed or acts, reaction to species for what is made."""
    s = F.col("stoichiometry")
    into = participants.where(s <= 0).select(F.col("sc_id").alias("src"), F.col("r_id").alias("dst"), "stoichiometry", "sbo_term", "r_id")
    out = participants.where(s > 0).select(F.col("r_id").alias("src"), F.col("sc_id").alias("dst"), "stoichiometry", "sbo_term", "r_id")
    return into.unionByName(out)


_SWAPPED = {"reactant": "product", "product": "reactant"}


def add_reverse(edges: DataFrame, reactions: DataFrame) -> DataFrame:
    """``edges`` with ``direction``, and the reverse of those of reversible reactions whose
    upstream end is neither a modifier of any kind nor a catalyst: ends swapped,
    stoichiometry negated, reactant and product codes exchanged."""
    e = edges.join(reactions.select("r_id", "r_isreversible"), "r_id", "left")
    fixed = [V.ROLE_CODES[n] for n in ("catalyst", "inhibitor", "stimulator", "modifier")]
    turn = e.where(F.col("r_isreversible") & ~F.coalesce(F.col("sbo_term_upstream").isin(fixed), F.lit(False)))
    codes = {V.ROLE_CODES[a]: V.ROLE_CODES[b] for a, b in _SWAPPED.items()}

    def swapped(c: str):  # noqa: ANN202
        return F.coalesce(S.mapped(F.col(c), codes), F.col(c))

    back = turn.select(
        F.col("dst").alias("src"),
        F.col("src").alias("dst"),
        swapped("sbo_term_downstream").alias("sbo_term_upstream"),
        swapped("sbo_term_upstream").alias("sbo_term_downstream"),
        (-F.col("stoichiometry_downstream")).alias("stoichiometry_upstream"),
        (-F.col("stoichiometry_upstream")).alias("stoichiometry_downstream"),
        "r_id",
        F.lit("reverse").alias("direction"),
    )
    return e.select(*EDGE, F.lit("forward").alias("direction")).unionByName(back)


def reverse(edges: DataFrame) -> DataFrame:
    """The whole network turned around: paired columns exchanged, stoichiometry negated,
    forward and reverse exchanged."""
    pairs = [("src", "dst"), ("sc_parents", "sc_children"), ("weight", "weight_upstream"), ("stoichiometry_upstream", "stoichiometry_downstream"), ("sbo_term_upstream", "sbo_term_downstream")]
    to = {}
    for a, b in pairs:
        if a in edges.columns and b in edges.columns:
            to |= {a: b, b: a}
    out = []
    for c in edges.columns:
        x = F.col(to.get(c, c))
        if c.startswith("stoichiometry_"):
            x = -x
        if c == "direction":
            x = S.mapped(F.col(c), {"forward": "reverse", "reverse": "forward", "undirected": "undirected"})
        out.append(x.alias(c))
    return edges.select(*out)


def deduplicate(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): a forward one before a reverse one, then the smallest r_id."""
    w = Window.partitionBy("src", "dst").orderBy("direction", "r_id", "sbo_term_upstream", "sbo_term_downstream")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def add_degrees(edges: DataFrame) -> DataFrame:
    """sc_degree, sc_children and sc_parents of the species end of each edge (the upstream end,
    or the downstream one if the upstream end is the reaction), over distinct edges; reaction
    nodes have none of their own."""
    d = edges.select("src", "dst", "r_id").withColumn("src_is_r", F.col("src") == F.col("r_id")).withColumn("dst_is_r", F.col("dst") == F.col("r_id"))
    d = d.select("src", "dst", "src_is_r", "dst_is_r").distinct()
    ends = d.where("not src_is_r").select(F.col("src").alias("node"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(d.where("not dst_is_r").select(F.col("dst").alias("node"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    per = ends.groupBy("node").agg(F.sum("c").cast("long").alias("sc_children"), F.sum("p").cast("long").alias("sc_parents"), F.sum(F.col("c") + F.col("p")).cast("long").alias("sc_degree"))
    node = F.when(F.col("src") == F.col("r_id"), F.col("dst")).otherwise(F.col("src"))
    return edges.withColumn("node", node).join(per, "node", "left").drop("node").na.fill(0, ["sc_children", "sc_parents", "sc_degree"])


def topology_weights(edges: DataFrame, base: float = V.TOPOLOGY["base"], directed: bool = True, multipliers: dict[str, float] | None = None) -> DataFrame:
    """weight and weight_upstream: base + multiplier(species type) / mean degree * children (or
    degree, undirected) and parents.  The mean is one aggregate that joins back as one row."""
    known = multipliers or {k: v for k, v in V.TOPOLOGY.items() if k != "base"}
    factor = S.mapped(F.col("species_type"), known)
    checked = F.when(factor.isNull(), F.raise_error(F.concat(F.lit("no multiplier for "), F.coalesce("species_type", F.lit("null")))).cast("double")).otherwise(factor)
    connections = F.col("sc_children") if directed else F.col("sc_degree")
    mean = edges.agg(F.avg(connections).alias("__mean"))
    e = edges.withColumn("__k", F.lit(1)).join(F.broadcast(mean.withColumn("__k", F.lit(1))), "__k").drop("__k")
    scale = checked / F.col("__mean")
    return e.withColumn("weight", base + scale * connections).withColumn("weight_upstream", base + scale * F.col("sc_parents")).drop("__mean")


def mixed_weights(edges: DataFrame, columns: list[str], topology: str = "topology_weight", source: str | None = None) -> DataFrame:
    """weight: the least of the score columns, the topology weight and the source weight;
    missing ones are passed over."""
    every = [F.col(c) for c in [*columns, topology, *([source] if source else [])]]
    return edges.withColumn("weight", F.least(*every) if len(every) > 1 else every[0])


def source_weights(edges: DataFrame, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """source_weight: the greatest of the constants whose column has a value, else the default."""
    found = [F.when(F.col(c).isNotNull(), F.lit(float(v))) for c, v in weights.items()]
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return edges.withColumn("source_weight", F.coalesce(best, F.lit(default)))


def halve_reaction_edges(edges: DataFrame, reactions: DataFrame, factor: float = 0.5) -> DataFrame:
    """Weights of edges at a reaction node times ``factor``, so that a step from species to
    species through a reaction costs one step."""
    at = (F.col("src") == F.col("r_id")) | (F.col("dst") == F.col("r_id"))
    out = edges
    for c in ("weight", "weight_upstream"):
        if c in edges.columns:
            out = out.withColumn(c, F.when(at, F.col(c) * factor).otherwise(F.col(c)))
    return out
