"""Keys and references of a model, cascading deletes, repairs, formulas and cofactors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import scalars as S


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> tuple[DataFrame, DataFrame]:
    """References without a target, and targets without a reference."""
    a = child.select(F.col(fk).alias("key")).distinct()
    b = parent.select(F.col(pk).alias("key")).distinct()
    return a.join(b, "key", "left_anti"), b.join(a, "key", "left_anti")


def table_faults(df: DataFrame, pk: str, required: list[str]) -> DataFrame:
    """One row: repeated keys, and nulls in the key and the required columns."""
    missing = [c for c in [pk, *required] if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    per = df.groupBy(pk).agg(F.count(F.lit(1)).alias("n"))
    repeated = per.where("n > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in dict.fromkeys([pk, *required])])
    return repeated.withColumn("__k", F.lit(1)).join(nulls.withColumn("__k", F.lit(1)), "__k").drop("__k")


def underspecified(participants: DataFrame, removed: DataFrame) -> DataFrame:
    """Reactions that the removal of compartmentalized species (``sc_id``) takes the sense of:
    a defining participant goes, or all participants of a required role."""
    gone = removed.select("sc_id").distinct().withColumn("gone", F.lit(True))
    p = participants.join(gone, "sc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("rule", S.role_rule(F.col("sbo_term")))
    per = p.groupBy("r_id", "sbo_term", "rule").agg(F.bool_or("gone").alias("some"), F.bool_and("gone").alias("every"))
    lost = (F.col("rule") == "DEFINING") & F.col("some") | (F.col("rule") == "REQUIRED") & F.col("every")
    return per.where(lost).select("r_id").distinct()


def unused(participants: DataFrame, cspecies: DataFrame, reactions: DataFrame, species: DataFrame, compartments: DataFrame) -> DataFrame:
    """(entity, id) of entities without a reference, each after those above it are gone:
    reactions and compartmentalized species without participants, then species and
    compartments without compartmentalized species."""
    r = reactions.select("r_id").distinct().join(participants, "r_id", "left_anti")
    c = cspecies.select("sc_id").distinct().join(participants, "sc_id", "left_anti")
    left = cspecies.join(participants, "sc_id", "left_semi")
    s = species.select("s_id").distinct().join(left, "s_id", "left_anti")
    k = compartments.select("c_id").distinct().join(left, "c_id", "left_anti")
    out = None
    for name, df, key in (("reactions", r, "r_id"), ("compartmentalized_species", c, "sc_id"), ("species", s, "s_id"), ("compartments", k, "c_id")):
        part = df.select(F.lit(name).alias("entity"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def cascade(removed: DataFrame, cspecies: DataFrame, participants: DataFrame) -> dict[str, DataFrame]:
    """What goes with removed species (``s_id``): their compartmentalized forms, the
    participants that these are, the reactions left underspecified with all of their
    participants, and the compartmentalized forms that take part in nothing any more."""
    from ..runtime import materialise

    # what several steps start from is written once
    forms = materialise(cspecies.join(removed.select("s_id").distinct(), "s_id", "left_semi").select("sc_id").distinct(), "cascade-forms")
    reactions = materialise(underspecified(participants, forms), "cascade-reactions")
    gone = participants.join(forms, "sc_id", "left_semi").select("rsc_id").union(participants.join(reactions, "r_id", "left_semi").select("rsc_id")).distinct()
    left = participants.join(gone, "rsc_id", "left_anti")
    idle = participants.select("sc_id").distinct().join(left, "sc_id", "left_anti").select("sc_id")
    return {"compartmentalized_species": forms.union(idle).distinct(), "reaction_species": gone, "reactions": reactions}


def infer_roles(participants: DataFrame) -> DataFrame:
    """Codes that are no role replaced by what the stoichiometry says."""
    s = F.col("stoichiometry")
    said = F.when(s < 0, V.ROLE_CODES["reactant"]).when(s > 0, V.ROLE_CODES["product"]).otherwise(V.ROLE_CODES["stimulator"])
    return participants.withColumn("sbo_term", F.when(F.col("sbo_term").isin(list(V.ROLE_NAMES)), F.col("sbo_term")).otherwise(said))


def infer_compartments(cspecies: DataFrame, participants: DataFrame) -> DataFrame:
    """A missing compartment becomes the most frequent one among the partners in its
    reactions, or else of all; ties go to the smaller id."""
    located = cspecies.where(F.col("c_id").isNotNull()).select("sc_id", "c_id")
    lost = cspecies.where(F.col("c_id").isNull()).select(F.col("sc_id").alias("lost_id"))
    theirs = participants.select("r_id", F.col("sc_id").alias("lost_id")).join(lost, "lost_id", "left_semi")
    partners = participants.select("r_id", "sc_id").join(located, "sc_id").select("r_id", "c_id")
    votes = theirs.join(partners, "r_id").groupBy("lost_id", "c_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("lost_id").agg(F.min_by("c_id", F.struct(-F.col("n"), F.col("c_id"))).alias("__near"))
    common = located.groupBy("c_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("c_id", F.struct(-F.col("n"), F.col("c_id"))).alias("__common"))
    out = cspecies.join(best.withColumnRenamed("lost_id", "sc_id"), "sc_id", "left").withColumn("__k", F.lit(1)).join(F.broadcast(common.withColumn("__k", F.lit(1))), "__k", "left")
    return out.withColumn("c_id", F.coalesce("c_id", "__near", "__common")).drop("__k", "__near", "__common").select(*cspecies.columns)


def formulas(participants: DataFrame, reactions: DataFrame, name: str = "name") -> DataFrame:
    """r_id and its formula.  Participants are in the order of their labels."""
    p = participants.withColumn("label", S.with_stoichiometry(F.col("stoichiometry"), F.col(name)))

    def labels(cond: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("label", "rsc_id")))), lambda x: x["label"]), " + ")

    s, code = F.col("stoichiometry"), F.col("sbo_term")
    per = p.groupBy("r_id").agg(
        F.bool_and(code == V.ROLE_CODES["interactor"]).alias("pair"),
        F.count(F.lit(1)).alias("n"),
        labels(s < 0).alias("left"),
        labels(code.isin(V.ROLE_CODES["product"], V.ROLE_CODES["modifier"])).alias("right"),
        labels(s == 0).alias("others"),
        F.transform(F.array_sort(F.collect_list(F.struct("label", "rsc_id"))), lambda x: x["label"]).alias("all"),
    )
    out = per.join(reactions.select("r_id", "r_isreversible"), "r_id")
    arrow = F.when(F.col("r_isreversible"), " <-> ").otherwise(" -> ")
    more = F.when(F.col("others") != "", F.concat(F.lit(" ---- modifiers: "), F.col("others"), F.lit("]"))).otherwise("")
    text = F.when(F.col("pair"), F.when(F.col("n") == 2, F.array_join("all", " ---- "))).otherwise(F.concat("left", arrow, "right", more))
    return out.select("r_id", text.alias("formula"))


def name_cspecies(cspecies: DataFrame, species: DataFrame, compartments: DataFrame) -> DataFrame:
    """``species [compartment]`` where the name is only the species' one."""
    j = cspecies.join(species.select("s_id", "s_name"), "s_id").join(compartments.select("c_id", "c_name"), "c_id")
    full = F.concat(F.col("s_name"), F.lit(" ["), F.col("c_name"), F.lit("]"))
    return j.withColumn("sc_name", F.when(F.col("sc_name") == F.col("s_name"), full).otherwise(F.col("sc_name"))).select(*cspecies.columns)


def cofactor_hits(participants: DataFrame, cofactors: DataFrame) -> DataFrame:
    """(rsc_id, filter_reason): participants (with a nonzero stoichiometry) that are cofactors
    of a rule that their reaction meets.  ``cofactors``: sc_id, cofactor."""
    p = participants.where("stoichiometry <> 0").join(cofactors, "sc_id")
    per = p.groupBy("r_id").agg(F.collect_set("cofactor").alias("have"), F.collect_set(F.when(F.col("stoichiometry") < 0, F.col("cofactor"))).alias("used"))
    reasons = []
    for reason, (every, none, substrate) in V.COFACTOR_RULES.items():
        meets = F.size(F.array_except(F.array(*map(F.lit, every)), "have")) == 0
        if none:
            meets &= ~F.arrays_overlap("have", F.array(*map(F.lit, none)))
        if substrate:
            meets &= F.arrays_overlap("used", F.array(*map(F.lit, substrate)))
        reasons.append(F.when(meets, F.struct(F.lit(reason).alias("filter_reason"), F.array(*map(F.lit, every)).alias("drops"))))
    met = per.select("r_id", F.explode(F.array_compact(F.array(*reasons))).alias("x")).select("r_id", "x.filter_reason", F.explode("x.drops").alias("cofactor"))
    return p.join(met, ["r_id", "cofactor"]).select("rsc_id", "filter_reason")


def find_cofactors(identifiers: DataFrame) -> DataFrame:
    """(s_id, cofactor) by chebi identifiers that say what the species is."""
    table = [(number, name) for name, numbers in V.COFACTORS.items() for number in numbers]
    rules = identifiers.sparkSession.createDataFrame(table, "number long, cofactor string")
    own = identifiers.where((F.col("ontology") == "chebi") & (F.col("bqb") == "BQB_IS")).withColumn("number", F.col("identifier").try_cast("long"))
    return own.join(F.broadcast(rules), "number").select("s_id", "cofactor").distinct()


def trivial_participants(participants: DataFrame) -> DataFrame:
    """(r_id, sc_id) whose net stoichiometry is 0: they take no part."""
    return participants.groupBy("r_id", "sc_id").agg(F.sum("stoichiometry").alias("net")).where("net = 0").select("r_id", "sc_id")


def next_ids(new: DataFrame, current_max: DataFrame, prefix: str, order: list[str], key: str) -> DataFrame:
    """Ids for new rows that go on from the greatest number in use (one row, column ``m``)."""
    from ..runtime import numbered

    rows = numbered(new, order, "__n").withColumn("__k", F.lit(1)).join(F.broadcast(current_max.withColumn("__k", F.lit(1))), "__k")
    return rows.withColumn(key, S.entity_id(F.col("__n") + 1 + F.coalesce("m", F.lit(-1)), prefix)).drop("__n", "__k", "m")


def exchange_gaps(cspecies: DataFrame, exchange: str) -> tuple[DataFrame, DataFrame]:
    """For species in several compartments: those that lack the exchange compartment, and
    the pairs (form elsewhere, form in the exchange compartment) that transport would link."""
    many = cspecies.groupBy("s_id").agg(F.countDistinct("c_id").alias("n")).where("n > 1").select("s_id")
    mine = cspecies.join(many, "s_id", "left_semi")
    there = mine.where(F.col("c_id") == exchange)
    lacking = many.join(there, "s_id", "left_anti")
    pairs = mine.where(F.col("c_id") != exchange).select("s_id", F.col("sc_id").alias("sc_id_from")).join(there.select("s_id", F.col("sc_id").alias("sc_id_to")), "s_id")
    return lacking, pairs


def transport_status(edges: DataFrame, cspecies: DataFrame, max_steps: int = 6) -> DataFrame:
    """s_id and whether its forms reach each other in the network: ``single`` (one form),
    ``unreachable`` (no form reaches another), ``inadequate`` (not all are connected so) or
    ``valid``."""
    from ..runtime import materialise
    from .traverse import components, distances

    many = cspecies.groupBy("s_id").agg(F.countDistinct("sc_id").alias("n_forms"))
    forms = cspecies.select("s_id", "sc_id").distinct()
    reach = distances(edges, forms.select(F.col("sc_id").alias("name")), None, max_steps)
    a, b = forms.select("s_id", F.col("sc_id").alias("origin")), forms.select("s_id", F.col("sc_id").alias("dest"))
    pairs = materialise(reach.join(a, "origin").join(b, ["s_id", "dest"]).select("s_id", "origin", "dest"), "transport")
    groups = components(pairs.select(F.col("origin").alias("src"), F.col("dest").alias("dst")))
    largest = groups.join(forms.withColumnRenamed("sc_id", "name"), "name").groupBy("s_id", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("s_id").agg(F.max("n").alias("n"))
    status = F.when(F.col("n_forms") == 1, "single").when(F.col("n").isNull(), "unreachable").when(F.col("n") < F.col("n_forms"), "inadequate").otherwise("valid")
    return many.join(largest, "s_id", "left").select("s_id", status.alias("status"))


def exchange_reactions(pairs: DataFrame, names: DataFrame, current_max: int) -> tuple[DataFrame, DataFrame]:
    """A reversible reaction for each (s_id, sc_id_from, sc_id_to), and its participants."""
    from ..runtime import numbered

    r = numbered(pairs.join(names.select("s_id", "s_name"), "s_id"), ["sc_id_from", "sc_id_to"], "__n").withColumn("r_id", S.entity_id(F.col("__n") + 1 + current_max, "R")).drop("__n")
    reactions = r.select("r_id", F.concat(F.col("s_name"), F.lit(" transport")).alias("r_name"), F.lit(True).alias("r_isreversible"))
    both = F.explode(F.array(F.struct(F.col("sc_id_from").alias("sc_id"), F.lit(-1.0).alias("stoichiometry"), F.lit(V.ROLE_CODES["reactant"]).alias("sbo_term")), F.struct(F.col("sc_id_to").alias("sc_id"), F.lit(1.0).alias("stoichiometry"), F.lit(V.ROLE_CODES["product"]).alias("sbo_term"))))
    return reactions, r.select("r_id", both.alias("x")).select("r_id", "x.*")
