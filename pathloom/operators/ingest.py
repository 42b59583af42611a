"""Interactions, perturbations and identifiers of particular sources, as relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import multiplied

# --- protein pairs ---------------------------------------------------------------


def reciprocal_only_once(pairs: DataFrame, score: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Pairs that are listed in both directions, once; an error if one is listed one way only
    or with another score the other way."""
    back = pairs.select(F.col(dst).alias(src), F.col(src).alias(dst), score)
    if not pairs.join(back, [src, dst, score], "left_anti").isEmpty():
        raise ValueError("pairs that are not listed in both directions")
    return pairs.where(F.col(src) < F.col(dst))


def species_of_aliases(pairs: DataFrame, aliases: DataFrame, kinds: dict[str, tuple[str, str]], src: str = "src", dst: str = "dst") -> DataFrame:
    """s_name and its identifiers: all ends of the pairs with those aliases (protein, alias,
    source) whose source is a known kind (source: (ontology, qualifier))."""
    from ..functions.scalars import identifier_url, mapped

    ends = pairs.select(F.col(src).alias("protein")).union(pairs.select(F.col(dst).alias("protein"))).distinct()
    ontology = mapped(F.col("source"), {k: v[0] for k, v in kinds.items()})
    rows = aliases.where(F.col("source").isin(list(kinds))).select("protein", ontology.alias("ontology"), F.col("alias").alias("identifier"), mapped(F.col("source"), {k: v[1] for k, v in kinds.items()}).alias("bqb"))
    rows = rows.withColumn("url", identifier_url(F.col("ontology"), F.col("identifier")))
    arrays = rows.groupBy("protein").agg(F.array_sort(F.collect_set(F.struct("ontology", "identifier", "url", "bqb"))).alias("identifiers"))
    return ends.join(arrays, "protein", "left").select(F.col("protein").alias("s_name"), F.coalesce("identifiers", F.array()).alias("identifiers"))


def bait_and_prey(participants: DataFrame) -> DataFrame:
    """(study, a, b) with a < b: pairs of an experiment's participants if it has one bait and
    some prey, or exactly two participants; an experiment of one bait pairs it with each prey."""
    shape = participants.groupBy("study").agg(F.count_if(F.col("role") == "bait").alias("baits"), F.count_if(F.col("role") == "prey").alias("prey"), F.count(F.lit(1)).alias("n"))
    star = shape.where("baits = 1 AND prey > 0").select("study")
    bait = participants.where("role = 'bait'").join(star, "study", "left_semi").select("study", F.col("interactor").alias("x"))
    prey = participants.where("role = 'prey'").join(star, "study", "left_semi").select("study", F.col("interactor").alias("y"))
    two = shape.where("NOT (baits = 1 AND prey > 0) AND n = 2").select("study")
    duo = participants.join(two, "study", "left_semi").groupBy("study").agg(F.min("interactor").alias("x"), F.max("interactor").alias("y"))
    pairs = bait.join(prey, "study").unionByName(duo)
    return pairs.select("study", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cross_references(rows: DataFrame, aliases: dict[str, str], primary: list[str], secondary: list[str]) -> DataFrame:
    """(interactor, ontology, identifier) with ontologies by their canonical names: references
    of the primary ontologies, and of secondary ones for interactors that have a primary one."""
    from ..functions.scalars import mapped

    named = rows.where("identifier IS NOT NULL AND trim(identifier) <> ''").select("interactor", F.coalesce(mapped(F.col("ontology"), aliases), F.col("ontology")).alias("ontology"), F.trim("identifier").alias("identifier")).distinct()
    first = named.where(F.col("ontology").isin(primary))
    rest = named.where(F.col("ontology").isin(secondary)).join(first.select("interactor").distinct(), "interactor", "left_semi")
    return first.unionByName(rest)


# --- signed, directed interactions -----------------------------------------------


def annotated_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, role, score of annotated pairs (annotation, direction): an annotation that
    speaks for both directions gives both rows; of several rows for a pair the best scored."""
    from .transforms import annotation_roles

    rows = pairs.select("src", "dst", "score", F.explode(annotation_roles(F.col("annotation"), F.col("direction"))).alias("x"))
    turned = F.col("x.reverse")
    rows = rows.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.col("x.role").alias("role"), "score")
    w = Window.partitionBy("src", "dst").orderBy(F.desc("score"), "role")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def evidence_roles(directed: Column, stimulates: Column, inhibits: Column) -> Column:
    """struct(upstream, downstream, reversible) for the evidence flags of an interaction."""
    up = F.when(stimulates & ~inhibits, "stimulator").when(inhibits & ~stimulates, "inhibitor").when(stimulates & inhibits, "modifier").when(directed, "modifier").otherwise("interactor")
    acts = directed | stimulates | inhibits
    return F.struct(up.alias("upstream"), F.when(acts, "modified").otherwise("interactor").alias("downstream"), (~acts).alias("reversible"))


def repaired_consensus(df: DataFrame) -> DataFrame:
    """Consensus flags that both stand although neither evidence flag does are cleared."""
    wrong = F.col("consensus_stimulation") & F.col("consensus_inhibition") & ~F.col("is_stimulation") & ~F.col("is_inhibition")
    return df.withColumns({c: F.col(c) & ~wrong for c in ("consensus_stimulation", "consensus_inhibition")})


def listed_identifiers(df: DataFrame, key: str, column: str, aliases: dict[str, str], known: list[str]) -> DataFrame:
    """``name:id;name:id`` lists as (key, ontology, identifier) of known ontologies."""
    from ..functions.scalars import mapped
    from .transforms import annotation_rows

    rows = annotation_rows(df, key, column)
    return rows.select(key, F.coalesce(mapped(F.col("name"), aliases), F.lower("name")).alias("ontology"), F.col("value").alias("identifier")).where(F.col("ontology").isin(known))


def complex_members(df: DataFrame, key: str = "complex", members: str = "members", amounts: str = "stoichiometry") -> DataFrame:
    """(complex, member, stoichiometry): ``a_b`` with ``1:2``, amounts negative, 0 if unknown."""
    m, s = F.split(members, "_"), F.split(F.coalesce(amounts, F.lit("")), ":")
    return df.select(key, F.posexplode(m).alias("at", "member"), s.alias("__s")).select(key, "member", (-F.coalesce(F.get("__s", F.col("at")).try_cast("double"), F.lit(0.0))).alias("stoichiometry"))


def citations(df: DataFrame, keys: list[str], column: str = "references") -> DataFrame:
    """Distinct reference numbers of ``source:number;...`` fields, as identifier arrays."""
    one = df.select(*keys, F.explode(F.split(column, ";")).alias("r")).select(*keys, F.regexp_extract("r", "([0-9]+)$", 1).alias("i")).where("i <> ''").distinct()
    item = F.struct(F.lit("pubmed").alias("ontology"), F.col("i").alias("identifier"), F.concat(F.lit("http://www.ncbi.nlm.nih.gov/pubmed/"), F.col("i")).alias("url"), F.lit("BQB_IS_DESCRIBED_BY").alias("bqb"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("identifiers"))


# --- perturbations ---------------------------------------------------------------


def with_species(rows: DataFrame, identifiers: DataFrame, perturbed: str, target: str, ontology_a: str, ontology_b: str) -> DataFrame:
    """Both genes of a perturbation as species; parts of complexes don't count."""
    known = identifiers.where("bqb <> 'BQB_HAS_PART'").select("ontology", "identifier", "s_id").distinct()
    a = known.where(F.col("ontology") == ontology_a).select(F.col("identifier").alias(perturbed), F.col("s_id").alias("perturbed_species_id"))
    b = known.where(F.col("ontology") == ontology_b).select(F.col("identifier").alias(target), F.col("s_id").alias("target_species_id"))
    a, b = a.where("perturbed_species_id IS NOT NULL"), b.where("target_species_id IS NOT NULL")
    n = b.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    return multiplied(multiplied(rows, a, [perturbed], more=n or 0), b, [target], spread=False)


def least_p(rows: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(p).alias(p), F.count(F.lit(1)).alias("n_measurements"))


def trailing_gene(label: Column) -> Column:
    """The stable gene id at the end of a perturbation's label."""
    return F.nullif(F.regexp_extract(label, r"(ENSG[0-9]{11})$", 1), F.lit(""))


# --- gene and protein scaffolds --------------------------------------------------


def cluster_mappings(mappings: DataFrame, names: list[str]) -> DataFrame:
    """cluster, s_name, n_ids of identifiers that mappings (ontology_a, identifier_a,
    ontology_b, identifier_b) connect.  The name is of the first ontology in ``names`` that has
    one that no other cluster has, the most name-like of several; else the cluster."""
    from ..functions.scalars import mapped, nameness
    from .traverse import components

    node = lambda s: F.concat_ws("\u0001", f"ontology_{s}", f"identifier_{s}")
    c = components(mappings.select(node("a").alias("src"), node("b").alias("dst")))
    ids = c.select("component", F.split("name", "\u0001")[0].alias("ontology"), F.split("name", "\u0001")[1].alias("identifier")).distinct()
    alone = F.count(F.lit(1)).over(Window.partitionBy("ontology", "identifier")) == 1
    rank = mapped(F.col("ontology"), {n: i for i, n in enumerate(names)})
    best = ids.withColumn("__one", alone).where(rank.isNotNull() & F.col("__one")).groupBy("component").agg(F.min_by("identifier", F.struct(rank, nameness(F.col("identifier")), "identifier")).alias("s_name"))
    sizes = ids.groupBy("component").agg(F.count(F.lit(1)).alias("n_ids"))
    return sizes.join(best, "component", "left").select(F.col("component").alias("cluster"), F.coalesce("s_name", "component").alias("s_name"), "n_ids")


# --- curation --------------------------------------------------------------------


def parsed_reactions(df: DataFrame, key: str = "r_name", column: str = "formula") -> DataFrame:
    """``a + b -> c`` as (reaction, s_name, stoichiometry)."""
    sides = F.split(column, r"\s*-+>\s*")

    def side(i: int, sign: float) -> DataFrame:
        return df.select(key, F.explode(F.split(F.get(sides, F.lit(i)), r"\s*\+{1,2}\s*")).alias("s_name")).select(key, F.trim("s_name").alias("s_name"), F.lit(sign).alias("stoichiometry")).where("s_name <> ''")

    return side(0, -1.0).unionByName(side(1, 1.0))


def closed_removal(tables: dict[str, DataFrame], keys: dict[str, tuple[str, dict[str, str]]], start: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Keys to be removed: those given, and all rows whose references they are, until nothing
    is added.  ``keys``: table -> (its key, {foreign key: table})."""
    gone = {t: df.select(keys[t][0]).distinct() for t, df in start.items()}
    for _ in range(len(keys)):
        for t, (pk, fks) in keys.items():
            parts = [tables[t].join(gone[target].withColumnRenamed(keys[target][0], fk), fk, "left_semi").select(pk) for fk, target in fks.items() if target in gone]
            if t in gone:
                parts.append(gone[t])
            if parts:
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionByName(p)
                gone[t] = out.distinct()
    return gone


def set_membership_reactions(members: DataFrame, current_max: int) -> tuple[DataFrame, DataFrame]:
    """A reaction ``member IS A set`` for each row (set_id, set_name, member_id, member_name),
    and its two participants."""
    from ..functions.scalars import entity_id

    from ..runtime import numbered

    r = numbered(members.distinct(), ["set_id", "member_id"], "__n").withColumn("r_id", entity_id(F.col("__n") + 1 + current_max, "R")).drop("__n")
    reactions = r.select("r_id", F.concat_ws(" IS A ", "member_name", "set_name").alias("r_name"), F.lit(False).alias("r_isreversible"))
    both = F.explode(F.array(F.struct(F.col("member_id").alias("sc_id"), F.lit(-1.0).alias("stoichiometry"), F.lit("SBO:0000010").alias("sbo_term")), F.struct(F.col("set_id").alias("sc_id"), F.lit(1.0).alias("stoichiometry"), F.lit("SBO:0000011").alias("sbo_term"))))
    return reactions, r.select("r_id", both.alias("x")).select("r_id", "x.*")
