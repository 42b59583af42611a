"""Readers of the formats that pathway data come in, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[name] = f
        return f

    return register


def read(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


@reader("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("json")
def json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


@reader("tsv")
def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", header).option("encoding", encoding)
    return (r.schema(schema) if schema else r).csv(path)


@reader("csv")
def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    r = spark.read.option("sep", sep).option("header", True)
    return (r.schema(schema) if schema else r).csv(path)


@reader("skipping")
def skipping(spark: SparkSession, path: str, skip: int, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited text with banner lines before a header that is given here instead: lines are
    dropped by their number in the file, which is known where they are read."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    parts = F.split("line", f"\\Q{sep}\\E", -1)
    return text.where((F.col("n") > skip) & (F.trim("line") != "")).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


@reader("signed_pairs")
def signed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV: from, to, sign, reference; exact repeats go."""
    return spark.read.option("sep", "\t").schema("src string, dst string, sign string, reference string").csv(path).distinct()


@reader("scored_pairs")
def scored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated protein pairs with scores."""
    return spark.read.option("sep", " ").option("header", True).option("inferSchema", True).csv(path)


@reader("expression")
def expression(spark: SparkSession, path: str) -> DataFrame:
    """Tissue expression after two banner lines, ids without their versions, long: gene, name,
    tissue, value (null if it is no number)."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    head = text.where("n = 2").select(F.split("line", "\t", -1).alias("names"))
    rows = text.where("n > 2").select(F.split("line", "\t", -1).alias("x")).withColumn("k", F.lit(1)).join(F.broadcast(head.withColumn("k", F.lit(1))), "k")
    long = rows.select(F.regexp_replace(F.get("x", F.lit(0)), r"\.[0-9]+$", "").alias("gene"), F.get("x", F.lit(1)).alias("name"), F.posexplode(F.arrays_zip(F.slice("names", 3, 100000).alias("t"), F.slice("x", 3, 100000).alias("v"))).alias("at", "p"))
    return long.select("gene", "name", F.col("p.t").alias("tissue"), F.col("p.v").try_cast("double").alias("value"))


@reader("locations")
def locations(spark: SparkSession, path: str, values: list[str] | None = None) -> DataFrame:
    """Genes by cellular locations as 0/1, from ``;`` lists."""
    from ..operators.transforms import presence_table

    df = tsv(spark, path)
    if values is None:
        values = sorted(r[0] for r in df.select(F.explode(F.split("GO id", ";")).alias("v")).select(F.trim("v")).distinct().collect())
    return presence_table(df.select(F.col("Gene").alias("gene"), F.col("GO id").alias("go")), "gene", "go", values)


# --- OBO -------------------------------------------------------------------------


@reader("obo")
def obo(spark: SparkSession, path: str) -> DataFrame:
    """id, name, namespace, comment, is_a (array), is_obsolete of the terms of an OBO file; a
    child of an obsolete term is obsolete."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    lines = F.split(F.trim("value"), "\n")

    def of(key: str) -> Column:
        hits = F.filter(lines, lambda x: x.startswith(f"{key}: "))
        return F.transform(hits, lambda x: F.substr(x, F.lit(len(key) + 3)))

    terms = stanza.select(
        F.get(of("id"), F.lit(0)).alias("id"),
        F.get(of("name"), F.lit(0)).alias("name"),
        F.get(of("namespace"), F.lit(0)).alias("namespace"),
        F.get(of("comment"), F.lit(0)).alias("comment"),
        F.transform(of("is_a"), lambda x: F.trim(F.get(F.split(x, "!"), F.lit(0)))).alias("is_a"),
        F.coalesce(F.get(of("is_obsolete"), F.lit(0)) == "true", F.lit(False)).alias("is_obsolete"),
    )
    dead = terms.where("is_obsolete").select(F.col("id").alias("p"))
    under = terms.select("id", F.explode("is_a").alias("p")).join(dead, "p", "left_semi").select("id").distinct().withColumn("__dead", F.lit(True))
    return terms.join(under, "id", "left").withColumn("is_obsolete", F.col("is_obsolete") | F.coalesce("__dead", F.lit(False))).drop("__dead")


def obo_parents(terms: DataFrame, namespace: str | None = None) -> DataFrame:
    """child, parent of the terms in use."""
    t = terms.where(~F.col("is_obsolete"))
    if namespace:
        t = t.where(F.col("namespace") == namespace)
    return t.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))


# --- XML -------------------------------------------------------------------------

_ANNOTATION = r'resource="([^"]+)"'


def _attribute(tag: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col(tag), rf'(?s)^<[^>]*?\s{name}="([^"]*)"', 1), F.lit(""))



@reader("sbml")
def sbml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of SBML models, one file a row (a file is one model of some MB): compartments,
    compartmentalized species, reactions and participants.  Reactants get their stoichiometry
    negated, modifiers 0; a species without a compartment has a null one."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())

    def block(tag: str) -> Column:
        return F.regexp_extract("value", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)

    def rows(outer: str, tag: str) -> DataFrame:
        # a self-closing element ends at its own "/>", one with content at its end tag
        found = F.regexp_extract_all(block(outer), F.lit(rf"(?s)(<{tag}\s[^>]*?/>|<{tag}[\s>].*?</{tag}>)"), F.lit(1))
        return docs.select("file", F.explode(found).alias("x"))

    c = rows("listOfCompartments", "compartment").select("file", _attribute("x", "id").alias("c_id"), _attribute("x", "name").alias("c_name"), F.regexp_extract_all("x", F.lit(_ANNOTATION), F.lit(1)).alias("urls"))
    s = rows("listOfSpecies", "species").select("file", _attribute("x", "id").alias("sc_id"), _attribute("x", "name").alias("sc_name"), _attribute("x", "compartment").alias("c_id"), F.regexp_extract_all("x", F.lit(_ANNOTATION), F.lit(1)).alias("urls"))
    r = rows("listOfReactions", "reaction").select("file", _attribute("x", "id").alias("r_id"), _attribute("x", "name").alias("r_name"), (F.coalesce(_attribute("x", "reversible"), F.lit("true")) == "true").alias("r_isreversible"), "x")

    def members(outer: str, tag: str, sign: float, code: str) -> DataFrame:
        inside = F.regexp_extract("x", rf"(?s)<{outer}[^>]*>(.*?)</{outer}>", 1)
        found = F.regexp_extract_all(inside, F.lit(rf"(?s)(<{tag}\s[^>]*?>)"), F.lit(1))
        m = r.select("file", "r_id", F.explode(found).alias("m"))
        amount = F.coalesce(_attribute("m", "stoichiometry").try_cast("double"), F.lit(1.0))
        return m.select("file", "r_id", _attribute("m", "species").alias("sc_id"), (amount * sign).alias("stoichiometry"), F.coalesce(_attribute("m", "sboTerm"), F.lit(code)).alias("sbo_term"))

    p = members("listOfReactants", "speciesReference", -1.0, "SBO:0000010").unionByName(members("listOfProducts", "speciesReference", 1.0, "SBO:0000011")).unionByName(members("listOfModifiers", "modifierSpeciesReference", 0.0, "SBO:0000019"))
    return {"compartments": c, "compartmentalized_species": s, "reactions": r.drop("x"), "reaction_species": p}


@reader("psi_mi")
def psi_mi(spark: SparkSession, path: str) -> DataFrame:
    """Interactions of PSI-MI XML files, a row for each participant: interaction, interactor,
    its role and short label.  Spark's XML source reads an entry a row."""
    entries = spark.read.format("xml").option("rowTag", "interaction").option("attributePrefix", "_").load(path)
    p = entries.select(F.col("_id").alias("interaction"), F.explode(F.col("participantList.participant")).alias("p"))
    return p.select("interaction", F.col("p.interactorRef").alias("interactor"), F.col("p.biologicalRole.names.shortLabel").alias("role"))


# --- manifests, gene sets, others ------------------------------------------------

MANIFEST = "file string, data_source string, organismal_species string, pathway_id string, name string, date string"


@reader("manifest")
def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The table of a collection's models, by its columns' names."""
    df = tsv(spark, path)
    missing = [c.split()[0] for c in MANIFEST.split(", ") if c.split()[0] not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df.select(*[F.col(c.split()[0]).cast("string") for c in MANIFEST.split(", ")])


def filter_manifest(df: DataFrame, data_sources: list[str] | None = None, species: list[str] | None = None, text: str | None = None) -> DataFrame:
    if data_sources:
        df = df.where(F.col("data_source").isin(data_sources))
    if species:
        df = df.where(F.col("organismal_species").isin(species))
    return df.where(F.col("name").rlike(f"(?i){text}")) if text else df


@reader("gmt")
def gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets, a line each: name, description, members; long: geneset, member."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("geneset"), F.explode(F.slice(parts, F.lit(3), F.size(parts))).alias("member")).where("member <> ''").distinct()


@reader("yeast")
def yeast(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width gene names between the second rule of a text file and the next blank line:
    names (array), locus, protein, registry id."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)(?:_{3,}[ _]*\r?\n.*?){1}_{3,}[ _]*\r?\n(.*?)\r?\n\r?\n", 1)
    line = F.explode(F.split(body, "\r?\n"))
    name = F.trim(F.substring("line", 1, 75))
    rest = F.split(F.trim(F.substring("line", 76, 1000)), r"\s+")
    return whole.select(line.alias("line")).where(F.trim("line") != "").select(F.transform(F.split(name, ";"), lambda x: F.trim(x)).alias("names"), F.get(rest, F.lit(0)).alias("locus"), F.get(rest, F.lit(1)).alias("protein"), F.get(rest, F.lit(3)).alias("registry"))


@reader("mirna_page")
def mirna_page(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A page whose first paragraph holds a table, lines ended by ``<br>``, fields by tabs."""
    body = F.regexp_replace(F.regexp_extract(F.col("value"), r"(?s)<p>(.*?)</p>", 1), r"<br\s*/?>", "\n")
    parts = F.split("line", "\t", -1)
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(body, "\n")).alias("line")).where(F.trim("line") != "")
    return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


@reader("set_members")
def set_members(spark: SparkSession, path: str) -> DataFrame:
    needed = ["set_name", "set_id", "member_name", "member_id", "identifier", "ontology"]
    df = csv(spark, path)
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df.select(*needed)


@reader("dataset")
def dataset(
    spark: SparkSession,
    path: str,
    skip: int = 0,
    rename: dict[str, str] | None = None,
    without: list[str] | None = None,
    text: list[str] | None = None,
    extract: dict[str, tuple[str, str]] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """A TSV by declaration: banner lines to skip after the header, columns to rename, leave
    out or read as text, and new columns from a pattern's group in others."""
    df = spark.read.option("sep", "\t").option("header", True).option("encoding", encoding).option("inferSchema", True).csv(path)
    if skip:
        first = df.columns[0]
        df = df.withColumn("__n", F.monotonically_increasing_id()).where((F.col("__n") >= skip) & F.col(first).isNotNull()).drop("__n")
    for name, (column, pattern) in (extract or {}).items():
        df = df.withColumn(name, F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")))
    df = df.drop(*(without or []))
    for column in text or []:
        df = df.withColumn(column, F.col(column).cast("string"))
    return df.withColumnsRenamed(rename or {})


def extension(url: Column) -> Column:
    """The file extension of an address, with ``.gz`` and the like kept on."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+(?:\.(?:gz|zip|bz2))?)$", 1)
