"""String, identifier and URL expressions over columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def mapped(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A lookup in a small fixed table, as chained conditions that Catalyst folds."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def nameness(name: Column) -> Column:
    """How little a string looks like a name: its length, 10 if it has no white space,
    5 for every digit."""
    return F.length(name) + F.when(name.rlike(r"\s"), 0).otherwise(10) + 5 * F.regexp_count(name, F.lit("[0-9]"))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern; an error if there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit(f"no match of {pattern} in "), text)).cast("string"))


def match_first_rule(text: Column, rules: Mapping[str, str]) -> Column:
    """The value of the first pattern, in order, that the text matches."""
    out = None
    for pattern, value in rules.items():
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def joined_set(values: Column, sep: str = " OR ") -> Column:
    """Distinct non-null values, sorted and joined; null if there are none."""
    kept = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def entity_id(number: Column, prefix: str, width: int = 8) -> Column:
    """Prefix and zero-padded number."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def entity_number(identifier: Column) -> Column:
    """The number of an id, null if it has none."""
    return F.regexp_extract(identifier, r"^[A-Za-z]+([0-9]+)$", 1).try_cast("long")


def with_stoichiometry(stoichiometry: Column, name: Column) -> Column:
    """A participant's label: its amount in front, unless that is -1, 0 or 1."""
    amount = F.abs(stoichiometry)
    shown = F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(amount.cast("string"))
    return F.when(stoichiometry.isin(-1, 0, 1), name).otherwise(F.concat_ws(" ", shown, name))


def role_rule(code: Column) -> Column:
    return mapped(code, {V.ROLE_CODES[n]: r for n, r in V.ROLE_RULES.items()}, "OPTIONAL")


def role_name(code: Column) -> Column:
    return mapped(code, V.ROLE_NAMES)


def link_polarity(code: Column) -> Column:
    return mapped(code, {V.ROLE_CODES[n]: p for n, p in V.ROLE_POLARITY.items()}, "bystander")


def interaction_name(upstream: Column, downstream: Column, code: Column) -> Column:
    symbol = mapped(link_polarity(code), V.POLARITY_SYMBOLS, "--")
    return F.concat_ws(" ", upstream, symbol, downstream)


def species_type(identifiers: Column) -> Column:
    """The type that an identifier array's ontologies speak for: a prioritised type alone if
    one is seen, the only type seen, ``other`` for several types or none that is known, and
    ``unknown`` without identifiers."""
    ontologies = F.transform(identifiers, lambda x: x["ontology"])
    seen = {t: F.arrays_overlap(ontologies, F.array(*[F.lit(o) for o in names])) for t, names in V.SPECIES_ONTOLOGIES.items()}
    first = F.coalesce(*[F.when(seen[t], F.lit(t)) for t in V.PRIORITISED_TYPES], F.lit(None).cast("string"))
    n_first = sum((seen[t].cast("int") for t in V.PRIORITISED_TYPES), F.lit(0))
    rest = [t for t in V.SPECIES_ONTOLOGIES if t not in V.PRIORITISED_TYPES]
    n_rest = sum((seen[t].cast("int") for t in rest), F.lit(0))
    other = F.coalesce(*[F.when(seen[t], F.lit(t)) for t in rest], F.lit("other"))
    return (
        F.when(identifiers.isNull() | (F.size(identifiers) == 0), "unknown")
        .when(n_first == 1, first)
        .when(n_first > 1, "other")
        .when(n_rest > 1, "other")
        .otherwise(other)
    )


def string_weight(score: Column) -> Column:
    """A confidence score as an edge weight: 250000 / score ^ 1.7."""
    return 250000.0 / F.pow(score, F.lit(1.7))


def string_weight_inverse(score: Column) -> Column:
    return 1.0 / (score / 1000.0)


#: Named transformations of edge and vertex attributes.
TRANSFORMATIONS = {"identity": lambda c: c, "string": string_weight, "string_inv": string_weight_inverse}


# --- URLs ------------------------------------------------------------------------

#: Host, then a pattern of the whole address whose group 1 is the
#: identifier, then the ontology.  The first rule that matches counts.
URL_RULES = (
    ("www.ebi.ac.uk", r"[Cc][Hh][Ee][Bb][Ii]:([0-9]+)", "chebi"),
    ("www.ebi.ac.uk", r"QuickGO/term/(GO:[0-9]{7})", "go"),
    ("www.ebi.ac.uk", r"/intact/[^?]*?(EBI-[0-9]+)", "intact"),
    ("reactome.org", r"(R-[A-Z]{3}-[0-9]+)", "reactome"),
    ("www.reactome.org", r"(R-[A-Z]{3}-[0-9]+)", "reactome"),
    ("purl.uniprot.org", r"/uniprot/([A-Z0-9]+)", "uniprot"),
    ("www.uniprot.org", r"/uniprot[kb]*/([A-Z0-9]+)", "uniprot"),
    ("www.ncbi.nlm.nih.gov", r"/gene/([0-9]+)", "ncbi_entrez_gene"),
    ("www.ncbi.nlm.nih.gov", r"/pubmed/([0-9]+)", "pubmed"),
    ("www.ncbi.nlm.nih.gov", r"/books/([0-9A-Z]+)", "ncbi_books"),
    ("www.ncbi.nlm.nih.gov", r"term=([A-Z]{14}-[A-Z]{10}-[A-Z])", "ncbi_entrez_pccompound"),
    ("pubchem.ncbi.nlm.nih.gov", r"/compound/([0-9]+)", "pubchem"),
    ("www.chemspider.com", r"/([0-9]+)", "chemspider"),
    ("doi.org", r"doi\.org/(.+)$", "doi"),
    ("dx.doi.org", r"dx\.doi\.org/(.+)$", "dx_doi"),
    ("rnacentral.org", r"/rna/([^/]+)", "rnacentral"),
    ("www.thesgc.org", r"/structure_description/([0-9A-Z]+)", "sgc"),
    ("www.phosphosite.org", r"siteAction.action\?id=([0-9]+)", "phosphosite"),
    ("www.phosphosite.org", r"proteinAction.do\?id=([0-9]+)", "phosphosite_kinase"),
    ("www.genome.jp", r"\?([A-Za-z0-9:]+)$", "genome_net"),
    ("www.mirbase.org", r"acc=(MI[A-Z0-9]+)", "mirbase"),
    ("www.mdpi.com", r"mdpi\.com/(.+)$", "mdpi"),
    ("signor.uniroma2.it", r"(SIGNOR-[A-Z0-9]+)", "signor"),
)


def parse_identifier_url(url: Column) -> Column:
    """struct(ontology, identifier) of an address; null if no rule knows it.  Addresses of
    identifiers.org name the ontology in the path, as ``/ontology/id`` or ``/ontology:id``."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    path = F.parse_url(url, F.lit("PATH"))
    ontology, identifier = None, None
    for site, pattern, name in URL_RULES:
        hit = (host == site) & url.rlike(pattern)
        got = F.regexp_extract(url, pattern, 1)
        ontology = F.when(hit, name) if ontology is None else ontology.when(hit, name)
        identifier = F.when(hit, got) if identifier is None else identifier.when(hit, got)
    old, new = r"^/([^/:]+)/(.+)$", r"^/([^/:]+):(.+)$"
    registry = host == "identifiers.org"
    for pattern in (old, new):
        ontology = ontology.when(registry & path.rlike(pattern), F.lower(F.regexp_extract(path, pattern, 1)))
        identifier = identifier.when(registry & path.rlike(pattern), F.regexp_extract(path, pattern, 2))
    return F.when(ontology.isNotNull(), F.struct(ontology.alias("ontology"), identifier.alias("identifier")))


#: Addresses of identifiers, and the pattern that an identifier must match.
URL_FORMS = {
    "bigg_metabolite": ("http://identifiers.org/bigg.metabolite/{}", None),
    "chebi": ("https://www.ebi.ac.uk/chebi/CHEBI:{}", "^[0-9]+$"),
    "chemspider": ("https://www.chemspider.com/{}", "^[0-9]+$"),
    "doi": ("https://doi.org/{}", None),
    "ec-code": ("https://identifiers.org/ec-code/{}", r"^[0-9]+\.[0-9]+\.[0-9]+(\.[0-9]+)?$"),
    "envipath": ("http://identifiers.org/envipath/{}", None),
    "go": ("https://www.ebi.ac.uk/QuickGO/term/{}", "^GO:[0-9]{7}$"),
    "mdpi": ("https://www.mdpi.com/{}", None),
    "ncbi_books": ("http://www.ncbi.nlm.nih.gov/books/{}/", "^[0-9A-Z]+$"),
    "ncbi_entrez_gene": ("https://www.ncbi.nlm.nih.gov/gene/{}", "^[0-9]+$"),
    "phosphosite": ("https://www.phosphosite.org/siteAction.action?id={}", "^[0-9]+$"),
    "pubchem": ("http://pubchem.ncbi.nlm.nih.gov/compound/{}", "^[0-9]+$"),
    "pubmed": ("http://www.ncbi.nlm.nih.gov/pubmed/{}", "^[0-9]+$"),
    "reactome": ("https://reactome.org/content/detail/{}", r"^R\-[A-Z]{3}\-[0-9]{7}$"),
    "rnacentral": ("https://rnacentral.org/rna/{}", None),
    "uniprot": ("https://purl.uniprot.org/uniprot/{}", "^[A-Z0-9]+$"),
    "url": ("{}", None),
}


def identifier_url(ontology: Column, identifier: Column) -> Column:
    """The address of an identifier; null if its ontology has none or its form is wrong."""
    out = None
    for name, (form, pattern) in URL_FORMS.items():
        before, after = form.split("{}")
        fine = (ontology == name) & (identifier.rlike(pattern) if pattern else F.lit(True))
        made = F.concat(F.lit(before), identifier, F.lit(after))
        out = F.when(fine, made) if out is None else out.when(fine, made)
    return out


def ensembl_parts(identifier: Column) -> Column:
    """struct(id, kind, organism prefix) of a stable gene, transcript or protein id."""
    pattern = r"(ENS([A-Z]{0,3}?)([GTP])[0-9]{11})"
    kind = mapped(F.regexp_extract(identifier, pattern, 3), {"G": "ensembl_gene", "T": "ensembl_transcript", "P": "ensembl_protein"})
    return F.when(identifier.rlike(pattern), F.struct(F.regexp_extract(identifier, pattern, 1).alias("id"), kind.alias("kind"), F.regexp_extract(identifier, pattern, 2).alias("organism")))


def snippet(text: Column, query: Column, context: int = 100) -> Column:
    """What stands around the first occurrence of ``query`` (in any case), with ellipses
    where it is cut; the start of the text if it doesn't occur."""
    at = F.position(F.lower(query), F.lower(text))
    start = F.greatest(F.lit(1), at - context)
    stop = F.least(F.length(text), at + F.length(query) - 1 + context)
    inside = F.substr(text, start, stop - start + 1)
    found = F.concat(F.when(start > 1, "...").otherwise(""), inside, F.when(stop < F.length(text), "...").otherwise(""))
    head = F.concat(F.substr(text, F.lit(1), F.lit(2 * context)), F.when(F.length(text) > 2 * context, "...").otherwise(""))
    return F.when(at == 0, head).otherwise(found)
