"""Controlled vocabularies.  Fixed values: results depend on them as they stand."""

from __future__ import annotations

# --- fixed values: participant roles ---------------------------------------------

ROLE_CODES = {
    "catalyst": "SBO:0000013",
    "inhibitor": "SBO:0000020",
    "interactor": "SBO:0000336",
    "modified": "SBO:0000644",
    "modifier": "SBO:0000019",
    "product": "SBO:0000011",
    "reactant": "SBO:0000010",
    "stimulator": "SBO:0000459",
}
ROLE_NAMES = {code: name for name, code in ROLE_CODES.items()}
ROLE_POLARITY = {
    "catalyst": "activation",
    "inhibitor": "inhibition",
    "interactor": "ambiguous",
    "modified": "ambiguous",
    "modifier": "ambiguous",
    "product": "activation",
    "reactant": "activation",
    "stimulator": "activation",
}
POLARITY_SYMBOLS = {"activation": "->", "inhibition": "-|", "ambiguous": "--"}
#: How a reaction depends on its participants of a role.
ROLE_RULES = {
    "reactant": "DEFINING",
    "product": "DEFINING",
    "interactor": "DEFINING",
    "catalyst": "REQUIRED",
    "inhibitor": "OPTIONAL",
    "stimulator": "OPTIONAL",
    "modified": "DEFINING",
    "modifier": "OPTIONAL",
}

# --- fixed values: identifier qualifiers, best first -----------------------------

QUALIFIER_RANK = {
    "BQB_IS": 1,
    "BQB_ENCODES": 2,
    "BQB_IS_ENCODED_BY": 2,
    "BQB_HAS_PART": 3,
    "BQB_IS_HOMOLOG_TO": 4,
    "BQB_HAS_PROPERTY": 5,
    "BQB_IS_PROPERTY_OF": 5,
    "BQB_IS_PART_OF": 5,
    "BQB_OCCURS_IN": 5,
    "BQB_IS_DESCRIBED_BY": 6,
    "BQB_HAS_VERSION": 6,
    "BQB_IS_VERSION_OF": 6,
    "BQB_HAS_TAXON": 7,
    "BQB_UNKNOWN": 8,
}
DEFINING = ("BQB_IS", "BQB_IS_HOMOLOG_TO")
DEFINING_LOOSE = ("BQB_IS", "BQB_IS_HOMOLOG_TO", "BQB_IS_ENCODED_BY", "BQB_ENCODES")

# --- fixed values: species types -------------------------------------------------

SPECIES_ONTOLOGIES = {
    "complex": ("corum",),
    "drug": ("drugbank", "kegg.drug"),
    "metabolite": ("bigg_metabolite", "chebi", "kegg", "pubchem", "smiles"),
    "protein": ("ensembl_gene", "ensembl_transcript", "ensembl_protein", "ncbi_entrez_gene", "uniprot", "symbol", "gene_name"),
    "regulatory_rna": ("mirbase", "rnacentral"),
}
#: If one of these is seen, the other types are ignored.
PRIORITISED_TYPES = ("drug", "complex")
ONTOLOGY_ALIASES = {
    "ncbigene": "ncbi_entrez_gene",
    "ncbi_gene": "ncbi_entrez_gene",
    "ensembl_gene_id": "ensembl_gene",
    "Uniprot": "uniprot",
    "CORUM": "corum",
    "SIGNOR": "signor",
}

# --- fixed values: wiring, upstream tiers first ----------------------------------

TIERS = {
    "bipartite": (("catalyst", "inhibitor", "interactor", "modifier", "reactant", "stimulator"), ("reaction",), ("modified", "product")),
    "regulatory": (("inhibitor", "modifier", "stimulator"), ("catalyst",), ("interactor", "reactant"), ("reaction",), ("modified", "product")),
    "surrogate": (("inhibitor", "modifier", "stimulator"), ("interactor", "reactant"), ("catalyst",), ("reaction",), ("modified", "product")),
}
DROP_MODES = ("always", "edgelist", "same_tier")
LINK_POLARITIES = ("activation", "inhibition", "ambiguous", "bystander")

# --- fixed values: base score and multipliers of topology weights ----------------

TOPOLOGY = {"base": 2.0, "protein": 1.0, "metabolite": 3.0, "drug": 1.0, "complex": 3.0, "unknown": 10.0}

# --- fixed values: cofactors (name to CHEBI numbers) and their rules -------------

COFACTORS = {
    "acetyl-CoA": (15351,),
    "ADP": (456216, 16761),
    "AMP": (16027,),
    "ATP": (30616, 15422),
    "Cl-": (29311,),
    "CO2": (16526,),
    "CoA": (1146900, 57287),
    "FAD": (16238,),
    "FADH2": (17877,),
    "GDP": (17552,),
    "Glu": (29985,),
    "Gln": (58359,),
    "GSH": (16856,),
    "GSSG": (17858,),
    "GTP": (15996,),
    "H2CO3": (28976,),
    "HCO3": (17544,),
    "H+": (15378, 24636),
    "NAD+": (57540, 15846),
    "NADH": (57945, 16908),
    "NADP+": (18009, 58349),
    "NADPH": (16474,),
    "Na+": (29101,),
    "O2": (15379,),
    "PO4": (18367,),
    "PPi": (29888, 18361),
    "SAH": (16680,),
    "SAM": (15414,),
    "UDP": (17659,),
    "water": (15377, 16234),
}
#: rule: (all present, none present, present as a substrate)
COFACTOR_RULES = {
    "ATP PO4 donation": (("ATP", "ADP"), ("AMP",), ()),
    "GTP PO4 donation": (("GTP", "GDP"), (), ()),
    "ATP PPi donation": (("ATP", "AMP"), ("ADP",), ()),
    "NADH H- donation": (("NADH", "NAD+"), (), ("NADH",)),
    "NADPH H- donation": (("NADPH", "NADP+"), (), ("NADPH",)),
    "SAH methyltransferase": (("SAH", "SAM"), (), ()),
    "Glutathione oxidation": (("GSSG", "GSH"), ("NADPH",), ()),
    "Water": (("water",), (), ()),
    "PO4": (("PO4",), (), ()),
    "PPi": (("PPi",), (), ()),
    "H+": (("H+",), (), ()),
    "O2": (("O2",), (), ()),
    "CO2": (("CO2",), (), ()),
    "Na+": (("Na+",), (), ()),
    "Cl-": (("Cl-",), (), ()),
    "CoA": (("CoA",), (), ()),
    "HCO3-": (("HCO3",), (), ()),
}
