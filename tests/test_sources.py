from pathloom.model import PathwayModel
from pathloom.operators import search, transforms
from pathloom.sources import readers

SBML = """<sbml><model><listOfCompartments><compartment id="c" name="cytosol"/></listOfCompartments>
<listOfSpecies><species id="a" name="A [cytosol]" compartment="c"><annotation resource="https://x/CHEBI:1"/></species><species id="b" name="B [cytosol]" compartment="c"/></listOfSpecies>
<listOfReactions><reaction id="r" name="rx" reversible="false"><listOfReactants><speciesReference species="a" stoichiometry="2"/></listOfReactants>
<listOfProducts><speciesReference species="b"/></listOfProducts><listOfModifiers><modifierSpeciesReference species="a"/></listOfModifiers></reaction></listOfReactions></model></sbml>"""
OBO = "format-version: 1.2\n\n[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nname: child\nis_a: X:1 ! root\nis_obsolete: true\n\n[Term]\nid: X:3\nname: leaf\nis_a: X:2 ! child\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_sbml(spark, tmp_path, rows):
    t = readers.read(spark, "sbml", put(tmp_path / "m.xml", SBML))
    assert rows(t["compartments"], "c_id", "c_name") == [("c", "cytosol")]
    assert rows(t["compartmentalized_species"], "sc_id", "c_id") == [("a", "c"), ("b", "c")]
    assert t["compartmentalized_species"].where("sc_id = 'a'").first().urls == ["https://x/CHEBI:1"]
    assert rows(t["reaction_species"], "sc_id", "stoichiometry") == [("a", -2.0), ("a", 0.0), ("b", 1.0)]
    assert rows(t["reactions"], "r_id", "r_isreversible") == [("r", False)]


def test_obo(spark, tmp_path, rows):
    terms = readers.read(spark, "obo", put(tmp_path / "t.obo", OBO))
    assert rows(terms, "id", "is_obsolete") == [("X:1", False), ("X:2", True), ("X:3", True)]
    assert rows(readers.obo_parents(terms)) == []


def test_expression_and_sets(spark, tmp_path, rows):
    text = "#1.2\n2\t2\nName\tDescription\tLiver\tSkin\nENSG1.3\tx\t1.5\tbad\n"
    e = readers.read(spark, "expression", put(tmp_path / "e.gct", text))
    assert rows(e) == [("ENSG1", "x", "Liver", 1.5), ("ENSG1", "x", "Skin", None)]
    g = readers.read(spark, "gmt", put(tmp_path / "s.gmt", "one\t\ta\tb\ntwo\t\ta\n"))
    assert rows(g) == [("one", "a"), ("one", "b"), ("two", "a")]


def test_model_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", "a -- b"), ("b", "c", "b -- c")], "name_upstream string, name_downstream string, r_name string")
    s = spark.createDataFrame([("a",), ("b",), ("c",), ("unused",)], "s_name string")
    c = spark.createDataFrame([("cellular_component",)], "c_name string")
    model = PathwayModel(transforms.model_from_edgelist(e, s, c))
    model.validate()
    model.save(str(tmp_path / "m"))
    again = PathwayModel.load(spark, str(tmp_path / "m"))
    assert again.faults() == []
    gone = again["species"].where("s_name = 'a'").select("s_id")
    less = again.remove_species(gone)
    assert {r["table"]: r.n_rows for r in less.profile().collect()} == {"compartments": 1, "species": 2, "compartmentalized_species": 2, "reactions": 1, "reaction_species": 2}


def test_chunks_keep_the_words():
    text = "intro\n\n## One\n" + "word " * 400 + "\n\nlast paragraph.\n## Two\nshort"
    parts = search.chunk(text, 300)
    assert all(len(p) <= 360 for p in parts)
    assert " ".join(parts).split() == text.split()
