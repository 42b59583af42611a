from pyspark.sql import functions as F

from pathloom.operators import consensus, integrity, search
from pathloom.sources import readers

IDENT = "array<struct<ontology:string,identifier:string,url:string,bqb:string>>"


def test_one_compartment_for_all(spark, rows):
    sc = [("a1", "A [x]", "a", "x"), ("a2", "A [y]", "a", "y"), ("b1", "B [x]", "b", "x"), ("b2", "B [y]", "b", "y")]
    p = [("t", "a1", -1.0, "SBO:0000010"), ("t", "a2", 1.0, "SBO:0000011"), ("r1", "a1", -1.0, "SBO:0000010"), ("r1", "b1", 1.0, "SBO:0000011"), ("r2", "a2", -1.0, "SBO:0000010"), ("r2", "b2", 1.0, "SBO:0000011")]
    model = consensus.Model(
        spark.createDataFrame([("x", "x"), ("y", "y")], "c_id string, c_name string"),
        spark.createDataFrame([("a", "A"), ("b", "B")], "s_id string, s_name string"),
        spark.createDataFrame(sc, "sc_id string, sc_name string, s_id string, c_id string"),
        spark.createDataFrame([("t", "move", True), ("r1", "make", False), ("r2", "make", True)], "r_id string, r_name string, r_isreversible boolean"),
        spark.createDataFrame(p, "r_id string, sc_id string, stoichiometry double, sbo_term string"),
    )
    out = consensus.uncompartmentalise(model)
    assert rows(out.reactions, "r_name", "r_isreversible") == [("make", True)]
    assert rows(out.participants, "sc_id", "stoichiometry") == [("SCa", -1.0), ("SCb", 1.0)]
    assert out.cspecies.count() == 2


def test_models_without_a_common_ontology(spark, rows):
    e = spark.createDataFrame([("m1", [("chebi", "1", None, "BQB_IS")]), ("m2", [("chebi", "2", None, "BQB_IS")]), ("m3", [("uniprot", "P", None, "BQB_IS")])], f"model string, identifiers {IDENT}")
    assert rows(consensus.unconnected_models(e)) == [(["m1", "m2"], ["chebi"]), (["m3"], ["uniprot"])]


def test_transport(spark, rows):
    sc = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("b", "b2"), ("c", "c1"), ("c", "c2"), ("d", "d1"), ("d", "d2"), ("d", "d3")], "s_id string, sc_id string")
    e = spark.createDataFrame([("b1", "r"), ("r", "b2"), ("c1", "q"), ("d1", "s"), ("s", "d2")], "src string, dst string")
    assert rows(integrity.transport_status(e, sc)) == [("a", "single"), ("b", "valid"), ("c", "unreachable"), ("d", "inadequate")]
    pairs = spark.createDataFrame([("c", "c1", "c2")], "s_id string, sc_id_from string, sc_id_to string")
    r, p = integrity.exchange_reactions(pairs, spark.createDataFrame([("c", "C")], "s_id string, s_name string"), 4)
    assert rows(r) == [("R00000005", "C transport", True)]
    assert rows(p, "sc_id", "stoichiometry") == [("c1", -1.0), ("c2", 1.0)]


def test_declared_dataset(spark, tmp_path, rows):
    (tmp_path / "d.tsv").write_text("Gene\tID\tnote\n#\t#\t#\nTP53_ENSG00000141510\t7157\tx\n")
    df = readers.read(spark, "dataset", str(tmp_path / "d.tsv"), skip=1, rename={"ID": "entrez"}, without=["note"], text=["ID"], extract={"ensembl": ("Gene", "(ENSG[0-9]{11})$")})
    assert rows(df, "entrez", "ensembl") == [("7157", "ENSG00000141510")]


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    embed = lambda df: df.withColumn("embedding", F.array(F.length("chunk").cast("float"), F.lit(1.0).cast("float")))
    path = str(tmp_path / "index")
    search.index(docs, embed, path, "docs")
    search.index(docs.limit(1), embed, path, "code")
    search.index(docs, embed, path, "docs")
    assert spark.read.parquet(path).count() == 3
    assert [r.doc_id for r in search.search_index(spark, path, [5.0, 1.0], 1, "docs").collect()] == [2]
