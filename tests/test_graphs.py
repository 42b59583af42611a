import pytest

from pathloom.operators import consensus, edgelist, propagation, search, summaries, traverse
from pathloom.operators.integrity import cascade, infer_compartments
from pathloom.operators.matching import bind_tables, resolve


def edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("s00", f"s{i:02d}") for i in range(1, 30)]
    got = {r.name: r.component for r in traverse.components(edges(spark, [*chain, *star, ("x", "x")])).collect()}
    assert {got[f"c{i:03d}"] for i in range(61)} == {"c000"}
    assert {got[f"s{i:02d}"] for i in range(30)} == {"s00"}
    assert got["x"] == "x"
    assert traverse.components(edges(spark, [])).count() == 0


def test_distances_and_paths(spark, rows):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.0), ("c", "d", 5.0), ("a", "d", 9.0)], "src string, dst string, weight double")
    d = traverse.distances(e, weight="weight")
    assert {(r.origin, r.dest): r.distance for r in d.collect()} == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 2, ("c", "d"): 5, ("a", "d"): 7, ("b", "d"): 6}
    hops = {(r.origin, r.dest): r.distance for r in traverse.distances(e).collect()}
    assert hops[("a", "d")] == 1
    targets = spark.createDataFrame([("d",)], "name string")
    paths = traverse.shortest_paths(e, "a", targets, "weight")
    assert sorted(">".join(r.path) for r in paths.collect()) == ["a>b>c>d", "a>c>d"]
    n = traverse.neighbours(e, spark.createDataFrame([("a",)], "name string"), 1)
    assert rows(n, "name", "hops") == [("a", 0), ("b", 1), ("c", 1), ("d", 1)]


def test_polarity_along_paths(spark):
    links = [(1, 1, "activation"), (1, 2, "inhibition"), (1, 3, "bystander"), (1, 4, "ambiguous"), (1, 5, "inhibition"), (2, 1, "ambiguous"), (2, 2, "ambiguous")]
    out = traverse.net_polarity(spark.createDataFrame(links, "path_id int, step int, link_polarity string"))
    got = [r.net_polarity for r in out.orderBy("path_id", "step").collect()]
    assert got == ["activation", "inhibition", "inhibition", "ambiguous inhibition", "ambiguous activation", "ambiguous", "ambiguous"]


def test_closure_finds_cycles(spark, rows):
    p = spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string")
    assert rows(traverse.closure(p)) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]
    with pytest.raises(ValueError, match="cycle"):
        traverse.closure(p.union(spark.createDataFrame([("a", "c")], "child string, parent string")))


def test_pagerank_is_a_distribution(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    v = spark.createDataFrame([(x,) for x in "abcde"], "name string")
    resets = spark.createDataFrame([("x", "a", 2.0), ("x", "b", 0.0), ("y", "e", 1.0)], "run string, name string, value double")
    got = {(r.run, r.name): r.value for r in propagation.pagerank(e, v, resets).collect()}
    assert sum(x for (run, _), x in got.items() if run == "x") == pytest.approx(1)
    assert got[("y", "e")] == pytest.approx(1)
    reset, p = {"a": 1.0}, dict.fromkeys("abcde", 0.0) | {"a": 1.0}
    out = {"a": "b", "b": "c", "c": "ad"}
    for _ in range(300):
        q = {n: (0.15 + 0.85 * sum(p[m] for m in "de")) * reset.get(n, 0) for n in p}
        for n, to in out.items():
            for m in to:
                q[m] += 0.85 * p[n] / len(to)
        p = q
    for n in p:
        assert got[("x", n)] == pytest.approx(p[n], abs=1e-6)


def test_permutations_keep_values_and_rewiring_keeps_degrees(spark):
    a = spark.createDataFrame([("t", f"v{i}", float(i)) for i in range(9)], "attribute string, name string, value double")
    out = propagation.permuted(a, 3)
    for s in range(3):
        assert sorted(r.value for r in out.where(f"sample = {s}").collect()) == [float(i) for i in range(9)]
    e = edges(spark, [(f"a{i}", f"b{(i + j) % 7}") for i in range(7) for j in (1, 2)])
    new = propagation.rewired(e, 2).where("sample = 1").drop("sample")
    assert sorted(map(tuple, edgelist.degrees(new).collect())) == sorted(map(tuple, edgelist.degrees(e).collect()))
    assert propagation.allocate(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3}


def test_cardinality_checks(spark):
    one = edges(spark, [("a", "b")])
    two = edges(spark, [("a", "b"), ("a", "b")])
    edgelist.check_cardinality(one, one, ["src", "dst"], "1:1")
    with pytest.raises(ValueError):
        edgelist.check_cardinality(two, one, ["src", "dst"], "1:1")
    with pytest.raises(ValueError):
        edgelist.check_cardinality(one, edges(spark, []), ["src", "dst"], "1:1")
    assert edgelist.has_duplicates(two) and not edgelist.has_duplicates(one)
    assert not edgelist.has_reciprocal(edges(spark, [("a", "a"), ("a", "b")]))
    assert edgelist.has_reciprocal(edges(spark, [("b", "a"), ("a", "b")]))


def test_weighted_mean_keeps_the_weights_of_nulls(spark):
    m = spark.createDataFrame([("s", 1, 4.0, True, "b"), ("s", 2, None, False, "a"), ("t", 2, 6.0, None, "c"), ("u", 3, None, None, "c")], "s_id string, feature_id int, x double, flag boolean, text string")
    got = {r.s_id: (r.x, r.flag, r.text, r.n_match) for r in resolve(m).collect()}
    assert got["s"] == (pytest.approx(4 / 1.5), True, "a,b", 2)
    assert got["t"][0] == 6.0
    assert got["u"][0] == 0.0
    side = bind_tables({"a": m.select("s_id", "x"), "b": m.select("s_id", "x")}, "s_id", "stagger")
    assert side.columns == ["s_id", "x_a", "x_b"]


def test_merging_two_models(spark):
    ident = "array<struct<ontology:string,identifier:string,url:string,bqb:string>>"
    x = lambda i: [("o", i, None, "BQB_IS")]

    def model(species, reversible):
        return consensus.Model(
            spark.createDataFrame([("c", "cytosol", x("GO:1"))], f"c_id string, c_name string, identifiers {ident}"),
            spark.createDataFrame(species, f"s_id string, s_name string, identifiers {ident}"),
            spark.createDataFrame([(f"sc{s[0]}", s[1], s[0], "c") for s in species], "sc_id string, sc_name string, s_id string, c_id string"),
            spark.createDataFrame([("r", "rx", reversible)], "r_id string, r_name string, r_isreversible boolean"),
            spark.createDataFrame([("r", f"sc{s[0]}", 1.0, "SBO:0000011") for s in species[:1]], "r_id string, sc_id string, stoichiometry double, sbo_term string"),
        )

    out = consensus.merge_models({"one": model([("1", "glucose123", x("G")), ("2", "none", [])], False), "two": model([("9", "glucose", x("G")), ("2", "none", [])], True)})
    assert out.compartments.count() == 1
    assert sorted(r.s_name for r in out.species.collect()) == ["glucose", "none", "none"]
    assert [r.r_isreversible for r in out.reactions.collect()] == [True]
    assert out.participants.count() == 1


def test_cascade_and_compartments(spark, rows):
    sc = spark.createDataFrame([("a1", "a", "c1"), ("b1", "b", "c1"), ("d1", "d", None)], "sc_id string, s_id string, c_id string")
    p = spark.createDataFrame([("x", "r1", "a1", -1.0, "SBO:0000010"), ("y", "r1", "b1", 1.0, "SBO:0000011"), ("z", "r2", "d1", 1.0, "SBO:0000011"), ("w", "r2", "b1", -1.0, "SBO:0000010")], "rsc_id string, r_id string, sc_id string, stoichiometry double, sbo_term string")
    out = cascade(spark.createDataFrame([("a",)], "s_id string"), sc, p)
    assert rows(out["reactions"]) == [("r1",)]
    assert rows(out["reaction_species"]) == [("x",), ("y",)]
    assert rows(out["compartmentalized_species"]) == [("a1",)]
    assert rows(infer_compartments(sc, p), "sc_id", "c_id")[-1] == ("d1", "c1")


def test_greedy_cover(spark, rows):
    m = spark.createDataFrame([("p", i) for i in range(5)] + [("q", i) for i in range(3, 9)] + [("r", 0)], "g string, m int")
    assert rows(summaries.set_cover(m, "g", "m", 2)) == [(0, "q", 6), (1, "p", 3)]


def test_pagerank_has_all_vertices_of_a_large_network(spark):
    v = spark.range(100_001).selectExpr("string(id) AS name")
    resets = spark.createDataFrame([("x", "0", 1.0)], "run string, name string, value double")
    out = propagation.pagerank(edges(spark, [("0", "1"), ("1", "2")]), v, resets, iterations=2, tolerance=0.0)
    assert out.count() == 100_001
    assert sorted(r.name for r in out.where("value > 0").collect()) == ["0", "1", "2"]


def test_distances_without_a_limit_go_all_the_way(spark):
    e = spark.createDataFrame([*((f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(54)), ("c00", "c54", 99.0)], "src string, dst string, w double")
    start = spark.createDataFrame([("c00",)], "name string")
    got = {r.sc_id_dest: (r.path_length, r.path_w) for r in traverse.hop_and_weight(e, ["w"], sources=start).collect()}
    assert got["c53"] == (53, 53) and got["c54"] == (1, 54)
    got = {r.sc_id_dest: (r.path_length, r.path_w) for r in traverse.hop_and_weight(e, ["w"], 1, start).collect()}
    assert got == {"c01": (1, 1), "c54": (1, 54)}
    with pytest.raises(ValueError, match="cycle"):
        traverse.distances(spark.createDataFrame([("a", "b", 1.0), ("b", "c", -2.0), ("c", "b", 1.0)], "src string, dst string, w double"), weight="w", max_steps=None)


def test_shortest_paths_of_any_length(spark):
    e = spark.createDataFrame([*((f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(22)), ("c22", "c21", 0.0), ("c21", "c22", 0.0)], "src string, dst string, w double")
    out = traverse.shortest_paths(e, "c00", spark.createDataFrame([("c22",)], "name string"), "w").collect()
    assert [r.path for r in out] == [[f"c{i:02d}" for i in range(23)]]


def test_nearest_takes_any_number_of_queries(spark):
    vectors = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.range(10_050).selectExpr("id AS vec_id", "if(id % 2 = 0, array(2D, 1D), array(1D, 2D)) AS embedding")
    out = search.nearest(vectors, queries, 1)
    assert out.count() == 10_050
    assert out.where("vec_id <> if(query_id % 2 = 0, -1, -2)").isEmpty()


def test_nearest_ranks_like_the_sql(spark, monkeypatch):
    """Copies, near ties, directions that are none, nulls; floors and merges in small steps."""
    import duckdb
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    v = rng.standard_normal((400, 8)).astype(np.float32)
    v[40:90] = v[40]  # more copies than k
    v[100:160] = v[100] * (1 + 1e-6 * rng.standard_normal((60, 8))).astype(np.float32)  # closer than single precision tells
    v[200:203] = 0
    lists = [None if i in (5, 210, 240) else v[i].tolist() for i in range(400)]
    for name, value in (("ROWS", 3), ("COLUMNS", 16), ("STARTERS", 8), ("CANDIDATES", 50)):
        monkeypatch.setattr(search, name, value)
    table = pa.table({"vec_id": pa.array(range(400), pa.int64()), "embedding": pa.array(lists, pa.list_(pa.float32()))})
    df = spark.createDataFrame(table).repartition(5)
    out = search.nearest(df, df.where("vec_id % 20 = 0"), 3)
    mine = sorted((r.query_id, r["rank"], r.vec_id, repr(r.score)) for r in out.collect())
    con = duckdb.connect()
    con.register("embeddings", table)
    theirs = con.execute(
        """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
        x AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))) AS s FROM embeddings, q WHERE vec_id <> query_id)
        SELECT query_id, r, vec_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM x) WHERE r <= 3"""
    ).fetchall()
    assert mine == sorted((q, r, i, repr(s)) for q, r, i, s in theirs)
    pairs = []
    add = search.Nearest._merge
    monkeypatch.setattr(search.Nearest, "_merge", lambda self, rows, *rest: (pairs.append(len(rows)), add(self, rows, *rest)))
    best = search.Nearest(np.arange(20), v[:20], np.zeros(20, bool), 3)
    best.add(np.arange(400), v, np.zeros(400, bool))
    assert 0 < sum(pairs) < 20 * 400 / 2  # most pairs are never scored one by one


def test_sets_of_species_take_a_member_once(spark, rows):
    from pathloom.operators import results

    sets = spark.createDataFrame([("g", "x")] * 50 + [("h", "x"), ("h", "y")], "geneset string, member string")
    known = spark.createDataFrame([("o", "x", "BQB_IS", i) for i in range(40)] + [("o", "y", "BQB_IS", 1)], "ontology string, identifier string, bqb string, s_id long")
    out = results.sets_of_species(sets, known, "o")
    assert rows(out) == sorted([(g, i) for g in "gh" for i in range(40)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]  # repeated members are gone before the join
