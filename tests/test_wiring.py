"""Wiring of reactions by role, on participants of one reaction each."""

import pytest

from pathloom import vocabulary as V
from pathloom.operators import wiring


def participants(spark, members):
    return spark.createDataFrame([("r", node, float(s), V.ROLE_CODES[role]) for role, node, s in members], "r_id string, sc_id string, stoichiometry double, sbo_term string")


BASE = [("reactant", "sub", -1), ("product", "prod", 1)]
CASES = {
    "pair": ([("interactor", "a", 0), ("interactor", "b", 0)], 1),
    "sub_and_prod": (BASE, 2),
    "stimulator": ([*BASE, ("stimulator", "stim", 0)], 3),
    "all": ([*BASE, ("stimulator", "stim", 0), ("catalyst", "cat", 0)], 4),
    "no_substrate": ([("product", "prod", 1), ("stimulator", "s1", 0), ("stimulator", "s2", 0), ("inhibitor", "i", 0), ("catalyst", "cat", 0)], 5),
    "single": ([("product", "lone", 1)], 0),
    "modifiers_only": ([("stimulator", "a", 0), ("inhibitor", "i", 0)], 0),
    "alike": ([("stimulator", "a", 0), ("stimulator", "b", 0), ("stimulator", "c", 0)], 3),
}


@pytest.mark.parametrize("case", CASES)
def test_regulatory_edge_counts(spark, case):
    members, n = CASES[case]
    assert wiring.wire(participants(spark, members)).count() == n


def test_dropping_the_reaction_bridges_over_it(spark, rows):
    p = participants(spark, [*BASE, ("catalyst", "cat", 0)])
    assert rows(wiring.wire(p, "regulatory", "always"), "src", "dst") == [("cat", "sub"), ("sub", "prod")]
    assert rows(wiring.wire(p, "surrogate"), "src", "dst") == [("cat", "r"), ("r", "prod"), ("sub", "cat")]
    assert rows(wiring.wire(participants(spark, BASE), "regulatory", "edgelist"), "src", "dst") == [("sub", "prod")]


def test_reverse_edges_swap_roles_and_leave_modifiers(spark, rows):
    p = participants(spark, [*BASE, ("catalyst", "cat", 0)])
    reactions = spark.createDataFrame([("r", True)], "r_id string, r_isreversible boolean")
    out = wiring.add_reverse(wiring.wire(p), reactions)
    back = out.where("direction = 'reverse'")
    assert rows(back, "src", "dst") == [("prod", "r"), ("r", "sub")]
    one = back.where("src = 'prod'").first()
    assert (one.sbo_term_upstream, one.stoichiometry_upstream) == (V.ROLE_CODES["reactant"], -1.0)
    assert wiring.deduplicate(out.unionByName(out)).count() == out.count()


def test_reversing_a_network_twice_gives_it_back(spark, rows):
    e = spark.createDataFrame([("a", "b", 1.0, 2.0, -1.0, 1.0, "forward")], "src string, dst string, weight double, weight_upstream double, stoichiometry_upstream double, stoichiometry_downstream double, direction string")
    once = wiring.reverse(e)
    assert rows(once) == [("b", "a", 2.0, 1.0, -1.0, 1.0, "reverse")]
    assert rows(wiring.reverse(once)) == rows(e)


def test_weights(spark):
    e = spark.createDataFrame([("a", "r", "r", 1, 2, 3, "protein"), ("r", "b", "r", 3, 0, 3, "metabolite")], "src string, dst string, r_id string, sc_children long, sc_parents long, sc_degree long, species_type string")
    w = {r.src: (r.weight, r.weight_upstream) for r in wiring.topology_weights(e).collect()}
    assert w == {"a": (2 + 0.5, 2 + 1.0), "r": (2 + 4.5, 2.0)}
    halved = wiring.halve_reaction_edges(wiring.topology_weights(e), None)
    assert {r.src: r.weight for r in halved.collect()} == {"a": 1.25, "r": 3.25}
    with pytest.raises(Exception, match="no multiplier"):
        wiring.topology_weights(e.withColumn("species_type", e.src)).collect()
