"""The entry to graph reasoning: kinds, arguments, depths, unknown entities."""

import pytest

from sedimenta.operators.reason import KINDS, reason

E = [("a", "b", "R"), ("b", "c", "R"), ("c", "a", "S"), ("c", "d", "R"), ("d", "e", "R"), ("e", "f", "R"), ("f", "g", "R"), ("g", "h", "R"), ("a", "b", "R"), ("z", "z", "R")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(x, "T" if x < "e" else None, "") for x in "abcdefg"], "id string, type string, description string"), spark.createDataFrame(E, "src string, dst string, type string")


def ask(graph, *args, **kw):
    rows = reason(*graph, *args, **kw).collect()
    return {(r.id, r.label) for r in rows if r.kind == "node"}, {(r.id, r.other, r.label) for r in rows if r.kind == "link"}, [r.label for r in rows if r.kind == "error"], len(rows)


def test_wrong_arguments(graph):
    assert ask(graph, "guess", "a", "b")[2] == ["unknown kind of reasoning"]
    assert ask(graph, "entity_cycles", " ")[2] == ["an entity is needed"] and ask(graph, "entity_cycles", None)[2]
    for kind, (needs, _) in KINDS.items():
        for b in (None, "", "  ") if needs else (None,):
            assert bool(ask(graph, kind, "a", b)[2]) == needs
    assert len(KINDS) == 7


def test_paths(graph):
    nodes, links, _, n = ask(graph, "shortest_path", " a ", "d")
    assert nodes == {("a", "T"), ("c", "T"), ("d", "T")} and links == {("c", "a", "S"), ("c", "d", "R")} and n == 5
    nodes, links, _, _ = ask(graph, "all_paths", "a", "d", depth=3)
    assert {x for x, _ in nodes} == set("abcd") and links == {("a", "b", "R"), ("b", "c", "R"), ("c", "a", "S"), ("c", "d", "R")}
    assert ask(graph, "one_two_hop", "a", "c")[1] == {("c", "a", "S"), ("a", "b", "R"), ("b", "c", "R")}
    assert ask(graph, "shortest_path", "a", "nobody")[3] == 0 and ask(graph, "all_paths", "nobody", "a")[3] == 0


def test_depth_is_clamped(graph):
    assert ask(graph, "shortest_path", "a", "b", depth=-3)[1] == {("a", "b", "R")}
    assert ask(graph, "shortest_path", "a", "c", depth=0)[3] == 3
    assert ask(graph, "shortest_path", "a", "g", depth=99)[3] == 11  # five steps
    assert ask(graph, "shortest_path", "a", "h", depth=99)[3] == 0  # six


def test_around_an_entity(graph):
    nodes, links, _, _ = ask(graph, "common_neighbors", "a", "d")
    assert nodes == {("a", "Source"), ("d", "Target"), ("c", "T")} and links == {("c", "a", "S"), ("c", "d", "R")}
    nodes, links, _, _ = ask(graph, "entity_influence", "d", depth=1)
    assert nodes == {("d", "Center"), ("c", "Level1"), ("e", "Level1")} and links == {("c", "d", "R"), ("d", "e", "R")}
    assert ask(graph, "entity_influence", "g", depth=4) == ask(graph, "entity_influence", "g", depth=2)
    assert ask(graph, "entity_cycles", "a")[1] == {("a", "b", "R"), ("b", "c", "R"), ("c", "a", "S")}
    assert ask(graph, "entity_cycles", "d")[3] == 0


def test_communities(spark, graph):
    m = spark.createDataFrame([("a", "x"), ("d", "x"), ("c", "x"), ("e", "y")], "id string, community string")
    nodes, links, _, _ = ask(graph, "entity_community", "a", membership=m)
    assert nodes == {("a", "Center"), ("c", "T"), ("d", "T")} and links == {("c", "a", "S"), ("c", "d", "R")}
    assert ask(graph, "entity_community", "g", depth=1, membership=m)[0] == {("g", "Center"), ("f", "Unknown")}


def test_empty_graph(graph):
    empty = graph[0].limit(0), graph[1].limit(0)
    for kind in KINDS:
        assert {k for k, _ in ask(empty, kind, "a", "b")[0]} <= {"a", "b"}
