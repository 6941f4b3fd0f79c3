"""Graph operators on small fixtures."""

from __future__ import annotations

import pytest

from tessera.operators import graph as g


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("f1", "process_order", 15), ("f2", "validate_order", 8), ("f3", "save_order", 5), ("f4", "calculate_total", 20)], "id string, name string, complexity int")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("f1", "f2", "calls", 1.0), ("f1", "f3", "calls", 0.9), ("f2", "f4", "calls", 0.8)], "from_id string, to_id string, type string, confidence double")


def ids(df):
    return [r.id for r in df.collect()]


def test_language(nodes):
    assert sorted(ids(g.select_nodes(nodes, "WHERE complexity > 10"))) == ["f1", "f4"]
    assert ids(g.select_nodes(nodes, "WHERE complexity = 8")) == ["f2"]
    assert len(ids(g.select_nodes(nodes, "WHERE name contains 'order'"))) == 3
    assert ids(g.select_nodes(nodes, "WHERE complexity > 5 ORDER BY complexity DESC LIMIT 2")) == ["f4", "f1"]
    assert len(ids(g.select_nodes(nodes, ""))) == 4
    assert len(ids(g.select_nodes(nodes, "INVALID QUERY SYNTAX!!!"))) == 4
    assert ids(g.select_nodes(nodes, "WHERE missing = 1")) == []


def test_edges(nodes, edges):
    assert g.filter_edges(edges, ("calls",), 0.85, 0.95).count() == 1
    assert g.induced(nodes.filter("id <> 'f4'"), edges).count() == 2


def test_traversal_and_paths(spark, edges):
    seeds = spark.createDataFrame([("f1",)], "id string")
    assert {(r.id, r.depth) for r in g.traverse(edges, seeds, 2).collect()} == {("f1", 0), ("f2", 1), ("f3", 1), ("f4", 2)}
    assert {r.id for r in g.traverse(edges, spark.createDataFrame([("f4",)], "id string"), 5, "in").collect()} == {"f4", "f2", "f1"}
    assert sorted(r.path for r in g.simple_paths(edges, 3).collect()) == [["f1", "f2"], ["f1", "f2", "f4"], ["f1", "f3"], ["f2", "f4"]]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d")], "from_id string, to_id string")
    assert sorted(r.path for r in g.cycles(ring, 3).collect()) == [["a", "b"], ["a", "b", "c"]]
    two = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("g", "c")], "from_id string, to_id string")
    assert {(r.id, r.component) for r in g.components(two).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("g", "a"), ("d", "d"), ("e", "d")}


def test_hub_is_cut_to_its_limit(spark):
    hub = spark.createDataFrame([(f"caller{k}", "hub") for k in range(500)], "from_id string, to_id string")
    near = g.traverse(hub, spark.createDataFrame([("hub",)], "id string"), 2, "both")
    assert near.count() == 501 and near.orderBy("depth", "id").limit(100).count() == 100


def test_types_that_do_not_match(nodes):
    assert ids(g.select_nodes(nodes, "WHERE name = 5")) == []
    assert len(ids(g.select_nodes(nodes, "WHERE name != 5"))) == 4
    assert ids(g.select_nodes(nodes, "WHERE complexity = abc")) == [] and ids(g.select_nodes(nodes, "WHERE name > 3")) == []
    assert ids(g.select_nodes(nodes, "WHERE name matches '(['")) == [] and ids(g.select_nodes(nodes, "WHERE name matches '(?P<x>a)'")) == []
    assert len(ids(g.select_nodes(nodes, r"WHERE name matches '^\p{L}+_order$'"))) == 3
    assert ids(g.select_nodes(nodes, "WHERE complexity contains '5' ORDER BY complexity")) == ["f3", "f1"]


def test_closure_and_levels(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(12)]
    edges = spark.createDataFrame([*chain, ("n0", "n5"), ("n12", "n12x"), ("a", "b"), ("b", "a"), ("b", "c"), ("n3", "c")], "from_id string, to_id string")
    seed = spark.createDataFrame([("n0",)], "id string")
    far = {r.id: r.depth for r in g.closure(edges, seed).collect()}
    assert far["n4"] == 4 and far["n5"] == 1 and far["n12x"] == 9 and far["c"] == 4 and "a" not in far
    assert {r.id for r in g.closure(edges, spark.createDataFrame([("n2",)], "id string"), "in").collect()} == {"n0", "n1", "n2"}
    level = {r.id: r.level for r in g.levels(edges).collect()}
    assert level["n12x"] == 13 and level["n5"] == 5 and level["a"] is None and level["c"] is None
    some = g.between(edges, seed, spark.createDataFrame([("n5",)], "id string")).collect()
    assert {(r.from_id, r.to_id) for r in some} == {*chain[:5], ("n0", "n5")}
