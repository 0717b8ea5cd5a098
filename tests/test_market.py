from __future__ import annotations

import functools

import pytest

from salesops.operators import hierarchy, joins, market
from salesops.scopes import MARKET_SCHEMA
from tests.conftest import rows

# FIELD_ID, MKT_NAME, MKT_LEVEL, PARENT_MKT_CODE, MKT_CODE_OLD
NODES = [
    ("f1", "Root", 1, None, "r"),
    ("f2", "Blank root", 1, "", "b"),
    ("f3", "North", 2, "r", "n"),
    ("f4", "South", 2, "r", "s"),
    ("f5", "Leaf 1", 3, "n", "l1"),
    ("f6", "Leaf 2", 3, "n", "l2"),
    ("f7", "Lost", 3, "zz", "lost"),
    ("f8", "Cycle a", 4, "cb", "ca"),
    ("f9", "Cycle b", 4, "ca", "cb"),
    ("f10", "Below cycle", 5, "ca", "cc"),
    ("f11", "Second south", 2, "b", "s"),
    ("f12", "Under south", 3, "s", "us"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, MARKET_SCHEMA).repartition(3).cache()


def walk_up(start, max_steps):
    """The bounded walk by brute force: every row with the wanted code is followed."""
    found, front = [(start[0], 0)], [start]
    for depth in range(1, max_steps + 1):
        front = [up for node in front for up in NODES if node[3] is not None and up[4] == node[3]]
        found += [(up[0], depth) for up in front]
    return found


def test_closure_matches_brute_force(nodes):
    for steps in (1, 2, 7):
        expected = sorted((n[0], a, d) for n in NODES for a, d in walk_up(n, steps))
        found = rows(hierarchy.hierarchy_closure(nodes, steps).select("node_id", "ancestor_id", "depth"))
        assert sorted(found) == expected


def test_path_matches_brute_force(nodes):
    for node in NODES:
        for steps in (1, 4):
            found = rows(hierarchy.hierarchy_path(nodes, node[0], steps).select("FIELD_ID", "depth"))
            assert sorted(found) == sorted(walk_up(node, steps))


def test_path_by_code_and_unknown_id(nodes):
    assert rows(hierarchy.hierarchy_path(nodes, "l1").select("FIELD_ID")) == [("f5",), ("f3",), ("f1",)]
    assert hierarchy.hierarchy_path(nodes, "none").count() == 0
    with pytest.raises(ValueError):
        hierarchy.hierarchy_path(nodes, "l1", 51)


def test_tree(nodes):
    found = {r["FIELD_ID"]: r for r in hierarchy.market_tree(nodes).collect()}
    assert len(found) == len(NODES)
    paths = {k: r["path"] for k, r in found.items()}
    assert paths["f5"] == "r/n/l1"
    # Two rows share the code s; the last by level, name and id is the parent.
    assert paths["f12"] == "r/s/us"
    assert paths["f11"] == "b/s" and found["f11"]["root_code"] == "b"
    assert [k for k, r in found.items() if r["is_root"]].__len__() == 3
    assert found["f7"]["is_root"] and found["f7"]["path"] == "lost"
    assert found["f2"]["is_root"]
    unreachable = sorted(k for k, r in found.items() if not r["reachable"])
    assert unreachable == ["f10", "f8", "f9"]
    assert found["f10"]["depth"] is None and found["f10"]["root_code"] is None
    assert found["f1"]["n_children"] == 2 and found["f3"]["n_children"] == 2
    assert found["f6"]["depth"] == 2
    assert (found["f4"]["n_children"], found["f11"]["n_children"]) == (1, 0)
    assert found["f9"]["n_children"] == 1 and found["f5"]["n_children"] == 0


def test_tree_counts_roots_and_attached(nodes):
    tree = hierarchy.market_tree(nodes)
    roots = tree.filter("is_root").count()
    attached = tree.filter("NOT is_root").count()
    assert roots + attached == len(NODES)


def test_tree_of_first_nodes(nodes):
    cut = {r["FIELD_ID"]: r for r in hierarchy.market_tree(nodes, max_nodes=3).collect()}
    # Level, then name: the two roots and North; every child of a cut parent would be a root.
    assert sorted(cut) == ["f1", "f2", "f3"]


def test_a_chain_of_thousands_takes_few_rounds(spark, monkeypatch):
    """5,000 levels, a cycle and a node below it: rounds grow with the logarithm of the depth."""
    chain = [(f"f{i}", f"n{i}", i, f"c{i - 1}" if i else None, f"c{i}") for i in range(5000)]
    cycle = [("x", "x", 1, "cz", "cx"), ("y", "y", 1, "cx", "cy"), ("z", "z", 1, "cy", "cz"), ("w", "w", 1, "cz", "cw")]
    rounds, cut = [], hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df: rounds.append(df) or cut(df))
    tree = hierarchy.market_tree(spark.createDataFrame(chain + cycle, MARKET_SCHEMA)).drop("path").collect()
    found = {r["FIELD_ID"]: r for r in tree}
    # Five of them are no rounds; a last round finds nothing but the cycle.
    assert len(rounds) - 5 <= 14
    assert all(found[f"f{i}"]["depth"] == i and found[f"f{i}"]["root_code"] == "c0" for i in range(5000))
    assert not any(found[k]["reachable"] for k in "xyzw")


def test_a_deep_chain_is_followed_to_its_end(spark):
    chain = [(f"f{i}", f"n{i}", i, f"c{i - 1}" if i else None, f"c{i}") for i in range(60)]
    found = {r["FIELD_ID"]: r for r in hierarchy.market_tree(spark.createDataFrame(chain, MARKET_SCHEMA)).collect()}
    assert found["f59"]["depth"] == 59 and found["f59"]["root_code"] == "c0"
    assert all(r["reachable"] for r in found.values())
    path = hierarchy.hierarchy_path(spark.createDataFrame(chain, MARKET_SCHEMA), "f59", 50).collect()
    assert [r["FIELD_ID"] for r in path] == [f"f{59 - i}" for i in range(51)]


def test_closure_is_the_path_of_every_node(nodes):
    """Rows that share a code are all followed, each as often as there are ways to it."""
    closure = sorted((r["node_id"], r["depth"], r["ancestor_id"]) for r in hierarchy.hierarchy_closure(nodes, 4).collect())
    paths = []
    for field in sorted({n[0] for n in NODES}):
        paths += [(field, r["depth"], r["FIELD_ID"]) for r in hierarchy.hierarchy_path(nodes, field, 4).collect()]
    assert closure == sorted(paths)


def test_walks_with_large_lookups(nodes, monkeypatch):
    """The same results when no lookup may be broadcast and every join is shuffled and salted."""
    tree = sorted(rows(hierarchy.market_tree(nodes)), key=repr)
    closure = sorted(rows(hierarchy.hierarchy_closure(nodes, 4)), key=repr)
    orphans = rows(hierarchy.hierarchy_orphans(nodes, parent_match="code"))
    shuffled = functools.partial(joins.lookup_join, max_broadcast_rows=0, salt=3)
    monkeypatch.setattr(hierarchy, "lookup_join", shuffled)
    assert sorted(rows(hierarchy.market_tree(nodes)), key=repr) == tree
    assert sorted(rows(hierarchy.hierarchy_closure(nodes, 4)), key=repr) == closure
    assert rows(hierarchy.hierarchy_orphans(nodes, parent_match="code")) == orphans


def test_integrity_by_id_and_by_code(nodes):
    by_code = hierarchy.hierarchy_integrity(nodes, "code").first()
    known = {n[4] for n in NODES}
    children = [n for n in NODES if n[3] is not None]
    lost = [n for n in children if n[3] not in known]
    assert (by_code["total_children"], by_code["issue_count"]) == (len(children), len(lost))
    orphans = rows(hierarchy.hierarchy_orphans(nodes, parent_match="code"))
    assert orphans == sorted((n[0], n[3], 1) for n in lost)
    by_id = hierarchy.hierarchy_integrity(nodes).first()
    assert by_id["issue_count"] == len(children)
    assert hierarchy.hierarchy_orphans(nodes, sample=2).count() == 2
    with pytest.raises(ValueError):
        hierarchy.hierarchy_integrity(nodes, "name")


def test_empty_market(spark):
    empty = spark.createDataFrame([], MARKET_SCHEMA)
    assert rows(hierarchy.hierarchy_integrity(empty)) == [(0, 0)]
    assert rows(market.field_uniqueness(empty)) == [(0, 0, 0)]
    assert rows(market.market_summary(empty)) == [(0, 0, None, None)]
    assert hierarchy.hierarchy_closure(empty).count() == 0
    assert hierarchy.market_tree(empty).count() == 0
    assert market.market_missing(empty).first()["FIELD_ID_pct"] == 0.0


def test_search_and_counts(nodes):
    def ids(**options):
        return [r["FIELD_ID"] for r in market.market_search(nodes, **options).collect()]

    assert ids(level=2) == ["f3", "f11", "f4"]
    assert ids(parent_mkt_code="n") == ["f5", "f6"]
    assert ids(search="root") == ["f2"]
    assert ids(search="root", ignore_case=True) == ["f2", "f1"]
    assert rows(market.children_count(nodes, 2)) == [("ca", 2), ("n", 2)]
    assert market.duplicate_fields(nodes).count() == 0


def test_name_quality(spark):
    df = spark.createDataFrame([(" A", 1), ("a", 2), ("A", 3), (None, 4), ("b/c", 5)], "MKT_NAME string, FIELD_ID int")
    assert rows(market.name_quality(df)) == [(4, 1, 0, 0, True, 0.25)]
