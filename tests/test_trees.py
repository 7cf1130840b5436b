"""Trees as rows: depth costs its logarithm, and cycles end."""

from foliant.operators import search, trees
from foliant.sources import records

KIND = "id int, parent_id int, ordinal int, title string"


def test_a_tree_of_depth_five_thousand(spark, monkeypatch):
    n, rounds = 5000, []
    cut = trees.cut
    monkeypatch.setattr(trees, "cut", lambda df: rounds.append(1) or cut(df))
    chain = spark.createDataFrame([(i, i - 1 if i else None, i % 3, "needle" if i == n - 1 else "x") for i in range(n)] + [(n, None, 1, "x"), (n + 1, n, 0, "x")], KIND)
    assert search.keep_ancestors(chain, "NEEDLE").count() == n
    assert len(rounds) <= 2 + 2 * 15
    rounds.clear()
    got = {r.id: r.path for r in search.depth_first_path(chain.filter("id < 600 OR id >= 5000")).collect()}
    assert len(rounds) <= 12 and got[599] == [i % 3 for i in range(600)] and got[n + 1] == [1, 0]


def test_cycles_and_lost_parents(spark):
    rows = [(1, None, 1, "a"), (2, 1, 1, "b"), (3, 4, 1, "hit"), (4, 3, 1, "c"), (5, 99, 1, "hit"), (6, 2, 2, "hit"), (7, 1, 2, "d")]
    nodes = spark.createDataFrame(rows, KIND)
    assert sorted(r.id for r in search.keep_ancestors(nodes, "hit").collect()) == [1, 2, 3, 4, 5, 6]
    assert {r.id: r.path for r in search.depth_first_path(nodes).collect()} == {1: [1], 2: [1, 1], 6: [1, 1, 2], 7: [1, 2]}
    tree = spark.createDataFrame([(1, i, i - 1 if i else None, f"f{i}") for i in range(9)] + [(2, 0, 1, "x"), (2, 1, 0, "y")], "doc_id int, node int, parent int, name string")
    assert sorted(r.name for r in records.embedded_files(tree, 4).collect()) == ["f0", "f1", "f2", "f3", "f4"]
