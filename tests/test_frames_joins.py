"""Relations of any number of rows do not pass through the driver."""

import pytest

from lingmill.operators import frames as R


@pytest.mark.parametrize("mode", ["simple", "bfs", "dfs", "local-bfs", "part-dfs"])
def test_inheritance_joins_by_shuffle(spark, mode):
    edges = spark.createDataFrame([("c1", "n1"), ("c2", "n1"), ("n1", "r1")], "src string, dst string")
    frames = spark.createDataFrame([("r1", "tongue", "VALUE", 0, "x"), ("c1", "name", "VALUE", 0, "y")], "frame string, slot string, facet string, pos int, filler string")
    out = R.inherited_by(frames, edges, edges, mode)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.frame, r.slot, r.depth) for r in out.collect()} >= {("c1", "name", 0), ("n1", "tongue", 1), ("r1", "tongue", 0)}


def test_ancestors_of_a_relation_are_kept(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    frames = spark.createDataFrame([("b", "s", "VALUE", 0, "x")], "frame string, slot string, facet string, pos int, filler string")
    known: dict = {}
    one = R.inherited_by(frames, edges, edges, "bfs", known)
    kept = known[False, False]
    two = R.inherited_by(frames, edges, edges, "local-bfs", known)
    assert known[False, False] is kept and sorted(one.collect()) == sorted(two.collect())
