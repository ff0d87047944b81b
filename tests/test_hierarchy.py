"""Parent and child chunks, and descendants of headings."""

from __future__ import annotations

from docloom.functions.markdown import parent_child
from docloom.operators.ranking import permute
from docloom.operators.retrieval import descendants


def test_children_lie_in_their_parent():
    text = "\n\n".join(f"# h{i}\n\n" + "word " * 30 for i in range(12))
    rows = parent_child(text, 400)
    parents = {p: (body, a, z) for p, c, body, a, z in rows if c is None}
    kids = [(p, body, a, z) for p, c, body, a, z in rows if c is not None]
    assert len(parents) > 1 and len(kids) > len(parents)
    for p, body, a, z in kids:
        assert body in parents[p][0] and parents[p][1] <= a <= z
    assert parent_child("", 400) == []


def test_descendants(spark):
    nodes = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1), (2, 1, None)], "page int, i int, parent int")
    got = descendants(nodes, "i", "parent", ["page"], 3).collect()
    assert sorted((r.page, r.ancestor, r.i, r.steps) for r in got) == [(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 2, 1)]


def test_permute_keeps_all(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, id string, rank int")
    orders = spark.createDataFrame([(1, [2, 2, 9, -1])], "query_id int, order array<int>")
    got = permute(hits, orders).orderBy("query_id", "final_rank").collect()
    assert [r.id for r in got] == ["c", "a", "b", "z"]
