"""Graph searches to convergence, keyed tables, deep pages and sketches against plain versions."""

from __future__ import annotations

import glob
import os
from collections import deque

import pytest
from docloom.operators import graph, paging, sketches, tables
from pyspark.sql import functions as F

EDGES = [(f"c{i}", f"c{i + 1}", "next") for i in range(9)] + [("hub", f"leaf{i}", "has") for i in range(40)] + [("c0", "hub", "has"), ("x", "y", "next"), ("y", "x", "next"), (None, "z", "has"), ("c0", "c0", "next"), ("c0", "d", "b"), ("d", "c2", "b")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES * 2, "src string, dst string, type string")


def walk(start, directed=False, types=None):
    out = {}
    for a, b, t in EDGES:
        if a and b and (types is None or t in types):
            out.setdefault(a, set()).add(b)
            if not directed:
                out.setdefault(b, set()).add(a)
    seen, todo = {start: [start]}, deque([start])
    while todo:
        at = todo.popleft()
        for n in sorted(out.get(at, ())):
            if n not in seen:
                seen[n] = [*seen[at], n]
                todo.append(n)
    return seen


@pytest.mark.parametrize("directed,types", [(False, None), (True, None), (False, ["next"])])
def test_reach_to_the_end(spark, edges, directed, types):
    """A chain longer than any fixed number of hops, a hub in parts, loops, cycles, null ends and a start without edges."""
    g = graph.Graph(edges, types, directed, part=7)
    start = spark.createDataFrame([("a", "c0"), ("b", "x"), ("c", "alone"), ("a", "c0")], "origin string, id string")
    got = {(r.origin, r.id): r.distance for r in g.reach(start).collect()}
    assert got == {(o, n): len(p) - 1 for o, s in (("a", "c0"), ("b", "x"), ("c", "alone")) for n, p in walk(s, directed, types).items()}
    assert max(g.edges.groupBy("src", "part").count().toPandas()["count"]) <= 20


def test_reach_bounded(spark, edges):
    got = graph.Graph(edges).reach(spark.createDataFrame([(1, "c0")], "origin int, id string"), 2).collect()
    assert {r.id: r.distance for r in got} == {n: len(p) - 1 for n, p in walk("c0").items() if len(p) <= 3}


@pytest.mark.parametrize("directed", [False, True])
def test_paths_of_any_length(spark, edges, directed):
    pairs = [("c0", "c9"), ("leaf3", "leaf4"), ("c9", "c0"), ("x", "c0"), ("c0", "c2"), ("c5", "c5"), ("c0", None)]
    found = graph.Graph(edges, directed=directed, part=7).paths(spark.createDataFrame(pairs, "src string, dst string"))
    got = {(r.src, r.dst): (r.path, r.distance) for r in found.collect()}
    want = {}
    for a, b in pairs:
        p = walk(a, directed).get(b) if b else None
        if p:
            want[a, b] = (p, len(p) - 1)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert got["c0", "c2"][0] == ["c0", "c1", "c2"]  # not by d: the least path


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def all_rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    rows = [(i, f"name{i}", i * 2.0) for i in range(200)] + [(None, "no key", 0.0)]
    t = tables.KeyedTable.create(spark.createDataFrame(rows, "id int, name string, x double"), str(tmp_path / "t"), "id", buckets=16)
    before = files(t.path)
    up = spark.createDataFrame([(3, "new", 1.0), (3, "twice", 2.0), (500, "added", 5.0), (None, "ignored", 0.0)], "id int, name string, x double")
    gone = spark.createDataFrame([(7,), (3,), (900,), (None,)], "id int")
    touched = t.merge(up, gone)
    want = [r for r in rows if r[0] not in (3, 7)] + [(3, "new", 1.0), (3, "twice", 2.0), (500, "added", 5.0)]
    assert all_rows(t) == sorted(want, key=repr)
    after = files(t.path)
    kept = {f: m for f, m in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after[f] == m for f, m in kept.items())
    t.merge(up, gone)
    assert all_rows(t) == sorted(want, key=repr)  # the same again changes nothing
    assert {r.name for r in t.lookup(spark.createDataFrame([(3,), (8,)], "id int")).collect()} == {"new", "twice", "name8"}
    assert t.merge() == []


def test_merge_partial_and_emptied_buckets(spark, tmp_path):
    rows = [(i, f"name{i}", "kept") for i in range(5)]
    t = tables.KeyedTable.create(spark.createDataFrame(rows, "id int, name string, note string"), str(tmp_path / "t"), "id", buckets=64)
    t.merge(spark.createDataFrame([(1, "one"), (2, ""), (3, None), (9, "nine")], "id int, name string"), partial=True)
    assert all_rows(t) == sorted([(0, "name0", "kept"), (1, "one", "kept"), (2, "name2", "kept"), (3, "name3", "kept"), (4, "name4", "kept"), (9, "nine", None)], key=repr)
    t.merge(deletes=spark.createDataFrame([(i,) for i in (0, 1, 2, 3)], "id int"))
    assert all_rows(t) == sorted([(4, "name4", "kept"), (9, "nine", None)], key=repr)


def test_cascades(spark, tmp_path):
    docs = tables.KeyedTable.create(spark.range(20).select(F.col("id").alias("document_id")), str(tmp_path / "d"), "document_id", 8)
    chunks = tables.KeyedTable.create(spark.range(60).select((F.col("id") % 20).alias("doc"), "id"), str(tmp_path / "c"), "doc", 8)
    tables.delete_documents([chunks, docs], spark.createDataFrame([(3,), (4,)], "document_id long"))
    assert docs.read().count() == 18 and chunks.read().count() == 54
    n = spark.createDataFrame([(v,) for v in sorted({x for e in EDGES for x in e[:2] if x})], "id string")
    e = spark.createDataFrame([x for x in EDGES if x[0]], "src string, dst string, type string")
    nodes = tables.KeyedTable.create(n, str(tmp_path / "n"), "id", 8)
    out, into = tables.KeyedTable.create(e, str(tmp_path / "s"), "src", 8), tables.KeyedTable.create(e, str(tmp_path / "i"), "dst", 8)
    tables.delete_nodes(nodes, out, into, spark.createDataFrame([("c2",), ("hub",)], "id string"))
    want = sorted(x for x in EDGES if x[0] and not {"c2", "hub"} & set(x[:2]))
    assert all_rows(out) == all_rows(into) == sorted(want, key=repr) and nodes.read().filter("id in ('c2', 'hub')").count() == 0


def test_ranks_and_pages(spark):
    rows = [(i, (i * 37) % 11 if i % 13 else None, f"t{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, score int, at string").repartition(7)
    order = [("score", True), ("id", False)]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = sorted(paging.ranked(df, order).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 301)) and [r.id for r in got] == [r[0] for r in want]
    assert paging.ranked(df, order).columns == ["id", "score", "at", "rank"] and paging.ranked(df.limit(0), order).count() == 0
    last, seen = None, []
    while page := paging.page_after(df, order, last, 70).collect():
        seen += [r.id for r in page]
        last = page[-1].asDict()
    assert seen == [r[0] for r in want]


def test_sketches_merge(spark):
    rows = [("a", b, f"w{(i * i + b) % 5000}") for b in range(3) for i in range(6000)] + [("a", b, "often") for b in range(3) for _ in range(900)] + [("b", 0, "x"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "base string, batch int, token string")
    whole = sketches.sketch(df, ["base"])
    batches = sketches.merged(sketches.sketch(df, ["base", "batch"]), ["base"])
    for found in (whole, batches):
        got = {r.base: r for r in found.select("base", "tokens", "bytes", sketches.distinct_count().alias("d"), sketches.frequent_terms(1).alias("top")).collect()}
        exact = {b: {t for x, _, t in rows if x == b and t} for b in "ab"}
        assert got["a"].tokens == sum(x == "a" for x, _, _ in rows) and got["b"].tokens == 1 and got["b"].bytes == 1
        assert abs(got["a"].d - len(exact["a"])) <= 0.03 * len(exact["a"]) and got["b"].d == 1
        assert got["a"].top[0]["item"] == "often" and abs(got["a"].top[0]["count"] - 2700) <= len(rows) / sketches.COUNTERS
