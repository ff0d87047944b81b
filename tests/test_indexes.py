"""Built indexes against plain scans, with segments and buckets small enough to prune."""

from __future__ import annotations

import re

import numpy as np
import pytest
from docloom.indexes import clustered, inverted, trigrams
from docloom.operators import retrieval as S
from pyspark.sql import functions as F

WORDS = "the red fox ran over a low hill and saw the old dog who saw it too".split()


def rows():
    out = [(i, f"base{i % 3}", WORDS[i % len(WORDS)], " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 4 + i % 11))) for i in range(300)]
    return [*out, (300, "base0", "", ""), (301, "base1", None, None), (302, "base1", "red fox", "The RED fox; the red fox!")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(rows(), "id int, base string, title string, content string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "red fox"), (2, "dog who saw it"), (3, "nothing here"), (4, ""), (5, "the the hill")], "query_id int, text string")


def pairs(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("segment,probe", [(7, 1), (40, 2), (4096, 4)])
def test_search_equals_scan(spark, units, queries, tmp_path, segment, probe):
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], buckets=8, segment=segment)
    got = index.search(queries, 5, probe=probe)
    scored = S.bm25_scores(units, queries, "id", "content")
    want = S.top_k(scored, ["query_id"], F.desc(F.round("score", 9)), "id", 5)
    assert pairs(got, "query_id", "id", "rank", "score") == pairs(want, "query_id", "id", "rank", "score")


def test_segments_are_skipped_and_buckets_filtered(spark, tmp_path):
    """One segment is far better than the rest, so the others are not read for their postings."""
    strong = [(i, "rare " * 3) for i in range(20)]
    weak = [(i, "rare " + "filler " * 200) for i in range(20, 400)]
    units = spark.createDataFrame(strong, "id int, content string")
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], batch=1, buckets=8)
    inverted.build(spark.createDataFrame(weak, units.schema), str(tmp_path / "i"), "id", ["content"], batch=2, buckets=8, segment=20)
    q = spark.createDataFrame([(1, "rare")], "query_id int, text string")
    found = index.search(q, 3, probe=1)
    assert {r.id for r in found.collect()} == {0, 1, 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = index.postings(q.selectExpr("text as term"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in filters or "PartitionFilters: [bucket" in filters or "bucket#" in filters.split("PartitionFilters:")[1].split("]")[0]
    assert "filler" not in plan


def test_batches_make_one_index(spark, units, queries, tmp_path):
    """Two batches give the scores of one; a batch written again replaces itself."""
    whole = inverted.build(units, str(tmp_path / "a"), "id", ["title", "content"], "base", buckets=8, segment=50)
    half = F.col("id") < 150
    for part, n in ((units.filter(half), 0), (units, 1), (units.filter(~half), 1)):
        both = inverted.build(part, str(tmp_path / "b"), "id", ["title", "content"], "base", batch=n, buckets=8, segment=50)
    boosts = {"title": 2.0, "content": 1.0}
    cols = ("query_id", "base", "id", "rank", "score")
    assert pairs(whole.search(queries, 9, boosts), *cols) == pairs(both.search(queries, 9, boosts), *cols)


def test_filter_offset_and_bases(spark, units, queries, tmp_path):
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], "base", buckets=8, segment=20)
    some = units.filter("id % 2 = 0").select("id")
    both = index.search(queries, 8, bases=["base0", "base1"], allowed=some, probe=1).collect()
    assert {r.base for r in both} == {"base0", "base1"} and all(r.id % 2 == 0 for r in both)
    late = index.search(queries, 5, bases=["base0", "base1"], allowed=some, offset=3, probe=1).collect()
    assert sorted(late) == sorted(r for r in both if r["rank"] > 3)


def test_phrases_by_scan(spark, units, tmp_path):
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], buckets=8, segment=20)
    texts = {1: "red fox", 2: "saw", 3: "the old dog", 4: "fox the red fox", 5: "", 6: "the the", 7: "absent fox"}
    q = spark.createDataFrame(list(texts.items()), "query_id int, text string")
    want = []
    for i, _, _, text in rows():
        ts = re.findall(r"\w+", (text or "").lower())
        for n, phrase in texts.items():
            p = phrase.split()
            at = [j for j in range(len(ts) - len(p) + 1) if p and ts[j : j + len(p)] == p]
            want += [(n, i, len(at), at[0])] if at else []
    assert pairs(index.phrases(q), "query_id", "id", "n", "first") == sorted(want)


def test_windows_by_scan(spark, units, queries, tmp_path):
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], buckets=8, segment=20)
    hits = index.search(queries, 10)
    asked = {r.query_id: set(r.text.split()) for r in queries.collect()}
    texts = {r[0]: re.findall(r"\w+", (r[3] or "").lower()) for r in rows()}
    for r in index.windows(hits, queries).collect():
        ts = texts[r.id]
        shared = asked[r.query_id] & set(ts)
        best = min((z - a, z, a) for a in range(len(ts)) for z in range(a, len(ts)) if shared <= set(ts[a : z + 1]))
        assert (r.words, r.start, r.end) == (len(shared), best[2], best[1])
    cut = inverted.fragments(index.windows(hits, queries), queries, units, "id", "content", around=0).filter("query_id = 1 and id = 302").first()
    assert cut.fragment == "<em>red</em> <em>fox</em>"


def test_prefixes(spark, units, tmp_path):
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], buckets=8)
    got = index.with_prefix(spark.createDataFrame([("o",), ("ol",), ("zz",)], "prefix string"))
    assert {(r.prefix, r.term) for r in got.collect()} == {("o", "over"), ("o", "old"), ("ol", "old")}


# --- vectors --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1200)] + 0.35 * rng.standard_normal((1200, 16))
    x[50:60] = x[50]  # equal vectors: ties by id
    rows = [(i, [float(v) for v in y], i % 3) for i, y in enumerate(x)] + [(5000, None, 1)]
    return spark.createDataFrame(rows, "id int, vec array<double>, kind int")


@pytest.fixture(scope="module")
def near(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v"))
    clustered.build(vectors.filter("id < 800"), path, "id", "vec", ("kind",))
    return clustered.build(vectors.filter("id >= 800"), path, "id", "vec", ("kind",), batch=1)


def by_scan(vectors, k, where=lambda r: True):
    rows = [r for r in vectors.collect() if r.vec is not None]
    x = np.array([r.vec for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 1200, 60):
        scores = sorted((-round(float(x[i] @ x[q]), 9), r.id) for i, r in enumerate(rows) if r.id != q and where(r))[:k]
        want |= {(q, i + 1): who for i, (_, who) in enumerate(scores)}
    return want


def asked(vectors):
    return vectors.filter("id % 60 = 0 and vec is not null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def test_vector_index_is_exact_and_prunes(spark, vectors, near):
    found = near.search(asked(vectors), 5, probe=2)
    assert {(r.query_id, r["rank"]): r.id for r in found.collect()} == by_scan(vectors, 5)
    some = near.search(asked(vectors), 5, F.col("kind") == 1, probe=2)
    assert {(r.query_id, r["rank"]): r.id for r in some.collect()} == by_scan(vectors, 5, lambda r: r.kind == 1)
    plan = spark.read.parquet(f"{near.path}/vectors").filter(F.col("list").isin(1, 2) & (F.col("kind") == 1))._jdf.queryExecution().executedPlan().toString()
    assert "kind" in plan.split("PushedFilters:")[1].split("]")[0] and "list" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_vector_index_recall_of_fewer_probes(vectors, near):
    """Lists taken as smaller than they are: fewer are read, and nine in ten are still found."""
    want = set(by_scan(vectors, 10).items())
    got = {((r.query_id, r["rank"]), r.id) for r in near.search(asked(vectors), 10, cover=0.5, probe=2).collect()}
    ids = lambda s: {(q, i) for (q, _), i in s}
    assert len(ids(want) & ids(got)) >= 0.9 * len(want)


def test_vector_index_least_score(vectors, near):
    got = near.search(asked(vectors), 10, least=0.95).collect()
    assert all(r.score >= 0.95 for r in got) and near.search(asked(vectors).limit(0), 3).count() == 0
    assert near.search(asked(vectors), 10, F.col("kind") == 9).count() == 0


# --- substrings -----------------------------------------------------------------------


def test_trigram_index_equals_scan(spark, tmp_path):
    texts = ["Straße nach Köln", "the RED fox", "red", "re", "", None, "100% sure_thing", "a.b.c", "日本語テスト", "xx\nyy", "the end", "aaa aaaa"]
    hay = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id int, title string, content string")
    index = trigrams.build(hay.filter("id < 6"), str(tmp_path / "t"), "id", ["title", "content"], buckets=4, segment=2)
    index = trigrams.build(hay.filter("id >= 6"), index.path, "id", ["title", "content"], batch=1, buckets=4, segment=3)
    needles = ["red", "RE", "e", "straße", "0% s", "_th", ".", "b.c", "本語", "語テス", "x\ny", "zzz", "the e", "aaaa", "", None, "the fox"]
    got = index.contains(spark.createDataFrame([(n,) for n in needles], "needle string"), hay, "id", ["title", "content"])
    want = {(n, i) for n in needles if n for i, t in enumerate(texts) if any(x is not None and n.lower() in x.lower() for x in (t, texts[-1 - i]))}
    rows = [(r.needle, r.id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert got.columns == ["needle", "id", "title", "content"]


def test_an_index_is_built_once_and_again_if_it_went(spark, units):
    import shutil

    from docloom.plans import search_indexes

    made = []

    def make(path):
        made.append(path)
        return trigrams.build(units.limit(5), path, "id", ["content"], buckets=2)

    one, two = (search_indexes.built(spark, "somewhere", "once", make) for _ in range(2))
    assert one.path == two.path and len(made) == 1
    shutil.rmtree(one.path)
    assert search_indexes.built(spark, "somewhere", "once", make).path != one.path and len(made) == 2


def test_postings_are_dealt_in_pieces(spark, tmp_path):
    """The pieces lie in the buckets that a search looks in, and a build shuffles a row for each segment and bucket, not for each word."""
    texts = [f"Köln 日本語 wort{i % 7} straße the the" for i in range(60)] + ["", None]
    units = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    index = inverted.build(units, str(tmp_path / "i"), "id", ["content"], buckets=4, segment=25)
    rows = spark.read.parquet(f"{index.path}/postings")
    words = rows.filter("bucket >= 0")
    assert words.filter(F.col("bucket") != inverted._bucket(F.col("term"), 4)).isEmpty()
    assert words.groupBy("term", "segment").count().filter("count > 1").isEmpty() and words.agg(F.max("n")).first()[0] == 25
    assert rows.filter("bucket = -1").agg(F.sum("n"), F.sum("length")).first()[:] == (62, 60 * 6)
    got = index.phrases(spark.createDataFrame([(1, "straße the the")], "query_id int, text string"))
    assert {(r.id, r.n, r["first"]) for r in got.collect()} == {(i, 1, 3) for i in range(60)}


def test_lists_meet_only_the_queries_that_ask_for_them(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 5), monkeypatch.setattr(S, "ASKED", 2)
    x = np.random.default_rng(4).standard_normal((30, 6))
    v = spark.createDataFrame([(i, r.tolist(), i % 4) for i, r in enumerate(x)], "vec_id int, embedding array<double>, part int").repartition(2)
    asks = {0: [1, 3], 5: [2], 6: [7], 9: [0, 1, 2, 3]}
    q = spark.createDataFrame([(i, x[i].tolist(), p) for i, p in asks.items()], "query_id int, qvec array<double>, parts array<int>")
    got = {(r.query_id, r.vec_id) for r in S.against_all(v, q, parted=True).collect()}
    assert got == {(i, j) for i, p in asks.items() for j in range(30) if j != i and j % 4 in p}
    some = S.against_all(v, q, 2, 0.1, parted=True)
    assert {(r.query_id, r.vec_id) for r in some.collect()} <= got and "Exchange hash" not in some._jdf.queryExecution().executedPlan().toString()
