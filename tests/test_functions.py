"""Column functions and operators on small inputs, edge cases included."""

from __future__ import annotations

import numpy as np
from docloom.functions import text as T
from docloom.operators import ranking as K
from docloom.operators import relational as R
from docloom.operators import retrieval as S
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_packing_of_texts(spark):
    rng = np.random.default_rng(6)
    texts = ["é" * int(n) for n in rng.integers(0, 9, 60)] + ["z" * 40]
    want, now = [], ""
    for t in texts:
        if not t:
            continue
        if now and len(now.encode()) + len(t.encode()) > 30:
            want.append(now)
            now = ""
        now = f"{now}|{t}" if now else t
    df = spark.createDataFrame([(texts,), ([],), (["", " "],), (None,)], "parts array<string>")
    got = [r.x for r in df.select(T.packed(F.col("parts"), 30, "|").alias("x")).collect()]
    assert got == [[*want, now], [], [], None]


def test_fences(spark):
    for text, want in [("```py\na\nb\n```", "a\nb"), ("a\nb", "a\nb"), ("~~~\na", "a"), ("```", "```"), ("```\n```", ""), ("", ""), (None, None)]:
        assert one(spark, T.strip_fences(F.lit(text).cast("string"))) == want


def test_code_sections(spark):
    py = "import x\n\ndef a():\n    pass\n\nclass B:\n    def c(self):\n        pass\n"
    assert one(spark, T.code_sections(F.lit(py), "python")) == ["import x", "def a():\n    pass", "class B:\n    def c(self):\n        pass"]
    assert one(spark, T.code_sections(F.lit("a\nb\n\n\n c\n\n"), "other")) == ["a\nb", "c"]
    assert one(spark, T.code_sections(F.lit(""), "go")) == []


def test_merged_maps(spark):
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    assert one(spark, R.merged(m("a", "1", "b", "2"), m("b", "3"), m("c", "4", "a", "5"))) == {"a": "5", "b": "3", "c": "4"}


def test_resolved(spark):
    df = spark.createDataFrame([(s, "o", "t", None) for s in ("original", "enrichment:t", "composite:t+n+original", "enrichment:n")], "source string, c string, t string, n string")
    got = [r.resolved for r in R.resolved(df.withColumnRenamed("c", "original"), "original", ["t", "n"]).collect()]
    assert got == ["o", "t", "t\n\no", ""]


def test_contains_any_takes_marks_literally(spark):
    df = spark.createDataFrame([("50%", "a"), ("500", "b_"), (None, "B%")], "x string, y string")
    assert R.contains_any(df, "%", "x", "y").count() == 2 and R.contains_any(df, "_", "x", "y").count() == 1
    assert R.contains_any(df, "b", "x", "y").count() == 2 and R.contains_any(df, "", "x").count() == 3


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(7).standard_normal((60, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id int, embedding array<double>")
    q = v.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    whole = {(r.query_id, r.vec_id): r["rank"] for r in S.knn(v, q, 4).collect()}
    monkeypatch.setattr(S, "BLOCK", 6)
    assert {(r.query_id, r.vec_id): r["rank"] for r in S.knn(v, q, 4).collect()} == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(60)
    assert set(whole) == {(i, int(j)) for i in range(0, 60, 3) for j in np.argsort(-s[i])[:4]}


def test_score_fusion_of_equal_scores(spark):
    hits = spark.createDataFrame([(1, "a", "x", 3.0), (1, "a", "y", 3.0), (1, "b", "x", 0.0), (1, "b", "z", 4.0), (1, "c", "z", 9.0)], "query_id int, channel string, id string, score double")
    got = {r.id: round(r.score, 6) for r in K.score_fusion(hits, {"a": 0.5, "b": 0.4}).collect()}
    assert got == {"x": 0.5, "y": 0.5, "z": 0.4}


def test_directed_hops_and_code_points(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted(tuple(r) for r in S.directed_hops(edges, start, 2).collect()) == [("a", "b", 1), ("a", "c", 1), ("a", "c", 2)]
    assert [one(spark, S.code_point(F.lit(c))) for c in "aé日\U0001f600"] == [97, 233, 0x65E5, 0x1F600]


def test_incremental_batches(spark, tmp_path):
    from docloom.streaming.usage import index_batches

    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    q = index_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.filter("id % 2 = 0")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
