"""The ranking of search hits."""

from __future__ import annotations

from docloom.plans import retrieval as R


def test_bm25_ties_go_to_the_smallest_ids(spark, monkeypatch):
    near = spark.range(50).selectExpr("0 as query_id", "id", "1 + id * 1e-13 as score")  # equal to 9 places
    monkeypatch.setattr(R.S, "bm25_scores", lambda *a: near)
    assert sorted(r.id for r in R._bm25_hits(spark, "/root/testdata/sf0.001", 3).collect()) == [0, 1, 2]


def test_embedding_preview_keeps_the_sign_of_zero(spark, tmp_path):
    import duckdb
    from docloom.plans import enrichment

    rows = [(1, [-2e-6, 2e-6, -0.0, 0.0, 0.015625, -0.015625, -0.5, 0.25, 1.0]), (2, [-3e-6, -4e-6]), (3, [4e-6])]
    spark.createDataFrame(rows, "vec_id int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: repr((r["head"], r.low, r.high)) for r in enrichment.embedding_preview(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select vec_id, head, low, high from ({enrichment.ORACLES['embedding_preview']})").fetchall()
    assert got == {i: repr((head, low, high)) for i, head, low, high in want}


def vectors(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x)], "vec_id int, embedding array<double>")


def asked(v, every):
    return v.filter(f"vec_id % {every} = 0").selectExpr("vec_id as query_id", "embedding as qvec")


def test_pairs_meet_packed(spark, monkeypatch):
    """No row of a pair leaves a task unless it can matter; ties, null and zero vectors included."""
    import numpy as np
    from docloom.operators import retrieval as S

    x = np.random.default_rng(3).integers(-2, 3, (90, 4)).astype(float)
    x[5:40] = x[5]  # ties beyond k
    x[44] = 0
    rows = [None if i == 50 else r.tolist() for i, r in enumerate(x)]
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    monkeypatch.setattr(S, "ROWS", 7), monkeypatch.setattr(S, "ASKED", 4), monkeypatch.setattr(S, "BLOCK", 9)
    v = vectors(spark, rows).filter("vec_id <> 44")
    q = asked(v, 5)
    want = {(i, j): round(float(u[i] @ u[j]), 9) for i in range(0, 90, 5) if i != 50 for j in range(90) if j not in (i, 44, 50) and n[i] and n[j]}
    all_ = {(r.query_id, r.vec_id): r.score for r in S.against_all(v, q).collect()}
    assert {p: round(s, 9) for p, s in all_.items() if p in want} == want and len(all_) == 18 * 88
    assert all(all_[p] is None for p in all_ if 50 in p)
    assert {(r.query_id, r.vec_id) for r in S.against_all(v, q, least=0.5).collect()} >= {p for p, s in want.items() if s > 0.5}
    top = S.against_all(v, q, 3)
    assert top.count() < len(all_)  # cut within the task
    best = {(r.query_id, r["rank"]): r.vec_id for r in S.knn(v, q, 3).collect()}
    for i in {i for i, _ in want}:
        mine = sorted((-want[i, j], j) for j in range(90) if (i, j) in want)[:3]
        assert [best[i, r + 1] for r in range(3)] == [j for _, j in mine]


def test_several_vectors_count_by_the_best(spark):
    from docloom.operators import retrieval as S

    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, -1.0]), (4, None)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(2, [1.0, 0.0]), (9, [0.6, 0.8])], "query_id int, qvec array<double>")
    got = sorted((r.query_id, r.vec_id, round(r.score, 6)) for r in S.against_all(v, q, least=0.3, several=True).collect())
    assert got == [(2, 1, 1.0), (9, 1, 0.8), (9, 2, 0.6)]
    most = S.best_of_variants(v.filter("vec_id > 1"), q.selectExpr("*", "if(query_id = 2, 1.0D, 0.5D) as weight"))
    assert {r.vec_id: r.score and round(r.score, 6) for r in most.collect()} == {2: 0.3, 3: 0.0, 4: None}
