"""Registered queries: search channels, graph walks, fusion, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.operators import ranking as K
from docloom.operators import retrieval as S
from docloom.plans.analytics import DOCS, ENTITIES, RELATIONS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _questions(spark, d):
    """The whole texts of every twentieth benchmark item: a stated query set that grows with the table."""
    return corpus.table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _bm25(k: int) -> str:
    return rf"""
WITH toks AS (SELECT document_id AS id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS ts FROM {DOCS}),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term
 FROM (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)),
p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY id, term, dl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM p JOIN df USING (term) JOIN q USING (term) CROSS JOIN stats GROUP BY query_id, id),
bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


def _bm25_hits(spark, d, k):
    docs = corpus.documents(spark, d).select("document_id", "content")
    s = S.bm25_scores(docs, _questions(spark, d), "document_id", "content")
    return S.top_k(s, ["query_id"], F.desc(F.round("score", 9)), "id", k)


@query(_bm25(10) + " SELECT query_id, id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark, d):
    return _bm25_hits(spark, d, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


VECTORS = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"""SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.v, q.v), 9) DESC, e.vec_id) AS rank FROM {VECTORS} e JOIN {VECTORS} q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10""")
def knn_topk(spark, d):
    e = corpus.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return S.knn(e, q, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.v, q.v), 9) DESC, e.vec_id) AS rank FROM {VECTORS} e JOIN {VECTORS} q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id AND e.label IN (1, 2)) WHERE rank <= 5""")
def knn_filtered(spark, d):
    e = corpus.table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return S.knn(e.filter("label in (1, 2)").select("vec_id", "embedding"), q, 5).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id, round(max(score * w), 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(e.v, q.v) AS score, CASE WHEN q.vec_id = 0 THEN 1.0 ELSE 0.7 END AS w
 FROM {VECTORS} e JOIN {VECTORS} q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) GROUP BY vec_id""")
def knn_multi_variant_max(spark, d):
    """Every twentieth vector is a variant of one query: the first weighs most."""
    e = corpus.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    weighed = q.withColumn("weight", F.when(F.col("query_id") == 0, 1.0).otherwise(0.7))
    return S.best_of_variants(e, weighed).select("vec_id", F.round("score", 6).alias("score"))


_HOPS = f"""WITH RECURSIVE e AS (SELECT src, dst FROM {RELATIONS} UNION ALL SELECT dst, src FROM {RELATIONS}),
w(id, distance) AS (SELECT 'nation:3', 0 UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.id WHERE w.distance < 2),
hop AS (SELECT id, min(distance) AS distance FROM w GROUP BY id)"""


@query(_HOPS + " SELECT id, distance FROM hop")
def graph_khop(spark, d):
    start = corpus.graph_entities(spark, d).filter("id = 'nation:3'").select("id")
    return S.k_hop(corpus.graph_relations(spark, d), start, 2)


@query(_HOPS + f" SELECT type, count(*) AS n, round(sum(1.0 / (distance + 1)), 6) AS score FROM hop JOIN {ENTITIES} USING (id) GROUP BY type")
def graph_recall(spark, d):
    e = corpus.graph_entities(spark, d)
    hops = S.k_hop(corpus.graph_relations(spark, d), e.filter("id = 'nation:3'").select("id"), 2)
    return hops.join(e, "id").groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum(1.0 / (F.col("distance") + 1)), 6).alias("score"))


@query(f"SELECT id, name FROM {ENTITIES} WHERE contains(name, '00001') ORDER BY name, id LIMIT 10")
def entity_search(spark, d):
    e = corpus.graph_entities(spark, d).filter(F.col("name").contains("00001"))
    return e.orderBy("name", "id").limit(10).select("id", "name")


@query(f"SELECT document_id, title FROM {DOCS} WHERE title ILIKE '%the%' ORDER BY length(title), document_id LIMIT 50")
def toc_search(spark, d):
    t = corpus.documents(spark, d).filter(F.col("title").ilike("%the%"))
    return t.orderBy(F.length("title"), "document_id").limit(50).select("document_id", "title")


_SOURCES = """, by_source AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN (SELECT DISTINCT query_id FROM q) ON source = 'src' || (query_id % 20) QUALIFY rank <= 20),
hits AS (SELECT query_id, 'text' AS channel, id, rank FROM bm UNION ALL SELECT query_id, 'source', id, rank FROM by_source)"""


def _hits(spark, d):
    q = _questions(spark, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"))
    docs = corpus.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    near = S.top_k(docs.join(q, "source").select("query_id", F.col("doc_id").alias("id"), "n_chars"), ["query_id"], F.desc("n_chars"), "id", 20)
    text = _bm25_hits(spark, d, 20).select("query_id", F.lit("text").alias("channel"), "id", "rank")
    return text.unionByName(near.select("query_id", F.lit("source").alias("channel"), "id", "rank"))


def _fused(weight: str) -> str:
    return _bm25(20) + _SOURCES + f""" SELECT query_id, id, channels, round(s, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS fused_rank FROM
 (SELECT query_id, id, string_agg(channel, ',' ORDER BY channel) AS channels, sum({weight} / (60 + rank)) AS s FROM hits GROUP BY query_id, id)"""


@query(_fused("1.0"))
def rrf_unweighted(spark, d):
    return K.rrf(_hits(spark, d)).withColumn("rrf_score", F.round("rrf_score", 9))


@query(_fused("CASE channel WHEN 'text' THEN 0.7 ELSE 1.0 END"))
def rrf_weighted(spark, d):
    return K.rrf(_hits(spark, d), {"text": 0.7, "source": -1.0}).withColumn("rrf_score", F.round("rrf_score", 9))


_SCORED = f"""(SELECT document_id % 7 AS query_id, document_id, CAST(i AS INTEGER) AS chunk_index, (document_id * 31 + i * 17) % 101 + 1.0::DOUBLE AS score FROM (SELECT document_id, unnest(range(0, len(string_split(content, chr(10))))) AS i FROM {DOCS}))"""


def _scored(spark, d):
    c = corpus.documents(spark, d).select("document_id", F.posexplode(F.split("content", "\n", -1)).alias("chunk_index", "content"))
    i = F.col("document_id")
    return c.select((i % 7).alias("query_id"), i, "chunk_index", "content", ((i * 31 + F.col("chunk_index") * 17) % 101 + 1.0).alias("score"))


@query(f"""SELECT query_id, document_id, total, n_chunks, top_chunks, floor(total / max(total) OVER (PARTITION BY query_id) * 1000 + 0.5) / 10 AS relevance FROM
 (SELECT query_id, document_id, sum(score) AS total, count(*) AS n_chunks, string_agg(CASE WHEN r <= 3 THEN CAST(chunk_index AS VARCHAR) END, ',' ORDER BY r) AS top_chunks FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_index) AS r FROM {_SCORED}) GROUP BY query_id, document_id)""")
def doc_aggregate_relevance(spark, d):
    return K.by_document(_scored(spark, d).drop("content"))


@query(f"""SELECT document_id, chunk_index FROM (SELECT document_id, CAST(i - 1 AS INTEGER) AS chunk_index, parts[i] AS content, (document_id * 31 + (i - 1) * 17) % 101 + 1.0 AS score FROM
 (SELECT document_id, string_split(content, chr(10)) AS parts, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {DOCS})) QUALIFY row_number() OVER (PARTITION BY document_id, left(content, 200) ORDER BY score DESC, chunk_index) = 1""")
def chunk_dedupe_prefix(spark, d):
    return K.dedupe_prefix(_scored(spark, d)).select("document_id", "chunk_index")


@query(_bm25(20) + """ SELECT bm.query_id, bm.id, row_number() OVER (PARTITION BY bm.query_id ORDER BY CASE WHEN bm.id % 2 = 0 THEN bm.id % 11 END DESC NULLS LAST, rank, bm.id) AS final_rank FROM bm""")
def rerank_apply(spark, d):
    hits = _bm25_hits(spark, d, 20).select("query_id", "id", (-F.col("rank")).alias("rrf_score"))
    scores = hits.filter("id % 2 = 0").select("query_id", "id", (F.col("id") % 11).alias("reranked"))
    return K.rerank(hits, scores).select("query_id", "id", "final_rank")


@query("""SELECT event_id, round(value / (1 + age / 30), 6) AS hyperbolic, round(value * exp(-age / 30), 6) AS exponential, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN 5.0 ELSE 2.0 END AS final
 FROM (SELECT event_id, value, (epoch_us(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(ts)) / 8.64e10 AS age FROM events)""")
def recency_decay(spark, d):
    e = corpus.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    age = (F.unix_micros(F.lit("2025-01-01 00:00:00").cast("timestamp")) - F.unix_micros("t")) / 8.64e10
    i = F.col("event_id") % 4
    final = K.final_score(F.when(i == 0, F.col("value")), F.when(i == 1, F.lit(5.0)).otherwise(0.0), F.lit(0.02))
    return e.select("event_id", F.round(K.recency(F.col("value"), age), 6).alias("hyperbolic"), F.round(K.exponential(F.col("value"), age), 6).alias("exponential"), final.alias("final"))


@query(_bm25(10) + """, rel AS (SELECT query_id, doc_id AS id FROM documents JOIN (SELECT DISTINCT query_id FROM q) ON doc_id % 50 = query_id % 50),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM bm JOIN rel USING (query_id, id) GROUP BY query_id),
b AS (SELECT query_id, count(DISTINCT id) AS n FROM rel GROUP BY query_id)
SELECT query_id, round(coalesce(hits / 10.0, 0), 6) AS precision, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
 round(coalesce(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= n), 0), 6) AS ndcg FROM b LEFT JOIN h USING (query_id)""")
def ir_metrics(spark, d):
    q = _questions(spark, d).select("query_id", (F.col("query_id") % 50).alias("m"))
    docs = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("m"))
    out = K.metrics(_bm25_hits(spark, d, 10), docs.join(q, "m").select("query_id", "id"), 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(_bm25(3) + f""" SELECT query_id, string_agg(rank || '. ' || title || chr(10) || left(content, 150), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM bm JOIN {DOCS} ON document_id = id GROUP BY query_id""")
def prompt_context(spark, d):
    docs = corpus.documents(spark, d).select(F.col("document_id").alias("id"), "title", "content")
    part = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("\n"), F.left("content", F.lit(150)))
    best = _bm25_hits(spark, d, 3).join(docs, "id").select("query_id", "rank", part.alias("part"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "\n---\n").alias("context"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS step, role FROM conversations")
def step_sequence(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return corpus.table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("step"), "role")


@query(_bm25(20) + """ SELECT id, query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE rank - 1 WHEN query_id % 20 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 4 END NULLS LAST, rank) AS final_rank FROM bm""")
def rerank_permutation(spark, d):
    order = F.array(F.col("query_id") % 20, *[F.lit(i).cast("bigint") for i in (3, 3, 40, 0)])
    return K.permute(_bm25_hits(spark, d, 20).select("query_id", "id", "rank"), _questions(spark, d).select("query_id", order.alias("order")))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM {RELATIONS} UNION SELECT dst, src FROM {RELATIONS}),
p AS (SELECT 'customer:1' AS id, ['customer:1'] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.id WHERE len(path) <= 4 AND NOT list_contains(path, e.dst))
SELECT id, array_to_string(path, '>') AS path, len(path) - 1 AS distance FROM p WHERE id LIKE 'supplier:%' QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path), path) = 1""")
def shortest_path(spark, d):
    start = corpus.graph_entities(spark, d).filter("id = 'customer:1'").select("id")
    found = S.shortest_paths(corpus.graph_relations(spark, d), start, 4).filter(F.col("id").startswith("supplier:"))
    return found.select("id", F.array_join("path", ">").alias("path"), "distance")


def _field(name: str, column: str) -> str:
    return rf"""{name}_t AS (SELECT document_id AS id, regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+') AS ts FROM {DOCS}),
{name}_p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM {name}_t) WHERE term IN (SELECT term FROM q) GROUP BY id, term, dl),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM {name}_p JOIN {name}_d USING (term) JOIN q USING (term) CROSS JOIN (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_t) GROUP BY query_id, id)"""


@query(rf"""WITH q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term
 FROM (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)), {_field("a", "title")}, {_field("b", "content")}
SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT query_id, id, 2 * score AS score FROM a UNION ALL SELECT query_id, id, score FROM b) GROUP BY query_id, id""")
def bm25_title_boost(spark, d):
    docs = corpus.documents(spark, d).select("document_id", "title", "content")
    return S.best_field(docs, _questions(spark, d), "document_id", {"title": 2.0, "content": 1.0}).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, document_id, chunk_index, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_index) AS rank FROM {_SCORED} QUALIFY rank <= 3")
def top3_chunks_per_doc(spark, d):
    top = S.top_k(_scored(spark, d), ["query_id", "document_id"], F.desc("score"), "chunk_index", 3)
    return top.select("query_id", "document_id", "chunk_index", "rank")


@query(f"""WITH RECURSIVE w AS (SELECT src AS ancestor, dst AS id, 1 AS steps FROM {RELATIONS} UNION ALL SELECT w.ancestor, r.dst, w.steps + 1 FROM w JOIN {RELATIONS} r ON r.src = w.id)
SELECT ancestor, id, steps FROM w""")
def toc_descendants(spark, d):
    """The closure over the tree of regions, nations and their members; the pages have headings of one level only."""
    nodes = corpus.graph_relations(spark, d).select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    return S.descendants(nodes, "id", "parent", [], 3)
