"""Registered queries: channels and their fusion, graph, lookups and observability, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions import text as T
from docloom.operators import ranking as K
from docloom.operators import relational as R
from docloom.operators import retrieval as S
from docloom.plans.analytics import CHUNKS, DOCS, ENTITIES, RELATIONS, USAGE
from docloom.plans.retrieval import VECTORS, _bm25, _bm25_hits, _questions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The channels of a question: text (BM25 over contents), vector (the question's own row of the embeddings
# against all others; a vector stands for the document of its id) and title (a word of the question).
_TITLE = r"""ti AS (SELECT query_id, document_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY length(title), document_id) AS rank
 FROM (SELECT DISTINCT query_id, document_id, title FROM q JOIN (SELECT document_id, title, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM """ + DOCS + """) USING (term)) QUALIFY rank <= 20)"""
_VECTOR = f"""ve AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM
 (SELECT b.item_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.v, o.v) AS score FROM benchmark b JOIN {VECTORS} o ON o.vec_id = b.item_id JOIN {VECTORS} e ON e.vec_id <> o.vec_id WHERE b.item_id % 20 = 0) QUALIFY rank <= 20)"""
_CHANNELS = _bm25(20) + ", " + _VECTOR + ", " + _TITLE
_HITS = _CHANNELS + """, hits AS (SELECT query_id, 'text' AS channel, id, rank, round(score, 6) AS score FROM bm UNION ALL SELECT query_id, 'vector', id, rank, round(score, 6) FROM ve UNION ALL SELECT query_id, 'title', id, rank, 1.0 FROM ti)"""


def _vector_hits(spark, d):
    e = corpus.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = _questions(spark, d).select("query_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id")
    return S.knn(e, q, 20).select("query_id", F.col("vec_id").alias("id"), "rank", F.round("score", 6).alias("score"))


def _title_hits(spark, d):
    words = lambda c: F.explode(F.array_distinct(S.tokens(F.col(c)))).alias("term")
    q = _questions(spark, d).select("query_id", words("text"))
    t = corpus.documents(spark, d).select(F.col("document_id").alias("id"), F.length("title").alias("n"), words("title"))
    found = t.join(q, "term").select("query_id", "id", "n").distinct()
    return S.top_k(found, ["query_id"], F.col("n"), "id", 20).select("query_id", "id", "rank", F.lit(1.0).alias("score"))


def _channels(spark, d):
    text = _bm25_hits(spark, d, 20).select("query_id", "id", "rank", F.round("score", 6).alias("score"))
    parts = {"text": text, "vector": _vector_hits(spark, d), "title": _title_hits(spark, d)}
    rows = [p.select("query_id", F.lit(name).alias("channel"), "id", "rank", "score") for name, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(_HITS + " SELECT query_id, channel, count(*) AS hits, max(rank) AS last_rank FROM hits GROUP BY query_id, channel")
def multi_channel_hits(spark, d):
    return _channels(spark, d).groupBy("query_id", "channel").agg(F.count("*").alias("hits"), F.max("rank").alias("last_rank"))


@query(_HITS + """ SELECT query_id, id, round(s, 9) AS rrf_score, fused_rank, channels, best_channel FROM (SELECT query_id, id, sum(1.0 / (60 + rank)) AS s, string_agg(channel, ',' ORDER BY channel) AS channels,
 arg_max(channel, score * 1000000 - CASE channel WHEN 'text' THEN 0 WHEN 'title' THEN 0.1 ELSE 0.2 END) AS best_channel, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id) AS fused_rank FROM hits GROUP BY query_id, id) WHERE fused_rank <= 10""")
def multi_channel_recall(spark, d):
    """All channels fused; a result carries the channel that gave it the highest score, the first in name on ties."""
    hits = _channels(spark, d)
    order = {"text": 0, "title": 1, "vector": 2}
    place = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(-v))])[F.col("channel")]
    best = hits.groupBy("query_id", "id").agg(F.max_by("channel", F.struct("score", place)).alias("best_channel"), F.sum(1.0 / (60 + F.col("rank"))).alias("s"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))
    top = S.top_k(best, ["query_id"], F.desc(F.round("s", 12)), "id", 10)
    return top.select("query_id", "id", F.round("s", 9).alias("rrf_score"), F.col("rank").alias("fused_rank"), "channels", "best_channel")


@query(_HITS + " SELECT query_id, id, round(sum(CASE channel WHEN 'text' THEN 0.6 ELSE 0.4 END / (60 + rank)), 9) AS score FROM hits WHERE channel IN ('text', 'vector') GROUP BY query_id, id")
def hybrid_two_way(spark, d):
    """Text and vector ranks, weighted w and 1 - w."""
    both = _channels(spark, d).filter("channel in ('text', 'vector')")
    return K.rrf(both, {"text": 0.6, "vector": 0.4}).select("query_id", "id", F.round("rrf_score", 9).alias("score"))


@query(_HITS + """ SELECT query_id, id, round(sum(w * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END), 6) AS score FROM (SELECT query_id, id, score, CASE channel WHEN 'text' THEN 0.5 WHEN 'vector' THEN 0.3 ELSE 0.2 END AS w,
 min(score) OVER (PARTITION BY query_id, channel) AS lo, max(score) OVER (PARTITION BY query_id, channel) AS hi FROM hits) GROUP BY query_id, id""")
def weighted_score_fusion(spark, d):
    """Scores at 0 to 1 within their channel, then weighted."""
    return K.score_fusion(_channels(spark, d), {"text": 0.5, "vector": 0.3, "title": 0.2}).withColumn("score", F.round("score", 6))


@query(_HITS + " SELECT query_id, id, max(score) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM hits GROUP BY query_id, id")
def cross_channel_dedupe(spark, d):
    return _channels(spark, d).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


@query(_HITS + " SELECT query_id, id, channel, rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rank, channel) = 1")
def first_seen_dedupe(spark, d):
    w = Window.partitionBy("query_id", "id").orderBy("rank", "channel")
    return _channels(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", "id", "channel", "rank")


@query(_HITS + f""", c AS (SELECT document_id, chunk_index, left(content, 300) AS content FROM {CHUNKS}), f AS (SELECT DISTINCT query_id, id FROM hits),
 one AS (SELECT document_id, min(chunk_index) AS chunk_index FROM c GROUP BY document_id)
 SELECT query_id, id, one.chunk_index, a.content, p.content AS previous, n.content AS next FROM f JOIN one ON one.document_id = id JOIN c a ON a.document_id = id AND a.chunk_index = one.chunk_index
 LEFT JOIN c p ON p.document_id = id AND p.chunk_index = one.chunk_index - 1 LEFT JOIN c n ON n.document_id = id AND n.chunk_index = one.chunk_index + 1""")
def enriched_results(spark, d):
    """Each result with its document's first chunk and the neighbours of that."""
    found = _channels(spark, d).select("query_id", F.col("id").alias("document_id")).distinct()
    # only chunks of documents that were found are joined with each other
    mine = corpus.chunks(spark, d).join(found.select("document_id").distinct(), "document_id", "left_semi")
    first = mine.groupBy("document_id").agg(F.min("chunk_index").alias("chunk_index"))
    near = R.neighbours(mine.select("document_id", "chunk_index", F.left("content", F.lit(300)).alias("content")), 300)
    return found.join(first.join(near, ["document_id", "chunk_index"]), "document_id").select("query_id", F.col("document_id").alias("id"), "chunk_index", "content", "previous", "next")


@query(_HITS + f""" SELECT query_id, id, round(0.6 * s + 0.2 * q + 0.2 / (1 + age / 30.0), 6) AS score FROM (SELECT query_id, id, max(score) AS s FROM hits WHERE channel = 'vector' GROUP BY query_id, id)
 JOIN (SELECT doc_id AS id, coalesce(quality, 0) AS q, doc_id % 90 AS age FROM documents LEFT JOIN labels USING (doc_id)) USING (id)""")
def multi_feature_rerank(spark, d):
    """Similarity, quality and recency in one weighted score."""
    quality = corpus.table(spark, d, "labels").select("doc_id", "quality")
    docs = corpus.table(spark, d, "documents").select("doc_id").join(quality, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(0)).alias("q"), (F.col("doc_id") % 90).alias("age"))
    s = F.lit(0.6) * F.col("score") + F.lit(0.2) * F.col("q") + F.lit(0.2) * K.recency(F.lit(1.0), F.col("age"))
    return _vector_hits(spark, d).join(docs, "id").select("query_id", "id", F.round(s, 6).alias("score"))


@query(_HITS + ", docs5 AS (SELECT query_id, id FROM ve WHERE rank <= 5) SELECT query_id, document_id AS id, chunk_index FROM docs5 JOIN " + CHUNKS + " ON document_id = id WHERE contains(lower(content), 'the')")
def summary_first(spark, d):
    """Documents by their vector first, then the chunks inside them that match."""
    docs = _vector_hits(spark, d).filter("rank <= 5").select("query_id", F.col("id").alias("document_id"))
    inside = corpus.chunks(spark, d).filter(F.lower("content").contains("the")).select("document_id", "chunk_index")
    return inside.join(docs, "document_id").select("query_id", F.col("document_id").alias("id"), "chunk_index")


@query(f"""SELECT document_id, chunk_index, regexp_matches(lower(content), '\\bof the\\b') AS phrase, starts_with(lower(content), 'the') AS prefix, regexp_matches(lower(content), '^t.*e') AS wildcard FROM {CHUNKS}
 WHERE regexp_matches(lower(content), '\\bof the\\b') OR starts_with(lower(content), 'the') OR regexp_matches(lower(content), '^t.*e')""")
def text_match_forms(spark, d):
    low = F.lower("content")
    forms = {"phrase": low.rlike(r"\bof the\b"), "prefix": F.startswith(low, F.lit("the")), "wildcard": low.rlike("^t.*e")}
    return corpus.chunks(spark, d).select("document_id", "chunk_index", *[c.alias(k) for k, c in forms.items()]).filter("phrase or prefix or wildcard")


@query(f"""SELECT document_id, round(sum(w), 6) AS score FROM (SELECT document_id, 1.0::DOUBLE AS w FROM {DOCS} WHERE contains(lower(content), 'license') UNION ALL SELECT document_id, 1.5 FROM {DOCS} WHERE contains(lower(title), 'the')) GROUP BY document_id""")
def boosted_clauses(spark, d):
    docs = corpus.documents(spark, d)
    score = F.when(F.lower("content").contains("license"), 1.0).otherwise(0.0) + F.when(F.lower("title").contains("the"), 1.5).otherwise(0.0)
    return docs.select("document_id", F.round(score, 6).alias("score")).filter("score > 0")


@query("""WITH v AS (SELECT item_id AS query_id, text AS variant, 1.0::DOUBLE AS weight, 0 AS i FROM benchmark UNION ALL SELECT item_id, lower(text), 0.7, 1 FROM benchmark UNION ALL SELECT item_id, split_part(text, ' ', 1), 0.5, 2 FROM benchmark)
 SELECT query_id, i, variant, weight FROM v""")
def query_variants(spark, d):
    """The question itself before its variants, whose weights are held in 0.5 to 1.0."""
    b, t = corpus.table(spark, d, "benchmark"), F.col("text")
    made = F.array(F.struct(F.lower(t).alias("variant"), F.lit(0.7).alias("weight")), F.struct(F.split(t, " ")[0].alias("variant"), F.lit(0.2).alias("weight")))
    held = F.transform(made, lambda v: F.struct(v["variant"].alias("variant"), F.greatest(F.lit(0.5), F.least(F.lit(1.0), v["weight"])).alias("weight")))
    whole = F.concat(F.array(F.struct(t.alias("variant"), F.lit(1.0).alias("weight"))), held)
    return b.select(F.col("item_id").alias("query_id"), F.posexplode(whole).alias("i", "v")).select("query_id", "i", "v.*")


@query("""SELECT item_id AS query_id, w AS term, s AS expanded FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) JOIN (VALUES ('the', 'that'), ('of', 'from'), ('the', 'this')) t(w, s) USING (w) GROUP BY ALL""")
def query_expansion(spark, d):
    pairs = spark.createDataFrame([("the", "that"), ("of", "from"), ("the", "this")], "term string, expanded string")
    words = corpus.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    return words.join(F.broadcast(pairs), "term").select("query_id", "term", "expanded")  # three rows


# --- graph -----------------------------------------------------------------------------


@query(f"SELECT r.src, r.dst, a.type AS src_type, b.type AS dst_type FROM {RELATIONS} r JOIN {ENTITIES} a ON a.id = r.src JOIN {ENTITIES} b ON b.id = r.dst WHERE a.type = 'region' OR b.type = 'supplier'")
def relations_by_endpoint(spark, d):
    e, r = corpus.graph_entities(spark, d), corpus.graph_relations(spark, d)
    a, b = (e.select(F.col("id").alias(s), F.col("type").alias(f"{s}_type")) for s in ("src", "dst"))
    return r.join(a, "src").join(b, "dst").filter("src_type = 'region' or dst_type = 'supplier'").select("src", "dst", "src_type", "dst_type")


@query(f"SELECT src, dst, weight FROM (SELECT src, dst, weight, event_order FROM (SELECT *, 0 AS event_order FROM {RELATIONS} UNION ALL SELECT src, dst, type, weight * 2, 1 FROM {RELATIONS} WHERE dst LIKE 'supplier:%')) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY event_order DESC) = 1")
def graph_merge(spark, d):
    """Edges written again replace the older ones of their ends and type."""
    old = corpus.graph_relations(spark, d).withColumn("at", F.lit(0))
    new = old.filter(F.col("dst").startswith("supplier:")).withColumns({"weight": F.col("weight") * 2, "at": F.lit(1)})
    return R.latest(old.unionByName(new), ["src", "dst", "type"], ["at"], ["weight"]).select("src", "dst", "weight")


@query(f"SELECT e.id, e.type, count(r.dst) AS children, CAST(round(coalesce(sum(weight), 0), 4) AS DOUBLE) AS weight FROM {ENTITIES} e LEFT JOIN {RELATIONS} r ON r.src = e.id WHERE e.type IN ('region', 'nation') GROUP BY e.id, e.type")
def node_degrees(spark, d):
    out = corpus.graph_relations(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    nodes = corpus.graph_entities(spark, d).filter("type in ('region', 'nation')").join(out, "id", "left")
    return nodes.select("id", "type", F.coalesce("n", F.lit(0)).alias("children"), F.round(F.coalesce("w", F.lit(0.0)), 4).alias("weight"))


@query(f"SELECT type, count(*) AS n FROM {ENTITIES} GROUP BY type")
def entity_counts(spark, d):
    return corpus.graph_entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE w AS (SELECT dst AS origin, src AS id, 1 AS steps FROM {RELATIONS} WHERE dst LIKE 'customer:%' UNION ALL SELECT w.origin, r.src, steps + 1 FROM w JOIN {RELATIONS} r ON r.dst = w.id)
 SELECT origin, id, steps FROM w""")
def root_causes(spark, d):
    """Against the direction of the edges, from every customer to all that it follows from."""
    r = corpus.graph_relations(spark, d).filter("type = 'CONTAINS'")
    start = r.filter(F.col("dst").startswith("customer:")).select(F.col("dst").alias("id"))
    return S.directed_hops(r.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, 3)


@query(f"""WITH RECURSIVE w AS (SELECT src AS origin, dst AS id, 1 AS steps FROM {RELATIONS} WHERE src LIKE 'region:%' UNION ALL SELECT w.origin, r.dst, steps + 1 FROM w JOIN {RELATIONS} r ON r.src = w.id)
 SELECT origin, count(*) AS reached, round(sum(1.0 / (steps + 1)), 6) AS score FROM w GROUP BY origin""")
def impact(spark, d):
    r = corpus.graph_relations(spark, d).filter("type = 'CONTAINS'")
    start = r.filter(F.col("src").startswith("region:")).select(F.col("src").alias("id")).distinct()
    hops = S.directed_hops(r.select("src", "dst"), start, 3)
    return hops.groupBy("origin").agg(F.count("*").alias("reached"), F.round(F.sum(1.0 / (F.col("steps") + 1)), 6).alias("score"))


@query(f"""SELECT r_name AS title, '- ' || r_name || ' (Level 1)' || string_agg(chr(10) || '  ·· ' || n_name, '' ORDER BY n_name) AS outline FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def outline_text(spark, d):
    """A heading with its children below, indented and dotted by depth."""
    line = F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.lit(2)), F.repeat(F.lit("·"), F.lit(2)), F.lit(" "), F.col("n_name"))
    j = corpus.table(spark, d, "nation").join(corpus.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kids = j.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))).alias("kids"))
    return kids.select(F.col("r_name").alias("title"), F.concat(F.lit("- "), "r_name", F.lit(" (Level 1)"), F.array_join(F.col("kids")["line"], "")).alias("outline"))


@query("SELECT n_name AS title, count(*) AS chunks, min(c_custkey) AS first_chunk, 1.0::DOUBLE AS score FROM nation JOIN customer ON contains(c_name, right('0' || n_nationkey, 2)) AND c_nationkey = n_nationkey GROUP BY n_name")
def toc_chunk_ids(spark, d):
    """A heading's chunks: those of its document whose section title contains it."""
    heads = corpus.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title"), F.right(F.concat(F.lit("0"), F.col("n_nationkey").cast("string")), F.lit(2)).alias("mark"))
    j = corpus.table(spark, d, "customer").join(F.broadcast(heads), F.col("c_nationkey") == F.col("n_nationkey")) if heads.limit(1001).count() <= 1000 else corpus.table(spark, d, "customer").join(heads, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.filter(F.contains("c_name", "mark")).groupBy("title").agg(F.count("*").alias("chunks"), F.min("c_custkey").alias("first_chunk"), F.lit(1.0).alias("score"))


# --- lookups and observability -------------------------------------------------------------


@query(f"""SELECT d.document_id, coalesce(t.n, 0) AS text_rows, coalesce(v.n, 0) AS vector_rows, coalesce(t.n, 0) > 0 AS in_text, coalesce(v.n, 0) > 0 AS in_vector FROM {DOCS} d LEFT JOIN (SELECT document_id, count(*) AS n FROM {CHUNKS} GROUP BY document_id) t USING (document_id)
 LEFT JOIN (SELECT vec_id AS document_id, count(*) AS n FROM embeddings GROUP BY vec_id) v USING (document_id)""")
def index_status(spark, d):
    t = corpus.chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("t"))
    v = corpus.table(spark, d, "embeddings").groupBy(F.col("vec_id").alias("document_id")).agg(F.count("*").alias("v"))
    n = lambda c: F.coalesce(c, F.lit(0))
    j = corpus.documents(spark, d).select("document_id").join(t, "document_id", "left").join(v, "document_id", "left")
    return j.select("document_id", n("t").alias("text_rows"), n("v").alias("vector_rows"), (n("t") > 0).alias("in_text"), (n("v") > 0).alias("in_vector"))


@query(f"""SELECT d.document_id, d.n_words, c.chunks, c.largest, u.calls, u.tokens FROM (SELECT document_id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS n_words FROM {DOCS}) d
 LEFT JOIN (SELECT document_id, count(*) AS chunks, max(length(content)) AS largest FROM {CHUNKS} GROUP BY document_id) c USING (document_id)
 LEFT JOIN (SELECT document_id, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM {USAGE} GROUP BY document_id) u USING (document_id)""")
def document_observability(spark, d):
    words = corpus.documents(spark, d).select("document_id", T.word_count(F.col("content")).cast("bigint").alias("n_words"))
    c = corpus.chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).cast("bigint").alias("largest"))
    u = corpus.usage(spark, d).groupBy("document_id").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return words.join(c, "document_id", "left").join(u, "document_id", "left")


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events QUALIFY step <= 50")
def event_listing(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return corpus.table(spark, d, "events").withColumn("step", F.row_number().over(w)).filter("step <= 50").select("user_id", "event_id", "event_type", "step")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def unique_in_order(spark, d):
    """Distinct values in the order in which they first came."""
    first = corpus.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    lists = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))  # at most all types
    return lists.select("user_id", F.array_join(F.col("x")["event_type"], ",").alias("types"))


@query(f"SELECT src, dst, weight FROM (SELECT src, dst, weight FROM {RELATIONS} ORDER BY dst LIMIT 50) ORDER BY weight DESC")
def limited_then_sorted(spark, d):
    return corpus.graph_relations(spark, d).orderBy("dst", "src").limit(50).select("src", "dst", "weight").orderBy(F.desc("weight"), "dst", "src")


@query(f"SELECT document_id, chunk_index, content FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) = 1")
def first_chunks(spark, d):
    return R.latest(corpus.chunks(spark, d).withColumn("back", -F.col("chunk_index")), ["document_id"], ["back"], ["chunk_index", "content"])


@query(f"SELECT document_id FROM {DOCS} WHERE kb_id IN (SELECT kb_id FROM {DOCS} WHERE tenant_id = 'en' GROUP BY kb_id HAVING count(*) >= 3)")
def kb_scope(spark, d):
    """Documents of all active bases of a tenant."""
    docs = corpus.documents(spark, d)
    active = docs.filter("tenant_id = 'en'").groupBy("kb_id").agg(F.count("*").alias("n")).filter("n >= 3").select("kb_id")
    return docs.join(active, "kb_id", "left_semi").select("document_id")


@query("""SELECT event_id, ts + INTERVAL 24 HOUR AS expires_at, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000 AS gap_ms,
 ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS last_week, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events""")
def time_functions(spark, d):
    """Expiry, gaps in milliseconds, a relative filter, and parsing that gives null where a time is none."""
    e = corpus.table(spark, d, "events").select("event_id", "user_id", "ts")
    last = e.agg(F.max("ts").alias("last"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    raw = F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.crossJoin(F.broadcast(last)).select(  # one row
        "event_id", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), F.floor((micros - F.lag(micros).over(w)) / 1000).alias("gap_ms"),
        (F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).alias("last_week"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).cast("timestamp_ntz").alias("parsed"),
    )


@query("SELECT user_id, count(*) AS shown, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS verified, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS success FROM events GROUP BY user_id")
def feedback_signals(spark, d):
    kind = F.col("event_type")
    return corpus.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("shown"), F.sum((kind == "purchase").cast("bigint")).alias("verified"), F.round(F.avg(F.when(kind == "error", 0.0).otherwise(1.0)), 6).alias("success"))


@query("""SELECT text_hash, hits, round(hits * n * 0.001::DOUBLE, 6) AS saved FROM (SELECT md5(text) AS text_hash, count(*) - 1 AS hits, length(any_value(text)) AS n FROM conversations GROUP BY text) ORDER BY hits DESC, text_hash LIMIT 10""")
def cache_statistics(spark, d):
    """The ten cached answers with most hits, and what they saved."""
    c = corpus.table(spark, d, "conversations").groupBy("text").agg((F.count("*") - 1).alias("hits"))
    return c.select(F.md5("text").alias("text_hash"), "hits", F.round(F.col("hits") * F.length("text") * 0.001, 6).alias("saved")).orderBy(F.desc("hits"), "text_hash").limit(10)


@query(f"""SELECT service, round(sum((input_tokens * i + output_tokens * o) / 1000), 6) AS cost FROM (SELECT *, regexp_replace(CASE event_id % 3 WHEN 0 THEN 'eu.' WHEN 1 THEN 'us.' ELSE '' END || service || '-large-v1', '^(us|eu|apac)\\.', '') AS model FROM {USAGE})
 JOIN (VALUES ('click', 0.003, 0.015), ('view', 0.001, 0.002), ('error', 0.0, 0.001)) p(prefix, i, o) ON starts_with(model, prefix) GROUP BY service""")
def usage_cost_by_pattern(spark, d):
    """Prices by the start of a model's name, whatever region stands before it."""
    prices = spark.createDataFrame([("click", 0.003, 0.015), ("view", 0.001, 0.002), ("error", 0.0, 0.001)], "prefix string, i double, o double")
    i = F.col("event_id") % 3
    model = F.regexp_replace(F.concat(F.when(i == 0, "eu.").when(i == 1, "us.").otherwise(""), "service", F.lit("-large-v1")), r"^(us|eu|apac)\.", "")
    u = corpus.usage(spark, d).withColumn("model", model)
    priced = u.join(F.broadcast(prices), F.startswith(F.col("model"), F.col("prefix")))  # three rows
    return priced.groupBy("service").agg(F.round(F.sum((F.col("input_tokens") * F.col("i") + F.col("output_tokens") * F.col("o")) / 1000), 6).alias("cost"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'concept_query' WHEN role = 'assistant' THEN 'factual' ELSE 'code_search' END AS intent, 0.8::DOUBLE AS confidence FROM conversations""")
def analysis_defaults(spark, d):
    """A model's analysis parsed; a missing or zero confidence is 0.8, and intents go to the router's words."""
    words = F.create_map(*[F.lit(x) for x in ("navigation", "concept_query", "content_search", "code_search", "factual", "factual")])
    said = F.when(F.col("role") == "user", '{"primary_intent": "other", "confidence": 0}').when(F.col("role") == "assistant", '{"primary_intent": "factual"}').otherwise('{"primary_intent": "content_search"}')
    a = F.from_json(said, "primary_intent string, confidence double")
    c = corpus.table(spark, d, "conversations").select("conv_id", "turn", a.alias("a"))
    return c.select("conv_id", "turn", F.coalesce(F.try_element_at(words, F.col("a.primary_intent")), F.lit("concept_query")).alias("intent"), F.coalesce(F.nullif(F.col("a.confidence"), F.lit(0.0)), F.lit(0.8)).alias("confidence"))
