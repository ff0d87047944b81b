"""Registered queries: filters, joins, aggregates and text functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions import text as T
from docloom.operators import relational as R
from docloom.operators.retrieval import tokens

QUERIES: dict = {}
ORACLES: dict = {}

DOCS = "(SELECT doc_id AS document_id, lang AS tenant_id, source AS kb_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents)"
CHUNKS = """(SELECT document_id, tenant_id, kb_id, i - 1 AS chunk_index, parts[i] AS content FROM
 (SELECT document_id, tenant_id, kb_id, string_split(content, chr(10)) AS parts, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM """ + DOCS + """)
 WHERE trim(parts[i], ' ') <> '')"""
USAGE = """(SELECT event_id, user_id AS document_id, event_type AS service, CASE WHEN event_id % 3 = 0 THEN 'embedding' ELSE 'chat' END AS model_type,
 CAST(json_extract(props, '$.k') AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, value AS cost, ts AS created_at FROM events)"""
SUMS = """count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
 CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens, round(coalesce(sum(cost), 0.0), 4) AS cost"""
DOC_TYPES = [("process", "step|process|procedure"), ("experience", "experience|lesson"), ("data", "table|data")]
TOK = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT document_id, title FROM {DOCS} WHERE tenant_id = 'en' AND kb_id = 'src3' ORDER BY document_id DESC LIMIT 20")
def documents_filtered_page(spark, d):
    docs = R.optional_filters(corpus.documents(spark, d), tenant_id="en", kb_id="src3", status="")
    return R.page(docs, [F.desc("document_id")], 1, 20).select("document_id", "title")


@query(f"SELECT document_id, kb_id FROM {DOCS} WHERE title ILIKE '%thand%' OR content ILIKE '%idiot%'")
def keyword_ilike_or(spark, d):
    docs = corpus.documents(spark, d)
    return docs.filter(F.col("title").ilike("%thand%") | F.col("content").ilike("%idiot%")).select("document_id", "kb_id")


@query(f"SELECT document_id, left(content, 300) AS preview FROM {DOCS} WHERE kb_id IN ('src1', 'src2') AND tenant_id = 'de'")
def term_filters(spark, d):
    docs = R.optional_filters(corpus.documents(spark, d), kb_id=["src1", "src2"], tenant_id="de")
    return docs.select("document_id", F.left("content", F.lit(300)).alias("preview"))


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS expires_at FROM events) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-02 00:00:00'")
def expiry_filter(spark, d):
    e = corpus.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("expires_at"))
    return R.unexpired(e, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).select("event_id")


@query(f"SELECT document_id, coalesce(nullif(CASE WHEN document_id % 3 = 0 THEN 'new ' || document_id WHEN document_id % 3 = 1 THEN '' END, ''), title) AS title FROM {DOCS}")
def partial_update(spark, d):
    docs = corpus.documents(spark, d).select("document_id", "title")
    i = F.col("document_id")
    delta = docs.filter(i % 3 != 2).select(i, F.when(i % 3 == 0, F.concat(F.lit("new "), i.cast("string"))).otherwise("").alias("title"))
    return R.partial_update(docs, delta, "document_id", ["title"])


@query(f"SELECT c.kb_id, count(*) AS n_chunks, count(DISTINCT c.document_id) AS n_docs, CAST(sum(length(c.content)) AS BIGINT) AS n_chars FROM {CHUNKS} c JOIN {DOCS} d USING (document_id) WHERE d.tenant_id = 'en' GROUP BY c.kb_id")
def chunks_join_documents(spark, d):
    docs = corpus.documents(spark, d).filter("tenant_id = 'en'").select("document_id")
    j = corpus.chunks(spark, d).join(docs, "document_id")
    return j.groupBy("kb_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_docs"), F.sum(F.length("content")).alias("n_chars"))


ENTITIES = """(SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier)"""
RELATIONS = """(SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CONTAINS' AS type, 1.0::DOUBLE AS weight FROM nation UNION ALL
 SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 0.5 FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS', 0.8 FROM supplier)"""


@query(f"SELECT r.src, r.dst, r.weight, a.name AS src_name, b.name AS dst_name, b.type AS dst_type FROM {RELATIONS} r JOIN {ENTITIES} a ON r.src = a.id JOIN {ENTITIES} b ON r.dst = b.id")
def edges_with_endpoints(spark, d):
    e, r = corpus.graph_entities(spark, d), corpus.graph_relations(spark, d)
    a = e.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = e.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    return r.join(a, "src").join(b, "dst").select("src", "dst", "weight", "src_name", "dst_name", "dst_type")


@query(f"""SELECT u.document_id, u.calls, u.total_tokens, coalesce(t.title, '') AS title FROM
 (SELECT document_id, {SUMS} FROM {USAGE} GROUP BY document_id ORDER BY total_tokens DESC, document_id LIMIT 10) u LEFT JOIN {DOCS} t USING (document_id)""")
def usage_top_documents_titles(spark, d):
    return R.top_documents(corpus.usage(spark, d), corpus.documents(spark, d))


@query(f"""SELECT c.document_id, c.chunk_index, left(p.content, 300) AS previous, left(n.content, 300) AS next FROM {CHUNKS} c LEFT JOIN {CHUNKS} p ON p.document_id = c.document_id AND p.chunk_index = c.chunk_index - 1
 LEFT JOIN {CHUNKS} n ON n.document_id = c.document_id AND n.chunk_index = c.chunk_index + 1""")
def neighbour_chunks_selfjoin(spark, d):
    return R.neighbours(corpus.chunks(spark, d)).select("document_id", "chunk_index", "previous", "next")


@query(f"SELECT document_id, chunk_index, left(lag(content) OVER w, 300) AS previous, left(lead(content) OVER w, 300) AS next FROM {CHUNKS} WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)")
def neighbour_chunks_lag(spark, d):
    return R.neighbours_by_order(corpus.chunks(spark, d)).select("document_id", "chunk_index", "previous", "next")


@query(f"SELECT document_id, chunk_index FROM {CHUNKS} WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_restrict(spark, d):
    good = corpus.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    return corpus.chunks(spark, d).join(good, "document_id", "left_semi").select("document_id", "chunk_index")


@query(f"SELECT document_id, chunk_index, length(content) AS n FROM {CHUNKS} WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 0, 0 FROM labels WHERE toxic = 1")
def anti_join_cleanup(spark, d):
    bad = corpus.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(0).alias("n"))
    old = corpus.chunks(spark, d).select("document_id", "chunk_index", F.length("content").alias("n"))
    return R.replace_by_key(old, bad, "document_id")


@query(f"""WITH refs AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'nation:' || c_nationkey WHEN c_custkey % 3 = 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) ELSE 'lost' END AS ref FROM customer),
 names AS (SELECT name, min(id) AS id FROM {ENTITIES} GROUP BY name)
 SELECT k, coalesce(e.id, n.id) AS ref FROM refs LEFT JOIN {ENTITIES} e ON e.id = ref LEFT JOIN names n ON n.name = ref WHERE coalesce(e.id, n.id) IS NOT NULL""")
def id_resolution_fallback(spark, d):
    nation = corpus.table(spark, d, "nation").select("n_nationkey", "n_name")
    c = corpus.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("c_custkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).when(k % 3 == 1, F.col("n_name")).otherwise("lost")
    return R.resolve_ids(c.select(k.alias("k"), ref.alias("ref")), "ref", corpus.graph_entities(spark, d))


@query(f"SELECT {SUMS} FROM {USAGE}")
def usage_totals(spark, d):
    return R.totals(corpus.usage(spark, d))


@query(f"SELECT service, {SUMS} FROM {USAGE} GROUP BY service")
def usage_by_service(spark, d):
    return R.totals(corpus.usage(spark, d), "service")


@query(f"SELECT model_type, service, {SUMS} FROM {USAGE} GROUP BY model_type, service")
def usage_by_two_keys(spark, d):
    return R.totals(corpus.usage(spark, d), "model_type", "service")


@query(f"SELECT kb_id, tenant_id, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY kb_id), 6) AS share FROM {DOCS} GROUP BY kb_id, tenant_id")
def language_distribution(spark, d):
    return R.share_by(corpus.documents(spark, d), "kb_id", "tenant_id").select("kb_id", "tenant_id", "n", F.round("share", 6).alias("share"))


@query(f"SELECT document_id, count(*) AS total, count(DISTINCT t) AS n_distinct, round(avg(strlen(t)), 6) AS avg_bytes FROM (SELECT document_id, unnest({TOK}) AS t FROM {DOCS}) GROUP BY document_id")
def token_stats(spark, d):
    t = corpus.documents(spark, d).select("document_id", F.explode(tokens(F.col("content"))).alias("t"))
    per = t.groupBy("document_id", "t").agg(F.count("*").alias("n"))
    return per.groupBy("document_id").agg(F.sum("n").alias("total"), F.count("*").alias("n_distinct"), F.round(F.sum(F.octet_length("t") * F.col("n")) / F.sum("n"), 6).alias("avg_bytes"))


@query(f"""SELECT token, n, round(12 + 24.0 * (n - min(n) OVER ()) / greatest(max(n) OVER () - min(n) OVER (), 1), 4) AS size FROM
 (SELECT t AS token, count(*) AS n FROM (SELECT unnest({TOK}) AS t FROM {DOCS}) GROUP BY t ORDER BY n DESC, t LIMIT 80)""")
def token_cloud(spark, d):
    t = corpus.documents(spark, d).select(F.explode(tokens(F.col("content"))).alias("token"))
    top = t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(80)
    w = Window.partitionBy(F.lit(1))  # eighty rows
    low, high = F.min("n").over(w), F.max("n").over(w)
    return top.select("token", "n", F.round(12 + 24.0 * (F.col("n") - low) / F.greatest(high - low, F.lit(1)), 4).alias("size"))


@query(f"SELECT document_id, count(DISTINCT CASE WHEN output_tokens % 2 = 0 THEN service END) AS done, round(count(DISTINCT CASE WHEN output_tokens % 2 = 0 THEN service END) / 12.0, 6) AS progress FROM {USAGE} GROUP BY document_id")
def pipeline_progress(spark, d):
    u = corpus.usage(spark, d).groupBy("document_id").agg(F.countDistinct(F.when(F.col("output_tokens") % 2 == 0, F.col("service"))).alias("done"))
    return u.select("document_id", "done", F.round(F.col("done") / 12.0, 6).alias("progress"))


@query(f"SELECT service, round(sum((input_tokens * CASE model_type WHEN 'chat' THEN 0.003 ELSE 0.0001 END + output_tokens * CASE model_type WHEN 'chat' THEN 0.015 ELSE 0.0 END) / 1000), 6) AS estimated FROM {USAGE} GROUP BY service")
def usage_cost(spark, d):
    prices = spark.createDataFrame([("chat", 0.003, 0.015), ("embedding", 0.0001, 0.0)], "model_type string, input_price double, output_price double")
    return R.usage_cost(corpus.usage(spark, d), prices).groupBy("service").agg(F.round(F.sum("estimated_cost"), 6).alias("estimated"))


@query(f"SELECT document_id, chunk_index, len(list_filter(list_transform(regexp_extract_all(content, '[^。！？.!?]+'), lambda s: trim(s, ' ')), lambda s: s <> '')) AS n_sentences FROM {CHUNKS}")
def sentence_split(spark, d):
    return corpus.chunks(spark, d).select("document_id", "chunk_index", F.size(T.sentences(F.col("content"))).cast("bigint").alias("n_sentences"))


@query(f"""SELECT document_id, t AS keyword, n FROM (SELECT document_id, t, n, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, t) AS r FROM
 (SELECT document_id, t, count(*) AS n FROM (SELECT document_id, unnest({TOK}) AS t FROM {DOCS}) WHERE length(t) >= 2 AND t NOT IN ('the','and','of','to','in') GROUP BY document_id, t)) WHERE r <= 20""")
def general_keywords_top20(spark, d):
    t = corpus.documents(spark, d).select("document_id", F.explode(tokens(F.col("content"))).alias("keyword"))
    n = t.filter((F.length("keyword") >= 2) & ~F.col("keyword").isin("the", "and", "of", "to", "in")).groupBy("document_id", "keyword").agg(F.count("*").alias("n"))
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "keyword")
    return n.withColumn("r", F.row_number().over(w)).filter("r <= 20").drop("r")


@query(rf"""SELECT document_id, CASE WHEN c + l + o = 0 THEN 'unknown' WHEN c / (c + l + o) > 0.3 AND l / (c + l + o) > 0.3 THEN 'mixed' WHEN c / (c + l + o) > 0.5 THEN CASE WHEN j THEN 'ja' ELSE 'zh' END
 WHEN l / (c + l + o) > 0.5 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT document_id, length(regexp_replace(s, '[^\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]', '', 'g'))::DOUBLE AS c,
 length(regexp_replace(s, '[^A-Za-z]', '', 'g'))::DOUBLE AS l, length(regexp_replace(s, '[\x00-\x7f\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]', '', 'g'))::DOUBLE AS o, regexp_matches(s, '[\x{{3040}}-\x{{30ff}}]') AS j
 FROM (SELECT document_id, left(coalesce(content, ''), 2000) AS s FROM {DOCS}))""")
def doc_language(spark, d):
    return corpus.documents(spark, d).select("document_id", T.language(F.col("content")).alias("language"))


@query(f"""SELECT document_id, CASE WHEN strlen(content) < 300 THEN 'brief' WHEN regexp_matches(lower(content), 'step|process|procedure') THEN 'process' WHEN regexp_matches(lower(content), 'experience|lesson') THEN 'experience'
 WHEN regexp_matches(lower(content), 'table|data') THEN 'data' ELSE 'general' END AS doc_type, strlen(content) > 5000 AS summarize, len(regexp_split_to_array(content, '\\|')) - 1 > 5 AS has_table FROM {DOCS}""")
def doc_type_and_features(spark, d):
    c = F.col("content")
    return corpus.documents(spark, d).select("document_id", T.document_type(c, DOC_TYPES, "general").alias("doc_type"), (F.octet_length(c) > 5000).alias("summarize"), (F.regexp_count(c, F.lit(r"\|")) > 5).alias("has_table"))


@query(f"SELECT document_id, sha256(content || '|keyword|v1') AS cache_key, left(sha256(document_id || '|' || content), 32) AS short_key FROM {DOCS}")
def content_hash_keys(spark, d):
    i, c = F.col("document_id").cast("string"), F.col("content")
    return corpus.documents(spark, d).select("document_id", F.sha2(F.concat(c, F.lit("|keyword|v1")), 256).alias("cache_key"), F.left(F.sha2(F.concat(i, F.lit("|"), c), 256), F.lit(32)).alias("short_key"))


@query(f"SELECT document_id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS n_words FROM {DOCS}")
def word_count(spark, d):
    return corpus.documents(spark, d).select("document_id", T.word_count(F.col("content")).cast("bigint").alias("n_words"))


@query(f"""SELECT document_id, substring(content, greatest(pos - 40, 1), least(pos - 1, 40)) || '<em>' || substring(content, pos, 5) || '</em>' || substring(content, pos + 5, 40) AS fragment
 FROM (SELECT document_id, content, instr(lower(content), 'idiot') AS pos FROM {DOCS}) WHERE pos > 0""")
def highlight_first(spark, d):
    h = corpus.documents(spark, d).select("document_id", T.highlight(F.col("content"), F.lit("idiot")).alias("fragment"))
    return h.filter("fragment is not null")


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_object_split(spark, d):
    e = corpus.table(spark, d, "events").select("event_id", "props", F.explode(F.json_object_keys("props")).alias("key"))
    return e.select("event_id", "key", F.from_json("props", "map<string,string>")[F.col("key")].alias("value"))


@query(f"SELECT document_id, CAST(floor(i / 10) AS BIGINT) AS batch, count(*) AS n FROM (SELECT document_id, unnest(range(0, len(string_split(content, chr(10))))) AS i FROM {DOCS}) GROUP BY 1, 2")
def json_array_batch(spark, d):
    lines = corpus.documents(spark, d).select("document_id", F.to_json(F.split("content", "\n", -1)).alias("array"))
    return lines.select("document_id", F.posexplode(F.from_json("array", "array<string>")).alias("i", "x")).groupBy("document_id", F.floor(F.col("i") / 10).alias("batch")).agg(F.count("*").alias("n"))


@query(f"""SELECT document_id, CAST(i AS BIGINT) AS part, substring(content, CAST(i * 400 + 1 AS BIGINT), 500) AS content FROM (SELECT document_id, content, unnest(range(0, greatest(CAST(ceil((length(content) - 100) / 400.0) AS BIGINT), 1))) AS i FROM {DOCS} WHERE content <> '')""")
def sliding_chunks_fixed(spark, d):
    docs = corpus.documents(spark, d).filter("content <> ''")
    last = F.greatest(F.ceil((F.length("content") - 100) / 400.0), F.lit(1)) - 1
    return docs.select("document_id", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")).select(
        "document_id", "part", F.substring("content", (F.col("part") * 400 + 1).cast("int"), F.lit(500)).alias("content")
    )


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS content FROM pages")
def html_strip_tags(spark, d):
    flat = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    return corpus.table(spark, d, "pages").select("page_id", F.trim(flat).alias("content"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_enrichment(spark, d):
    return R.latest(corpus.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("SELECT role, count(*) AS calls, count(*) - count(DISTINCT text) AS hits FROM conversations GROUP BY role")
def cache_hits(spark, d):
    return R.cache_hits(corpus.table(spark, d, "conversations"), "role", "text")


@query(f"SELECT kb_id, count(*) AS documents, sum(length(content)) AS chars, sum(n) AS chunks FROM {DOCS} JOIN (SELECT document_id, count(*) AS n FROM {CHUNKS} GROUP BY document_id) USING (document_id) GROUP BY kb_id")
def kb_stats(spark, d):
    lines = F.size(F.filter(F.split("content", "\n", -1), lambda x: F.trim(x) != ""))
    docs = corpus.documents(spark, d).select("kb_id", F.length("content").alias("c"), lines.alias("n")).filter("n > 0")
    return docs.groupBy("kb_id").agg(F.count("*").alias("documents"), F.sum("c").alias("chars"), F.sum("n").alias("chunks"))


@query("SELECT c_custkey, 'c_name为' || c_name || '，c_mktsegment为' || c_mktsegment || '，c_nationkey为' || c_nationkey AS content FROM customer")
def table_rows_to_text(spark, d):
    return corpus.table(spark, d, "customer").select("c_custkey", R.row_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("content"))


@query(f"SELECT document_id, chunk_index, chunk_index // 8 AS parent, length(string_agg(content, chr(10)) OVER (PARTITION BY document_id, chunk_index // 8 ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS parent_chars FROM {CHUNKS} QUALIFY contains(content, 'license')")
def parent_child_lookup(spark, d):
    """Chunks that hold a word, with the size of the parent of eight lines that they belong to."""
    c = corpus.chunks(spark, d).select("document_id", "chunk_index", "content", F.floor(F.col("chunk_index") / 8).alias("parent"))
    parents = c.groupBy("document_id", "parent").agg((F.sum(F.length("content")) + F.count("*") - 1).alias("parent_chars"))
    return c.filter(F.col("content").contains("license")).select("document_id", "chunk_index", "parent").join(parents, ["document_id", "parent"])
