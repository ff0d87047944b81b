"""Registered queries: index structures, routing, code splitting and context assembly, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions import text as T
from docloom.operators import ranking as K
from docloom.operators import relational as R
from docloom.operators import retrieval as S
from docloom.plans.analytics import CHUNKS, DOCS, ENTITIES, RELATIONS, TOK
from docloom.plans.enrichment import _TYPE
from docloom.plans.service import _HITS, _channels

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id AS document_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def labelled_documents(spark, d):
    labels = corpus.table(spark, d, "labels").select("doc_id", "toxic")
    j = corpus.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return j.filter(F.col("toxic").isNotNull()).withColumnRenamed("doc_id", "document_id")


@query(_HITS + f""", c AS (SELECT query_id, h.id AS document_id, c.chunk_index, channel, 1.0 / (60 + rank) AS s FROM hits h JOIN {CHUNKS} c ON c.document_id = h.id)
 SELECT query_id, document_id, round(sum(s), 6) AS total, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources, count(DISTINCT chunk_index) AS chunks FROM c GROUP BY query_id, document_id""")
def documents_of_results(spark, d):
    """The chunks of all channels grouped into documents, with the set of channels."""
    hits = _channels(spark, d).select("query_id", F.col("id").alias("document_id"), "channel", (1.0 / (60 + F.col("rank"))).alias("s"))
    c = corpus.chunks(spark, d).select("document_id", "chunk_index").join(hits, "document_id")
    return c.groupBy("query_id", "document_id").agg(F.round(F.sum("s"), 6).alias("total"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("sources"), F.countDistinct("chunk_index").alias("chunks"))


@query(_HITS + """ SELECT query_id, id, greatest(floor(s / max(s) OVER (PARTITION BY query_id) * 1000 + 0.5) / 10, 1.0) AS relevance FROM (SELECT query_id, id, round(sum(CASE channel WHEN 'title' THEN 0.001 ELSE 1.0 END / (60 + rank)), 12) AS s FROM hits GROUP BY query_id, id)""")
def relevance_floor(spark, d):
    """The share of the best fused score in percent, never below 1."""
    fused = K.rrf(_channels(spark, d), {"title": 0.001}).withColumn("s", F.round("rrf_score", 12))
    top = fused.groupBy("query_id").agg(F.max("s").alias("top"))
    return fused.join(top, "query_id").select("query_id", "id", F.greatest(F.floor(F.col("s") / F.col("top") * 1000 + 0.5) / 10, F.lit(1.0)).alias("relevance"))


@query(f"SELECT document_id, chunk_index FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY document_id, left(content, 200) ORDER BY chunk_index) = 1")
def first_of_prefix(spark, d):
    w = Window.partitionBy("document_id", F.left("content", F.lit(200))).orderBy("chunk_index")
    return corpus.chunks(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("document_id", "chunk_index")


@query(f"SELECT id, name, level FROM (SELECT id, name, CASE type WHEN 'region' THEN 1 WHEN 'nation' THEN 2 ELSE 3 END AS level FROM {ENTITIES}) WHERE name ILIKE '%a%' ORDER BY level, name, id LIMIT 50")
def toc_by_level(spark, d):
    level = F.when(F.col("type") == "region", 1).when(F.col("type") == "nation", 2).otherwise(3)
    found = R.contains_any(corpus.graph_entities(spark, d), "a", "name").select("id", "name", level.alias("level"))
    return found.orderBy("level", "name", "id").limit(50)


@query(_HITS + """, f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id) AS r FROM hits GROUP BY query_id, id)
 SELECT query_id, id, r AS fused_rank, CASE WHEN count(*) OVER (PARTITION BY query_id) <= 5 THEN 'model' ELSE 'recency' END AS route FROM f WHERE r <= 30""")
def rerank_candidates(spark, d):
    """At most thirty candidates of a question go on; few go to the model, more are reranked by age."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "id")
    top = K.rrf(_channels(spark, d)).withColumn("fused_rank", F.row_number().over(w)).filter("fused_rank <= 30")
    return top.select("query_id", "id", "fused_rank", F.when(F.count("*").over(Window.partitionBy("query_id")) <= 5, "model").otherwise("recency").alias("route"))


def _cloud(n: int, low: int, high: int, tail: str = "") -> str:
    return f"SELECT token, kind, n, round({low} + {high - low}.0 * (n - min(n) OVER ()) / greatest(max(n) OVER () - min(n) OVER (), 1), 4) AS size FROM (SELECT t AS token, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'number' ELSE 'word' END AS kind, count(*) AS n FROM (SELECT unnest({TOK}) AS t FROM {DOCS}) {tail} GROUP BY t ORDER BY n DESC, t LIMIT {n})"


def _sized(top, low: int, high: int):
    ends = top.agg(F.min("n").alias("a"), F.max("n").alias("z"))  # one row
    return top.crossJoin(F.broadcast(ends)).select("token", "kind", "n", F.round(low + float(high - low) * (F.col("n") - F.col("a")) / F.greatest(F.col("z") - F.col("a"), F.lit(1)), 4).alias("size"))


@query(_cloud(80, 12, 36))
def token_cloud_by_kind(spark, d):
    t = corpus.documents(spark, d).select(F.explode(S.tokens(F.col("content"))).alias("token"))
    top = t.groupBy("token", F.when(F.col("token").rlike("^[0-9]+$"), "number").otherwise("word").alias("kind")).agg(F.count("*").alias("n"))
    return _sized(top.orderBy(F.desc("n"), "token").limit(80), 12, 36)


@query(_cloud(20, 12, 28, "WHERE length(t) > 3"))
def word_cloud(spark, d):
    t = corpus.documents(spark, d).select(F.explode(S.tokens(F.col("content"))).alias("token")).filter("length(token) > 3")
    top = t.groupBy("token", F.when(F.col("token").rlike("^[0-9]+$"), "number").otherwise("word").alias("kind")).agg(F.count("*").alias("n"))
    return _sized(top.orderBy(F.desc("n"), "token").limit(20), 12, 28)


@query(r"""SELECT document_id, language, round(CASE language WHEN 'mixed' THEN 0.6 WHEN 'zh' THEN c / t WHEN 'en' THEN l / t ELSE CASE WHEN t = 0 THEN 0.0 ELSE 0.5 END END, 6) AS confidence FROM
 (SELECT *, CASE WHEN t = 0 THEN 'unknown' WHEN c / t > 0.3 AND l / t > 0.3 THEN 'mixed' WHEN c / t > 0.5 THEN 'zh' WHEN l / t > 0.5 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT *, c + l + o AS t FROM
 (SELECT document_id, length(regexp_replace(s, '[^\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]', '', 'g'))::DOUBLE AS c, length(regexp_replace(s, '[^A-Za-z]', '', 'g'))::DOUBLE AS l, length(regexp_replace(s, '[\x00-\x7f\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]', '', 'g'))::DOUBLE AS o
 FROM (SELECT doc_id AS document_id, text AS s FROM documents))))""")
def language_confidence(spark, d):
    """The language of the whole text and how sure it is: the share of its letters, 0.6 if mixed, 0.5 if unknown, 0 without letters."""
    both = T.language_shares(F.col("content"))
    return corpus.documents(spark, d).select("document_id", both.alias("x")).select("document_id", "x.language", F.round("x.confidence", 6).alias("confidence"))


@query("""SELECT conv_id, turn, CASE WHEN nav AND ask THEN 'navigate_and_search' WHEN nav AND long THEN 'jump_and_summarize' WHEN nav THEN 'navigate' WHEN ask THEN 'search' ELSE 'outline' END AS strategy,
 CASE WHEN ask AND long THEN 'hybrid' WHEN long THEN 'external' ELSE 'internal' END AS route FROM (SELECT conv_id, turn, turn % 2 = 0 AS nav, contains(text, '?') OR contains(text, 'the') AS ask, length(text) > 200 AS long FROM conversations)""")
def intent_routing(spark, d):
    """Primary and secondary intent to one of five strategies, and to where the answer is looked for."""
    nav, ask, long = F.col("turn") % 2 == 0, F.contains("text", F.lit("?")) | F.contains("text", F.lit("the")), F.length("text") > 200
    strategy = F.when(nav & ask, "navigate_and_search").when(nav & long, "jump_and_summarize").when(nav, "navigate").when(ask, "search").otherwise("outline")
    route = F.when(ask & long, "hybrid").when(long, "external").otherwise("internal")
    return corpus.table(spark, d, "conversations").select("conv_id", "turn", strategy.alias("strategy"), route.alias("route"))


_PARTS = """SELECT p_partkey, 'func ' || replace(p_name, ' ', '_') || '() {' || chr(10) || '  x := 1' || chr(10) || '}' AS a, 'type T' || p_size || ' struct {' || chr(10) || '}' AS b, 'var v = ' || chr(34) || p_brand || chr(34) AS c FROM part"""


@query(f"""SELECT p_partkey, 0 AS i, 'package p' AS content, 'preamble' AS kind, '' AS symbol FROM part UNION ALL SELECT p_partkey, 1, a, 'code_section', regexp_extract(a, '^func (\\w+)', 1) FROM ({_PARTS})
 UNION ALL SELECT p_partkey, 2, b, 'code_section', regexp_extract(b, '^type (\\w+)', 1) FROM ({_PARTS}) UNION ALL SELECT p_partkey, 3, c, 'code_section', 'v' FROM ({_PARTS})""")
def code_sections(spark, d):
    """Code split before its top-level declarations, with what stands before them and each one's name."""
    name = F.regexp_replace("p_name", " ", "_")
    code = F.concat(F.lit("```go\npackage p\n\nfunc "), name, F.lit("() {\n  x := 1\n}\n\ntype T"), F.col("p_size").cast("string"), F.lit(" struct {\n}\nvar v = \""), "p_brand", F.lit("\"\n```"))
    parts = T.code_sections(T.strip_fences(code), "go")
    rows = corpus.table(spark, d, "part").select("p_partkey", F.posexplode(parts).alias("i", "content"))
    symbol = F.regexp_extract("content", r"^(?:func|type|var|const)\s+(\w+)", 1)
    return rows.select("p_partkey", "i", "content", F.when(symbol == "", "preamble").otherwise("code_section").alias("kind"), symbol.alias("symbol"))


@query(f"""WITH RECURSIVE w AS (SELECT src AS root, dst AS id FROM {RELATIONS} WHERE src LIKE 'region:%' UNION ALL SELECT w.root, r.dst FROM w JOIN {RELATIONS} r ON r.src = w.id) SELECT root, count(*) + 1 AS nodes FROM w GROUP BY root""")
def toc_node_count(spark, d):
    nodes = corpus.graph_relations(spark, d).select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    below = S.descendants(nodes, "id", "parent", [], 3).filter(F.col("ancestor").startswith("region:"))
    return below.groupBy(F.col("ancestor").alias("root")).agg((F.count("*") + 1).alias("nodes"))


@query(f"""SELECT n_name AS concept, count(DISTINCT c_custkey) AS entities, count(DISTINCT c_mktsegment) AS concepts, 0.7::DOUBLE AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def graph_info(spark, d):
    """Entities and distinct concepts around a node, at one constant score."""
    j = corpus.table(spark, d, "customer").join(corpus.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("concept")).agg(F.countDistinct("c_custkey").alias("entities"), F.countDistinct("c_mktsegment").alias("concepts"), F.lit(0.7).alias("score"))


@query(f"SELECT kb_id, document_id, left(content, 80) AS preview FROM {DOCS} QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY document_id DESC) <= 5")
def index_samples(spark, d):
    """The last five documents of every base."""
    top = S.top_k(corpus.documents(spark, d).select("kb_id", "document_id", F.left("content", F.lit(80)).alias("preview")), ["kb_id"], F.desc("document_id"), "document_id", 5)
    return top.select("kb_id", "document_id", "preview")


@query(f"SELECT tenant_id, max(document_id) AS document_id, count(*) AS chunks FROM {CHUNKS} GROUP BY tenant_id")
def scoped_lookup(spark, d):
    """The last document of each tenant with its tenant's chunks."""
    return corpus.chunks(spark, d).groupBy("tenant_id").agg(F.max("document_id").alias("document_id"), F.count("*").alias("chunks"))


@query("""WITH v AS (SELECT vec_id, kind, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM (SELECT vec_id, 'content' AS kind, embedding FROM embeddings UNION ALL SELECT vec_id, 'title', list_reverse(embedding) FROM embeddings)),
 q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE kind = 'content' AND vec_id % 20 = 0)
 SELECT query_id, vec_id, round(max(list_cosine_similarity(v, q)), 6) AS score FROM v JOIN q ON vec_id <> query_id GROUP BY query_id, vec_id HAVING max(list_cosine_similarity(v, q)) >= 0.3""")
def multi_vector_search(spark, d):
    """Several vectors of one chunk count by the best of them; results below a threshold are cut."""
    e = corpus.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    kinds = e.unionByName(e.withColumn("embedding", F.reverse("embedding")))
    return S.against_all(kinds, q, least=0.3, several=True).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT document_id, n > 5000 OR tables > 5 AS summarize, CASE WHEN n > 50000 THEN 'section' WHEN n > 20000 THEN 'partial' ELSE 'full' END AS kind FROM (SELECT document_id, strlen(content) AS n, length(content) - length(replace(content, '|', '')) AS tables FROM {DOCS})")
def summary_triggers(spark, d):
    n = F.octet_length("content")
    return corpus.documents(spark, d).select(
        "document_id", ((n > 5000) | (F.regexp_count("content", F.lit(r"\|")) > 5)).alias("summarize"), F.when(n > 50000, "section").when(n > 20000, "partial").otherwise("full").alias("kind")
    )


@query("SELECT l_returnflag AS cell, count(*) AS n_rows, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def table_column_index(spark, d):
    """A table's column as an inverted index, with sums and means of its numeric columns."""
    rows = corpus.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cell"))
    return rows.agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query(f"SELECT document_id, content || chr(10) || 'type: ' || doc_type || chr(10) || 'tags: ' || tenant_id || ', ' || kb_id AS content FROM (SELECT *, {_TYPE} AS doc_type FROM {DOCS}) WHERE doc_type = 'brief' AND document_id % 100 < 90")
def brief_enriched(spark, d):
    """Briefs with type and tags behind them, while they are younger than ninety days."""
    kind = T.document_type(F.col("content"), [("process", "step|process|procedure"), ("experience", "experience|lesson")], "general")
    docs = corpus.documents(spark, d).withColumn("doc_type", kind).filter((F.col("doc_type") == "brief") & (F.col("document_id") % 100 < 90))
    return docs.select("document_id", F.concat("content", F.lit("\ntype: "), "doc_type", F.lit("\ntags: "), "tenant_id", F.lit(", "), "kb_id").alias("content"))


@query(_HITS + """, inside AS (SELECT DISTINCT query_id, id FROM hits WHERE channel = 'title') SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM hits SEMI JOIN inside USING (query_id, id) GROUP BY query_id, id""")
def fusion_inside_sections(spark, d):
    """Only documents that the titles found, fused with their own channel among the others."""
    hits = _channels(spark, d)
    inside = hits.filter("channel = 'title'").select("query_id", "id")
    return K.rrf(hits.join(inside, ["query_id", "id"], "left_semi")).select("query_id", "id", F.round("rrf_score", 9).alias("score"))


@query(_HITS + f""", top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id) AS r FROM hits GROUP BY query_id, id)
 SELECT query_id, string_agg(r || '. ' || title || chr(10) || left(content, 1500) || chr(10) || '[' || tenant_id || ']', chr(10) || '---' || chr(10) ORDER BY r) AS context FROM top JOIN {DOCS} ON document_id = id WHERE r <= 3 GROUP BY query_id""")
def context_with_metadata(spark, d):
    """The best three documents of all channels with 1500 characters each, and what is known of them."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "id")
    top = K.rrf(_channels(spark, d)).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    docs = corpus.documents(spark, d).select(F.col("document_id").alias("id"), "title", "content", "tenant_id")
    part = F.concat(F.col("r").cast("string"), F.lit(". "), "title", F.lit("\n"), F.left("content", F.lit(1500)), F.lit("\n["), "tenant_id", F.lit("]"))
    rows = docs.join(top, "id").select("query_id", "r", part.alias("part"))
    return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "part")))["part"], "\n---\n").alias("context"))


@query("""WITH c AS (SELECT item_id, i, unicode(text[i]) AS r FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)),
 b AS (SELECT item_id, (r * i) % 16 AS bucket, count(*) * 1.0 AS n FROM c GROUP BY ALL)
 SELECT item_id, CAST(bucket AS BIGINT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM b""")
def hashed_embedding(spark, d):
    """A vector without a model: code points by place into buckets, at length one."""
    c = corpus.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("i", "ch"))
    n = c.groupBy("item_id", ((S.code_point(F.col("ch")) * (F.col("i") + 1)) % 16).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    norm = n.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "item_id").select("item_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("n") / F.col("norm"), 6).alias("value"))


@query(f"""SELECT document_id, chunk_index, round(0.3::DOUBLE * whole + 0.7::DOUBLE * part, 6) AS score FROM (SELECT document_id, max(CASE WHEN contains(lower(content), 'the') THEN 1.0 ELSE 0.0 END) AS whole FROM {DOCS} GROUP BY document_id) JOIN
 (SELECT document_id, chunk_index, CASE WHEN starts_with(lower(content), 'the') THEN 1.0 ELSE 0.0 END AS part FROM {CHUNKS}) USING (document_id)""")
def summary_chunk_blend(spark, d):
    whole = corpus.documents(spark, d).select("document_id", F.when(F.contains(F.lower("content"), F.lit("the")), 1.0).otherwise(0.0).alias("whole"))
    part = corpus.chunks(spark, d).select("document_id", "chunk_index", F.when(F.startswith(F.lower("content"), F.lit("the")), 1.0).otherwise(0.0).alias("part"))
    return part.join(whole, "document_id").select("document_id", "chunk_index", F.round(0.3 * F.col("whole") + 0.7 * F.col("part"), 6).alias("score"))


@query("""SELECT event_id, round((0.5::DOUBLE * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + 0.3::DOUBLE * CASE WHEN value > 100 THEN 1 ELSE 0 END + 0.2::DOUBLE * least(value / 500, 1)) * (1 + CAST(json_extract(props, '$.k') AS BIGINT) / 1000.0::DOUBLE), 9) AS score FROM events""")
def experience_blend(spark, d):
    """Error match, keyword and semantic shares, raised by how well a card has worked."""
    k = F.from_json("props", "k bigint")["k"]
    s = 0.5 * F.when(F.col("event_type") == "error", 1).otherwise(0) + 0.3 * F.when(F.col("value") > 100, 1).otherwise(0) + 0.2 * F.least(F.col("value") / 500, F.lit(1.0))
    return corpus.table(spark, d, "events").select("event_id", F.round(s * (1 + k / 1000.0), 9).alias("score"))


@query("SELECT event_id, [user_id, event_id] AS ids, coalesce(json_extract_string(props, '$.name'), 'none') AS name, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events")
def json_defaults(spark, d):
    """Numbers of a JSON array as integers, and paths with defaults."""
    array = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(".0, "), F.col("event_id").cast("string"), F.lit("]"))
    ids = F.transform(F.from_json(array, "array<double>"), lambda x: x.cast("bigint"))
    path = F.parse_json("props")
    return corpus.table(spark, d, "events").select(
        "event_id", ids.alias("ids"), F.coalesce(F.try_variant_get(path, "$.name", "string"), F.lit("none")).alias("name"), F.coalesce(F.try_variant_get(path, "$.k", "bigint"), F.lit(0)).alias("k")
    )


@query(r"""WITH t AS (SELECT document_id, chunk_index, i - 1 AS position, ts[i] AS token FROM (SELECT document_id, chunk_index, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS ts, unnest(range(1, len(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) + 1)) AS i FROM """ + CHUNKS + """))
 SELECT document_id, chunk_index, CAST(position AS INTEGER) AS position, token, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' ELSE 'word' END AS type FROM t""")
def analyzed_tokens(spark, d):
    """The analyzer's tokens with position and type."""
    t = corpus.chunks(spark, d).select("document_id", "chunk_index", F.posexplode(S.tokens(F.col("content"))).alias("position", "token"))
    return t.withColumn("type", F.when(F.col("token").rlike("^[0-9]+$"), "number").otherwise("word"))
