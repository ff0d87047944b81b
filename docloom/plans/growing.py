"""Registered queries: tables changed in place, deep pages, mergeable sketches and stateful streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import corpus
from docloom.operators import paging, sketches, tables
from docloom.operators.retrieval import tokens
from docloom.plans.analytics import CHUNKS, DOCS, ENTITIES, RELATIONS, TOK
from docloom.session import new_folder
from docloom.streaming import state

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'moved' ELSE source END AS source, lang, n_chars FROM documents WHERE doc_id % 10 <> 0
 UNION ALL SELECT doc_id + 1000000000, 'new', NULL, n_chars FROM documents WHERE doc_id % 10 = 3""")
def merged_documents(spark, d):
    """Documents deleted, updated in one column and added in one pass over the buckets that this touches."""
    docs = corpus.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    t = tables.KeyedTable.create(docs, new_folder(spark, "documents"), "doc_id")
    moved = docs.filter("doc_id % 10 = 1").select("doc_id", F.lit("moved").alias("source"), F.lit(None).cast("bigint").alias("n_chars"))
    added = docs.filter("doc_id % 10 = 3").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit("new").alias("source"), "n_chars")
    t.merge(moved.unionByName(added), docs.filter("doc_id % 10 = 0").select("doc_id"), partial=True)
    return t.read()


@query(f"SELECT d.document_id, count(c.chunk_index) AS chunks FROM {DOCS} d LEFT JOIN {CHUNKS} c ON c.document_id = d.document_id AND c.document_id % 3 <> 1 WHERE d.document_id % 7 <> 0 GROUP BY d.document_id")
def cascaded_delete(spark, d):
    """Documents deleted with their chunks, and the chunks of others replaced by none."""
    docs = tables.KeyedTable.create(corpus.documents(spark, d).select("document_id"), new_folder(spark, "docs"), "document_id", 16)
    chunks = tables.KeyedTable.create(corpus.chunks(spark, d).select("document_id", "chunk_index"), new_folder(spark, "chunks"), "document_id", 16)
    ids = corpus.documents(spark, d).select("document_id")
    tables.delete_documents([chunks, docs], ids.filter("document_id % 7 = 0"))
    chunks.merge(deletes=ids.filter("document_id % 3 = 1"))
    n = chunks.read().groupBy("document_id").agg(F.count("*").alias("chunks"))
    return docs.read().join(n, "document_id", "left").na.fill(0, ["chunks"])


@query(f"""WITH gone AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 10 = 0)
 SELECT type, count(*) AS n, NULL AS least FROM {ENTITIES} WHERE id NOT IN (SELECT id FROM gone) GROUP BY type UNION ALL
 SELECT 'edges of ' || src, count(*), min(dst) FROM {RELATIONS} WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY src""")
def deleted_nodes(spark, d):
    """Nodes deleted with the edges at both ends, from edges that are kept by source and by target."""
    edges, nodes = corpus.graph_relations(spark, d), corpus.graph_entities(spark, d)
    n = tables.KeyedTable.create(nodes, new_folder(spark, "nodes"), "id", 8)
    out, into = tables.KeyedTable.create(edges, new_folder(spark, "out"), "src", 8), tables.KeyedTable.create(edges, new_folder(spark, "in"), "dst", 8)
    gone = nodes.filter("(type = 'nation' or type = 'customer')").withColumn("k", F.split("id", ":")[1].cast("bigint")).filter("k % if(type = 'nation', 4, 10) = 0")
    tables.delete_nodes(n, out, into, gone.select("id"))
    left = n.read().groupBy("type").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("least"))
    rest = into.read().groupBy(F.concat(F.lit("edges of "), "src").alias("type")).agg(F.count("*").alias("n"), F.min("dst").alias("least"))
    return left.unionByName(rest)


_ORDER = [("n_chars", True), ("doc_id", False)]


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents")
def ranked_documents(spark, d):
    """Every document's place by length, from ranges and one prefix sum."""
    return paging.ranked(corpus.table(spark, d, "documents").select("doc_id", "n_chars"), _ORDER).select("doc_id", "rank")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET (SELECT count(*) // 2 FROM documents)")
def page_in_the_middle(spark, d):
    """The twenty documents after the one in the middle, sought by its values."""
    docs = corpus.table(spark, d, "documents").select("doc_id", "n_chars")
    places = paging.ranked(docs, _ORDER)
    middle = places.filter(F.col("rank") == docs.count() // 2).first()  # one row
    return paging.page_after(docs, _ORDER, middle and middle.asDict(), 20)


@query(f"""WITH t AS (SELECT kb_id, unnest({TOK}) AS token FROM {DOCS}), n AS (SELECT kb_id, token, count(*) AS n FROM t GROUP BY ALL)
 SELECT kb_id, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n * strlen(token)) / sum(n), 6) AS mean_bytes, count(*) AS exact_distinct, TRUE AS within_three_percent,
 arg_max(token, (n, token)) AS commonest, TRUE AS count_within_bound FROM n GROUP BY kb_id""")
def merged_token_sketches(spark, d):
    """Token statistics of each base, merged from sketches by base and language, beside the exact numbers."""
    t = corpus.documents(spark, d).select("kb_id", "tenant_id", F.explode(tokens(F.col("content"))).alias("token"))
    whole = sketches.merged(sketches.sketch(t, ["kb_id", "tenant_id"]), ["kb_id"])
    counts = t.groupBy("kb_id", "token").agg(F.count("*").alias("n")).groupBy("kb_id").agg(F.count("*").alias("exact_distinct"), F.max(F.struct("n", "token")).alias("top"))
    met = whole.join(counts, "kb_id").withColumn("first", sketches.frequent_terms(1)[0])
    near = F.abs(sketches.distinct_count() - F.col("exact_distinct")) <= 0.03 * F.col("exact_distinct")
    bound = F.abs(F.col("first.count") - F.col("top.n")) <= F.col("tokens") / sketches.COUNTERS
    return met.select("kb_id", "tokens", F.round(F.col("bytes") / F.col("tokens"), 6).alias("mean_bytes"), "exact_distinct", near.alias("within_three_percent"), F.col("first.item").alias("commonest"), bound.alias("count_within_bound"))


# Streams over the events: a user stands for a document, the type for a stage. What came in the last hour still waits.
_FINAL = "(SELECT * FROM events WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) * 1000)"


def _events(spark, d):
    kinds = corpus.table(spark, d, "events").schema
    files = f"{d}/events.parque[t]"  # a pattern may stand for one file, a plain path for a folder only
    return spark.readStream.schema(kinds).parquet(files).select(F.col("user_id").alias("doc"), "event_id", F.col("event_type").alias("value"), F.col("ts").alias("at"))


def _drained(spark, name, stream):
    folder = new_folder(spark, name)
    return state.drain(stream, f"{folder}/out", f"{folder}/check", spark)


@query(f"""SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER w AS step, event_id, event_type AS stage, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000.0, 3)::DOUBLE AS latency_ms,
 round(count(DISTINCT event_type) OVER w / 5.0, 3)::DOUBLE AS progress FROM {_FINAL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_steps(spark, d):
    """Each user's events as the steps of a pipeline with five stages, from a stream."""
    steps = _drained(spark, "steps", state.step_sequence(_events(spark, d), "doc"))
    return steps.select("key", "step", "event_id", "stage", F.round("latency_ms", 3).alias("latency_ms"), F.round(F.col("stages") / 5.0, 3).alias("progress"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {_FINAL}),
 c AS (SELECT user_id, event_id, n, us + 86400000000 AS ends, FALSE AS hit, 0 AS hits FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, CASE WHEN e.us < c.ends THEN c.ends ELSE e.us + 86400000000 END, e.us < c.ends, CASE WHEN e.us < c.ends THEN c.hits + 1 ELSE 0 END FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
 SELECT CAST(user_id AS VARCHAR) AS key, event_id, hit, hits FROM c""")
def stream_cache(spark, d):
    """Which event of a user finds an entry that an earlier one made within a day, from a stream."""
    return _drained(spark, "cache", state.cache_log(_events(spark, d), "doc", 24)).select("key", "event_id", "hit", "hits")
