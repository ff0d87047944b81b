"""Registered queries: text functions, classification, chunking and enrichment, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions import text as T
from docloom.operators import relational as R
from docloom.operators.retrieval import tokens
from docloom.plans.analytics import CHUNKS, DOCS, USAGE

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
#: The kind of a line; the first test that holds decides.
KIND = r"""CASE WHEN regexp_matches(trim(content, ' '), '^#{1,6}\s+') THEN 'heading' WHEN regexp_matches(replace(content, ' ', ''), '^(-{3,}|\*{3,}|_{3,})$') THEN 'rule'
 WHEN regexp_matches(trim(content, ' '), '^[|\-: ]+$') AND contains(content, '|') AND length(content) - length(replace(content, '-', '')) >= 3 THEN 'separator'
 WHEN regexp_matches(trim(content, ' '), '^\|.*\|') THEN 'table' WHEN regexp_matches(content, '^\s*([-*+]|\d+\.)\s+') THEN 'list' ELSE 'text' END"""


def _kind(line):
    return (
        F.when(T.is_heading(line), "heading").when(T.is_rule(line), "rule").when(T.is_table_separator(line), "separator").when(T.is_table_row(line), "table").when(T.is_list_item(line), "list").otherwise("text")
    )


@query(f"SELECT document_id, kind, count(*) AS n FROM (SELECT document_id, {KIND} AS kind FROM {CHUNKS}) GROUP BY document_id, kind")
def line_kinds(spark, d):
    lines = corpus.chunks(spark, d).select("document_id", _kind(F.col("content")).alias("kind"))
    return lines.groupBy("document_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text ELSE text || chr(10) || 'x = 1' END AS code FROM conversations")
def fences_stripped(spark, d):
    """Two turns of three stand in a fence, one of them open at its end; the fence lines go."""
    c, t = corpus.table(spark, d, "conversations"), F.col("text")
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```py\n"), t, F.lit("\nx = 1\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" ~~~\n"), t, F.lit("\nx = 1"))).otherwise(t)
    return c.select("conv_id", "turn", T.strip_fences(fenced).alias("code"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fence_parsed(spark, d):
    """A model's answer in a json fence, parsed; what is no JSON gives null."""
    answer = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\n"))
    body = F.regexp_extract(answer, r"(?s)```json\s*(.*?)\s*```", 1)
    return corpus.table(spark, d, "events").select("event_id", F.from_json(body, "k bigint")["k"].alias("k"))


@query(r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(text, '[ ,。，、!?；：]+'), lambda w: strlen(w) > 1), ['entity one', 'de']))), ' ') AS terms,
 array_to_string(list_slice(list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda w: w <> ''), 1, 5), ' ') AS keywords FROM benchmark""")
def query_terms(spark, d):
    b, names = corpus.table(spark, d, "benchmark"), F.array(F.lit("entity one"), F.lit("de"))
    return b.select("item_id", F.array_join(T.query_terms(F.col("text"), names), " ").alias("terms"), F.array_join(T.simple_keywords(F.col("text")), " ").alias("keywords"))


@query(rf"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(code, '\b[A-Z][a-zA-Z0-9]+\b|\b[a-z_][a-z0-9_]+\b'), lambda w: length(w) > 2 AND lower(w) NOT IN ({STOPS})))), ' ') AS names
 FROM (SELECT p_partkey, 'func ' || replace(p_name, ' ', '_') || '(the ' || p_type || ') return ' || p_brand AS code FROM part)""")
def code_identifiers(spark, d):
    code = F.concat(F.lit("func "), F.regexp_replace("p_name", " ", "_"), F.lit("(the "), F.col("p_type"), F.lit(") return "), F.col("p_brand"))
    return corpus.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.identifiers(code)), " ").alias("names"))


@query(rf"""SELECT document_id, count(DISTINCT w) AS n_words, min(w) AS first_word FROM (SELECT document_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS w FROM {CHUNKS} WHERE regexp_matches(trim(content, ' '), '^\|.*\|'))
 WHERE length(w) > 1 GROUP BY document_id""")
def table_keywords(spark, d):
    rows = corpus.chunks(spark, d).filter(T.is_table_row(F.col("content"))).select("document_id", F.explode(tokens(F.col("content"))).alias("w"))
    return rows.filter("length(w) > 1").groupBy("document_id").agg(F.countDistinct("w").alias("n_words"), F.min("w").alias("first_word"))


@query(rf"""SELECT kind, keyword, n FROM (SELECT kind, keyword, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, keyword) AS r FROM
 (SELECT kind, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS keyword FROM (SELECT content, {KIND} AS kind FROM {CHUNKS}))
 WHERE length(keyword) >= 2 AND keyword NOT IN ({STOPS}) GROUP BY kind, keyword) WHERE r <= 20""")
def keywords_by_kind(spark, d):
    """Keyword enrichment by the kind of chunk, without stop words."""
    return R.keywords_by(corpus.chunks(spark, d).select(_kind(F.col("content")).alias("kind"), tokens(F.col("content")).alias("words")), "kind", T.STOP_WORDS)


@query(f"SELECT document_id, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS preview FROM {DOCS}")
def clipped_previews(spark, d):
    return corpus.documents(spark, d).select("document_id", T.clipped(F.col("content"), 200).alias("preview"))


_FEATURES = r"""contains(content, '```') OR contains(content, 'func ') OR contains(content, 'class ') AS has_code, length(content) - length(replace(content, '|', '')) > 5 AS has_tables,
 contains(content, '1.') OR contains(content, '- ') OR contains(content, '* ') AS has_steps, (length(content) - length(replace(content, '##', ''))) / 2 > 1 AS has_sections"""


@query(f"SELECT document_id, strlen(content) AS n_bytes, {_FEATURES} FROM {DOCS}")
def document_features(spark, d):
    c = F.col("content")
    has = lambda *marks: F.lit(False) if not marks else F.contains(c, F.lit(marks[0])) | has(*marks[1:])
    return corpus.documents(spark, d).select(
        "document_id", F.octet_length(c).alias("n_bytes"), has("```", "func ", "class ").alias("has_code"), (F.regexp_count(c, F.lit(r"\|")) > 5).alias("has_tables"),
        has("1.", "- ", "* ").alias("has_steps"), (F.regexp_count(c, F.lit("##")) > 1).alias("has_sections"),
    )


_TYPE = r"CASE WHEN strlen(content) < 300 THEN 'brief' WHEN regexp_matches(lower(content), 'step|process|procedure') THEN 'process' WHEN regexp_matches(lower(content), 'experience|lesson') THEN 'experience' ELSE 'general' END"
_STRATEGY = [("brief", "none", False, "brief_mode"), ("process", "section", True, ""), ("experience", "semantic", True, "experience_card"), ("general", "section", True, "")]


@query(f"""SELECT document_id, doc_type, CASE doc_type WHEN 'brief' THEN 'none' WHEN 'experience' THEN 'semantic' ELSE 'section' END AS strategy, doc_type <> 'brief' AS graph,
 CASE doc_type WHEN 'brief' THEN 'brief_mode' WHEN 'experience' THEN 'experience_card' ELSE '' END AS special, n > 5000 AS summary FROM (SELECT document_id, strlen(content) AS n, {_TYPE} AS doc_type FROM {DOCS})""")
def default_strategy(spark, d):
    """The index strategy by document type, from a small table of rules."""
    c = F.col("content")
    kind = T.document_type(c, [("process", "step|process|procedure"), ("experience", "experience|lesson")], "general")
    docs = corpus.documents(spark, d).select("document_id", F.octet_length(c).alias("n"), kind.alias("doc_type"))
    rules = spark.createDataFrame(_STRATEGY, "doc_type string, strategy string, graph boolean, special string")
    return docs.join(F.broadcast(rules), "doc_type").select("document_id", "doc_type", "strategy", "graph", "special", (F.col("n") > 5000).alias("summary"))


@query(f"SELECT document_id, doc_type FROM (SELECT document_id, {_TYPE} AS doc_type FROM {DOCS}) WHERE doc_type IN ('brief', 'process', 'experience', 'data')")
def doc_type_whitelist(spark, d):
    kind = T.document_type(F.col("content"), [("process", "step|process|procedure"), ("experience", "experience|lesson")], "general")
    return R.optional_filters(corpus.documents(spark, d).select("document_id", kind.alias("doc_type")), doc_type=["brief", "process", "experience", "data"])


@query(r"""SELECT conv_id, turn, CASE WHEN c > l THEN 'zh' WHEN l > 0 THEN 'en' ELSE 'unknown' END AS language FROM
 (SELECT conv_id, turn, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM conversations)""")
def query_language(spark, d):
    return corpus.table(spark, d, "conversations").select("conv_id", "turn", T.query_language(F.col("text")).alias("language"))


@query(rf"""WITH s AS (SELECT kb_id, sum(CASE WHEN tenant_id = 'en' THEN 1 ELSE 0 END) * 1.0 / count(*) AS en, sum(CASE WHEN tenant_id = 'zh' THEN 1 ELSE 0 END) * 1.0 / count(*) AS zh FROM {DOCS} GROUP BY kb_id),
 q AS (SELECT conv_id, turn, 'src' || (conv_id % 20) AS kb_id, CASE WHEN length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM conversations)
 SELECT conv_id, turn, kb_id, CASE WHEN language = 'zh' AND en >= 0.7 THEN 'en' WHEN language = 'en' AND zh >= 0.7 THEN 'zh' END AS translate_to FROM q LEFT JOIN s USING (kb_id)""")
def translation_decision(spark, d):
    """A question goes to the language that most documents of its base have, if it is in the other one."""
    docs = corpus.documents(spark, d)
    share = lambda lang: F.avg((F.col("tenant_id") == lang).cast("int")).alias(lang)
    shares = docs.groupBy("kb_id").agg(share("en"), share("zh"))
    kb = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("kb_id")
    asked = corpus.table(spark, d, "conversations").select("conv_id", "turn", kb, T.query_language(F.col("text")).alias("language"))
    to = F.when((F.col("language") == "zh") & (F.col("en") >= 0.7), "en").when((F.col("language") == "en") & (F.col("zh") >= 0.7), "zh")
    return asked.join(shares, "kb_id", "left").select("conv_id", "turn", "kb_id", to.alias("translate_to"))


_PACK = f"""RECURSIVE parts AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) AS i, part FROM
 (SELECT document_id, i, trim(ps[i], ' ') AS part FROM (SELECT document_id, string_split(content, chr(10)) AS ps, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {DOCS})) WHERE part <> ''),
walk AS (SELECT document_id, i, part, 1 AS pack, strlen(part) AS held FROM parts WHERE i = 1 UNION ALL
 SELECT p.document_id, p.i, p.part, CASE WHEN w.held + strlen(p.part) > 3000 THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.held + strlen(p.part) > 3000 THEN strlen(p.part) ELSE w.held + 1 + strlen(p.part) END
 FROM walk w JOIN parts p ON p.document_id = w.document_id AND p.i = w.i + 1)"""


@query(f"WITH {_PACK} SELECT document_id, CAST(pack - 1 AS INTEGER) AS pack, string_agg(part, chr(10) ORDER BY i) AS content FROM walk GROUP BY document_id, pack")
def packed_lines(spark, d):
    """Greedy packing of a document's lines to 3000 bytes."""
    packs = T.packed(F.split("content", "\n", -1), 3000, "\n")
    return corpus.documents(spark, d).select("document_id", F.posexplode(packs).alias("pack", "content"))


@query(f"""WITH {_PACK} SELECT document_id, CAST(pack - 1 AS INTEGER) AS section, string_agg(part, chr(10) ORDER BY i) AS content FROM walk WHERE document_id IN (SELECT document_id FROM {DOCS} WHERE strlen(content) > 8000) GROUP BY document_id, pack
 UNION ALL SELECT document_id, 0, content FROM {DOCS} WHERE strlen(content) <= 8000""")
def section_texts(spark, d):
    """Texts for the text index: short documents whole, long ones without headings packed to 3000 bytes."""
    c = F.col("content")
    packs = F.when(F.octet_length(c) <= 8000, F.array(c)).otherwise(T.packed(F.split(c, "\n", -1), 3000, "\n"))
    return corpus.documents(spark, d).select("document_id", F.posexplode(packs).alias("section", "content"))


@query(f"SELECT document_id, strlen(content) <= 500 AS whole, CASE WHEN strlen(content) <= 500 THEN 1 ELSE CAST(ceil(length(content) / 500.0) AS BIGINT) END AS n_chunks FROM {DOCS}")
def single_chunk_rule(spark, d):
    """A document below the chunk size is one chunk."""
    whole = F.octet_length("content") <= 500
    return corpus.documents(spark, d).select("document_id", whole.alias("whole"), F.when(whole, F.lit(1).cast("bigint")).otherwise(F.ceil(F.length("content") / 500.0)).alias("n_chunks"))


@query(f"SELECT document_id, chunk_index, left(content, 100) AS preview FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) <= 3")
def chunk_samples(spark, d):
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return corpus.chunks(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("document_id", "chunk_index", F.left("content", F.lit(100)).alias("preview"))


@query(f"""WITH s AS (SELECT document_id, chunk_index, trim(x, ' ') AS s, i FROM (SELECT document_id, chunk_index, regexp_extract_all(content, '[^。！？.!?]+') AS xs FROM {CHUNKS}), UNNEST(xs) WITH ORDINALITY t(x, i) WHERE trim(x, ' ') <> ''),
 t AS (SELECT *, sum(strlen(s)) OVER (PARTITION BY document_id, chunk_index ORDER BY i DESC) AS held FROM s)
 SELECT document_id, chunk_index, string_agg(s, '. ' ORDER BY i) AS tail FROM t WHERE held <= 60 GROUP BY document_id, chunk_index""")
def overlap_tails(spark, d):
    """The last sentences of a chunk within 60 bytes, which the next chunk repeats."""
    parts = F.reverse(T.sentences(F.col("content")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("tail"))
    grow = lambda a, s: F.struct((a["n"] + F.octet_length(s)).alias("n"), F.when(a["n"] + F.octet_length(s) <= 60, F.concat(F.array(s), a["tail"])).otherwise(a["tail"]).alias("tail"))
    tail = F.aggregate(parts, start, grow)["tail"]
    return corpus.chunks(spark, d).select("document_id", "chunk_index", tail.alias("t")).filter(F.size("t") > 0).select("document_id", "chunk_index", F.array_join("t", ". ").alias("tail"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 s AS (SELECT vec_id, label, list_cosine_similarity(v, lag(v) OVER (PARTITION BY label ORDER BY vec_id)) AS near FROM v)
 SELECT vec_id, label, CAST(sum(CASE WHEN near < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM s""")
def similarity_segments(spark, d):
    """Neighbours below a similarity stand in different segments."""
    from docloom.operators.retrieval import dot, unit

    e = corpus.table(spark, d, "embeddings").select("vec_id", "label", unit(F.col("embedding")).alias("v"))
    w = Window.partitionBy("label").orderBy("vec_id")
    near = e.withColumn("near", dot(F.col("v"), F.lag("v").over(w)))
    return near.select("vec_id", "label", F.sum(F.when(F.col("near") < 0.2, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


@query("SELECT event_id, k AS json_key, CASE WHEN strlen(k) + strlen(v) + 22 <= 30 THEN 'json_key' ELSE 'json_key_large' END AS chunk_type FROM (SELECT event_id, 'props' AS k, props AS v FROM events UNION ALL SELECT event_id, 'event_type', '\"' || event_type || '\"' FROM events)")
def json_fragments(spark, d):
    """An object's fragments by key in a json fence; more than twice the chunk size is large."""
    e = corpus.table(spark, d, "events")
    pairs = F.create_map(F.lit("props"), F.col("props"), F.lit("event_type"), F.to_json(F.array("event_type")))
    rows = e.select("event_id", F.explode(pairs).alias("json_key", "v")).withColumn("v", F.when(F.col("json_key") == "event_type", F.regexp_extract("v", r"^\[(.*)\]$", 1)).otherwise(F.col("v")))
    fragment = F.concat(F.lit('```json\n{"'), "json_key", F.lit('": '), "v", F.lit("}\n```"))
    size = F.octet_length(fragment) - 17 + 22
    return rows.select("event_id", "json_key", F.when(size <= 30, "json_key").otherwise("json_key_large").alias("chunk_type"))


_CONFIG = '[{"name": "keywords", "types": ["text", "table"]}, {"name": "summary", "types": ["*"], "enabled": true}, {"name": "off", "types": ["*"], "enabled": false}]'


@query(f"""WITH k AS (SELECT {KIND} AS kind FROM {CHUNKS}) SELECT name, kind, count(*) AS jobs FROM k JOIN (VALUES ('keywords', ['text', 'table']), ('summary', ['*'])) p(name, types)
 ON list_contains(types, kind) OR list_contains(types, '*') GROUP BY name, kind""")
def enrichment_jobs(spark, d):
    """Enabled processors of a pipeline's configuration (on unless it says otherwise), by the kinds they apply to."""
    config = spark.range(1).select(F.inline(F.from_json(F.lit(_CONFIG), "array<struct<name: string, types: array<string>, enabled: boolean>>")))
    kinds = corpus.chunks(spark, d).groupBy(_kind(F.col("content")).alias("kind")).agg(F.count("*").alias("jobs"))  # six rows
    on = config.filter(F.coalesce("enabled", F.lit(True)))
    return kinds.crossJoin(F.broadcast(on)).filter(F.array_contains("types", F.col("kind")) | F.array_contains("types", F.lit("*"))).select("name", "kind", "jobs")


@query(f"""SELECT document_id, e.key, e.value FROM (SELECT document_id, unnest([{{'key': 'lang', 'value': tenant_id}}, {{'key': 'source', 'value': kb_id}}, {{'key': 'type', 'value': CASE WHEN document_id % 2 = 0 THEN 'note' ELSE 'base' END}},
 {{'key': 'semantic_lang', 'value': upper(tenant_id)}}]) AS e FROM {DOCS})""")
def metadata_merged(spark, d):
    """Base, document and prefixed semantic metadata in one map; later ones win."""
    pair = lambda k, v: F.create_map(F.lit(k), v)
    base = F.map_concat(pair("lang", F.col("tenant_id")), pair("type", F.lit("base")))
    own = F.map_concat(pair("source", F.col("kb_id")))
    note = F.when(F.col("document_id") % 2 == 0, pair("type", F.lit("note"))).otherwise(F.create_map().cast("map<string,string>"))
    semantic = F.transform_keys(pair("lang", F.upper("tenant_id")), lambda k, _: F.concat(F.lit("semantic_"), k))
    return corpus.documents(spark, d).select("document_id", F.explode(R.merged(base, own, note, semantic)).alias("key", "value"))


@query(f"""SELECT document_id, chunk_index, CASE source WHEN 0 THEN content WHEN 1 THEN left(content, 20) || '!' ELSE content || chr(10) || chr(10) || left(content, 20) || '!' END AS resolved
 FROM (SELECT document_id, chunk_index, content, chunk_index % 3 AS source FROM {CHUNKS})""")
def content_resolution(spark, d):
    """What an index takes from a chunk: the original, an enrichment, or both; a missing part is left out."""
    c = corpus.chunks(spark, d)
    head = F.concat(F.left("content", F.lit(20)), F.lit("!"))
    enriched = c.select("document_id", "chunk_index", head.alias("title")).withColumn("missing", F.lit(None).cast("string"))
    source = F.element_at(F.array(F.lit("original"), F.lit("enrichment:title"), F.lit("composite:original+title+missing")), F.col("chunk_index") % 3 + 1)
    return R.resolved(c.withColumn("source", source).join(enriched, ["document_id", "chunk_index"]), "content", ["title", "missing"]).select("document_id", "chunk_index", "resolved")


@query(f"SELECT document_id, chunk_index, kind, kind || '_' || document_id || '_' || chunk_index AS row_id FROM {CHUNKS}, (VALUES ('bm25'), ('vector')) t(kind) WHERE kind = 'bm25' OR strlen(content) > 40")
def multi_index_rows(spark, d):
    """A row for each index that a chunk goes to."""
    strategies = F.when(F.octet_length("content") > 40, F.array(F.lit("bm25"), F.lit("vector"))).otherwise(F.array(F.lit("bm25")))
    return corpus.chunks(spark, d).select("document_id", "chunk_index", F.explode(strategies).alias("kind")).withColumn("row_id", F.concat_ws("_", "kind", "document_id", "chunk_index"))


@query("SELECT vec_id, len(embedding) AS dim, list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 5)) AS head, round(list_min(embedding)::DOUBLE, 5) AS low, round(list_max(embedding)::DOUBLE, 5) AS high FROM embeddings")
def embedding_preview(spark, d):
    e = F.col("embedding").cast("array<double>")
    rounded = lambda x: F.signum(x) * F.round(F.abs(x), 5)  # noqa: E731  what rounds to zero keeps its sign, as in SQL
    return corpus.table(spark, d, "embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("dim"), F.transform(F.slice(e, 1, 8), rounded).alias("head"), rounded(F.array_min(e)).alias("low"), rounded(F.array_max(e)).alias("high")
    )


@query(r"""SELECT document_id, list_sort(list_distinct(regexp_extract_all(content, '\bE[0-9]{2,5}\b|\b[45][0-9]{2}\b|\b[A-Z][A-Za-z]*(?:Error|Exception)\b'))) AS codes FROM (SELECT doc_id AS document_id, text || ' IoError 404' AS content FROM documents)""")
def error_codes(spark, d):
    found = F.regexp_extract_all(F.concat("content", F.lit(" IoError 404")), F.lit(r"\bE[0-9]{2,5}\b|\b[45][0-9]{2}\b|\b[A-Z][A-Za-z]*(?:Error|Exception)\b"), F.lit(0))
    return corpus.documents(spark, d).select("document_id", F.array_sort(F.array_distinct(found)).alias("codes"))


@query("""SELECT src, dst, count(*) AS n FROM (SELECT c_mktsegment AS src, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY src, dst""")
def rule_relations(spark, d):
    """"A depends on B" sentences to edges, by one pattern."""
    n = corpus.table(spark, d, "nation").select("n_nationkey", "n_name")
    said = corpus.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Note: "), "c_mktsegment", F.lit(" depends on "), "n_name", F.lit(".")).alias("s"))
    pattern = r"(\w+) depends on ([\w ]+)\."
    return said.select(F.regexp_extract("s", pattern, 1).alias("src"), F.regexp_extract("s", pattern, 2).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"SELECT document_id, tenant_id AS lang, kb_id AS source, content AS body FROM {DOCS}")
def frontmatter(spark, d):
    """A header of "key: value" lines between --- marks, and the body behind it."""
    docs = corpus.documents(spark, d)
    raw = docs.select("document_id", F.concat(F.lit("---\nlang: "), "tenant_id", F.lit("\nsource: "), "kb_id", F.lit("\n---\n"), "content").alias("raw"))
    head = F.regexp_extract("raw", r"(?s)\A---\n(.*?)\n---\n", 1)
    fields = F.transform_values(F.str_to_map(head, F.lit("\n"), F.lit(": ")), lambda _, v: F.trim(v))
    return raw.select("document_id", fields["lang"].alias("lang"), fields["source"].alias("source"), F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


@query(f"SELECT document_id, doc_type || '|' || CAST(n // 1000 AS VARCHAR) AS key, count(*) OVER (PARTITION BY doc_type, n // 1000) AS sharing FROM (SELECT document_id, strlen(content) AS n, {_TYPE} AS doc_type FROM {DOCS})")
def strategy_cache_key(spark, d):
    """Documents of one type and length bucket share a cached strategy."""
    kind = T.document_type(F.col("content"), [("process", "step|process|procedure"), ("experience", "experience|lesson")], "general")
    key = F.concat_ws("|", kind, F.floor(F.octet_length("content") / 1000))
    docs = corpus.documents(spark, d).select("document_id", key.alias("key"))
    return docs.join(docs.groupBy("key").agg(F.count("*").alias("sharing")), "key")


@query(f"SELECT event_id, cost * 1.0 AS cost, round((input_tokens + output_tokens) * 0.01 / 1000, 9) AS rough, round(input_tokens * 0.15 / 1e6 + output_tokens * 0.60 / 1e6, 12) AS summary, strlen(service) // 4 AS tokens FROM {USAGE}")
def cost_estimates(spark, d):
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return corpus.usage(spark, d).select(
        "event_id", "cost", F.round((i + o) * 0.01 / 1000, 9).alias("rough"), F.round(i * 0.15 / 1e6 + o * 0.60 / 1e6, 12).alias("summary"), F.floor(F.octet_length("service") / 4).alias("tokens")
    )


@query(f"""SELECT document_id, service, model_type, calls, tokens, CAST(sum(tokens) OVER (PARTITION BY document_id ORDER BY service, model_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM
 (SELECT document_id, service, model_type, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM {USAGE} WHERE document_id IS NOT NULL GROUP BY document_id, service, model_type)""")
def usage_by_document_running(spark, d):
    u = corpus.usage(spark, d).filter(F.col("document_id").isNotNull()).groupBy("document_id", "service", "model_type")
    sums = u.agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    w = Window.partitionBy("document_id").orderBy("service", "model_type").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("running", F.sum("tokens").over(w))


@query(f"SELECT kb_id, string_agg(tenant_id || '=' || CAST(CAST(round(n * 1000000.0 / t) AS BIGINT) AS VARCHAR), ',' ORDER BY tenant_id) AS shares FROM (SELECT kb_id, tenant_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY kb_id) AS t FROM {DOCS} GROUP BY kb_id, tenant_id) WHERE tenant_id <> '' GROUP BY kb_id")
def language_distribution_map(spark, d):
    """The shares of a base's languages as one map, in millionths; an empty language only counts in the whole."""
    shares = R.share_by(corpus.documents(spark, d), "kb_id", "tenant_id")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tenant_id", F.round(F.col("share") * 1000000).cast("bigint")))))
    maps = shares.groupBy("kb_id").agg(pairs.alias("m"))
    return maps.select("kb_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("shares"))


@query(rf"SELECT document_id, kind, count(*) AS n FROM (SELECT document_id, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'number' WHEN regexp_matches(t, '^[a-z]+$') THEN 'latin' ELSE 'other' END AS kind FROM (SELECT document_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS t FROM {DOCS})) GROUP BY document_id, kind")
def token_kinds(spark, d):
    t = corpus.documents(spark, d).select("document_id", F.explode(tokens(F.col("content"))).alias("t"))
    kind = F.when(F.col("t").rlike("^[0-9]+$"), "number").when(F.col("t").rlike("^[a-z]+$"), "latin").otherwise("other")
    return t.groupBy("document_id", kind.alias("kind")).agg(F.count("*").alias("n"))
