"""Registered queries: section texts, code blocks and byte prefixes, and the line and language rules on texts of every kind.

Many inputs are made from the tables by a rule that the query states, so that each branch has rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions import sections as X
from docloom.functions import text as T
from docloom.indexes import inverted
from docloom.operators import ranking as K
from docloom.operators import relational as R
from docloom.operators.retrieval import tokens
from docloom.plans.analytics import CHUNKS, DOCS
from docloom.plans.enrichment import KIND, STOPS, _kind
from docloom.plans.retrieval import _bm25, _questions
from docloom.plans.search_indexes import built

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _prefix(text: str, size: int) -> str:
    """SQL for the longest prefix of whole characters: a character has four bytes at most."""
    cuts = ", ".join(f"try(decode(encode({text})[1:{size - j}]))" for j in range(4))
    return f"CASE WHEN strlen({text}) <= {size} THEN {text} ELSE coalesce({cuts}) END"


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _packed(source: str, keys: str, size: int, text: str = "content") -> str:
    """SQL CTEs that pack the paragraphs of ``source`` (keys, text): packs(keys, pack, content)."""
    same = " AND ".join(f"p.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    other = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""parts AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS i, part FROM
 (SELECT {keys}, i, {_STRIP.format("ps[i]")} AS part FROM (SELECT {keys}, string_split({text}, chr(10) || chr(10)) AS ps, unnest(range(1, len(string_split({text}, chr(10) || chr(10))) + 1)) AS i FROM {source})) WHERE part <> ''),
walk AS (SELECT {keys}, i, part, 0 AS pack, strlen(part) AS held FROM parts WHERE i = 1 UNION ALL
 SELECT {other}, p.i, p.part, CASE WHEN w.held + strlen(p.part) > {size} THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.held + strlen(p.part) > {size} THEN strlen(p.part) ELSE w.held + 2 + strlen(p.part) END
 FROM walk w JOIN parts p ON {same} AND p.i = w.i + 1),
packs AS (SELECT {keys}, pack, string_agg(part, chr(10) || chr(10) ORDER BY i) AS content FROM walk GROUP BY {keys}, pack)"""


# Documents as Markdown: lines are paragraphs; in two documents of three every fourth line is a heading, the first of
# them on the second or third line.
_MD = f"""md AS (SELECT document_id, array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN document_id % 3 <> 0 AND (i - 1) % 4 = document_id % 3 AND trim(x, ' ') <> '' THEN '## ' || x ELSE x END), chr(10) || chr(10)) AS content FROM {DOCS})"""


def _markdown(spark, d):
    n = F.col("document_id") % 3
    line = lambda x, i: F.when((n != 0) & (i % 4 == n) & (F.trim(x) != ""), F.concat(F.lit("## "), x)).otherwise(x)
    return corpus.documents(spark, d).select("document_id", F.array_join(F.transform(F.split("content", "\n", -1), line), "\n\n").alias("content"))


@query(f"""WITH RECURSIVE {_MD},
lines AS (SELECT document_id, i, ls[i] AS line, ls FROM (SELECT document_id, string_split(content, chr(10)) AS ls, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM md WHERE strlen(content) > 8000)),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,3}}\\s+.+') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS sec FROM lines),
secs AS (SELECT document_id, sec, string_agg(line, chr(10) ORDER BY i) AS body, max(max(sec)) OVER (PARTITION BY document_id) AS n FROM numbered GROUP BY document_id, sec),
cut AS (SELECT document_id, sec, CASE WHEN n = 0 THEN body ELSE {_STRIP.format("body")} END AS content, n, strlen(body) + 1 AS raw FROM secs),
large AS (SELECT document_id, sec, content FROM cut WHERE n = 0 OR (sec > 0 AND strlen(content) > 8000)), {_packed("large", "document_id, sec", 3000)},
every AS (SELECT document_id, sec, 0 AS pack, content FROM cut WHERE (sec = 0 AND n > 0 AND raw > 100 AND strlen(content) > 50) OR (sec > 0 AND strlen(content) BETWEEN 50 AND 8000) UNION ALL SELECT document_id, sec, pack, content FROM packs)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY sec, pack) - 1 AS section, content FROM every UNION ALL SELECT document_id, 0, content FROM md WHERE strlen(content) <= 8000""")
def markdown_section_texts(spark, d):
    """Texts for the text index by heading: sections, large ones packed, tiny ones dropped, the text before the first kept."""
    return _markdown(spark, d).select("document_id", F.posexplode(X.section_texts(F.col("content"))).alias("section", "content"))


@query(f"WITH RECURSIVE {_MD}, {_packed('md', 'document_id', 1000)} SELECT document_id, pack, content FROM packs")
def paragraph_packs(spark, d):
    """Paragraphs of the Markdown documents, packed to 1000 bytes."""
    return _markdown(spark, d).select("document_id", F.posexplode(X.paragraph_packs(F.col("content"), 1000)).alias("pack", "content"))


# Code blocks made from the parts, of seven kinds by key; 60 bytes are the chunk size.
_CODE = [
    ("go", "package p\n\nfunc A() {\n  x := \"@\"\n}\n\ntype T struct {\n}\nvar v = 1"),
    ("Python", "import os\n\nclass A:\n    name = '@'\n\ndef f():\n    return '@'\n\nasync def g():\n    pass"),
    ("ts", "function a() {}\nexport const b = '@';\n\nconst c = 2;\nlet d = '@';"),
    ("go", "func only() {\n\n  x := \"@\"\n\n\n  y := \"@\"\n}"),
    ("", "first @\n\n\nsecond @ and more words to fill it up\n\nthird"),
    ("json", "{\"size\": 12, \"name\": \"@\", \"tags\": [1, {\"deep\": \"@ @ @ @ @ @ @ @ @ @ @ @ @\"}]}"),
    ("", " [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, \"@\", {\"a\": null}]"),
    ("c", "int x; // @"),
    ("", "{not json @\n\nbut two sections of which this is the second one"),
]


def _block(i: int) -> str:
    return "'" + ("```" + _CODE[i][0] + "\n" + _CODE[i][1] + "\n```").replace("'", "''").replace("\n", "' || chr(10) || '").replace("@", "' || p_name || '") + "'"


def _fenced(kind: str, text: str, tag: str = "tag") -> str:
    return f"'{kind}' AS chunk_type, '```' || {tag} || chr(10) || {text} || chr(10) || '```' AS content"


_CASES = " ".join(f"WHEN {i} THEN {_block(i)}" for i in range(len(_CODE)))
_TAGS = " ".join(f"WHEN {i} THEN '{lang}'" for i, (lang, _) in enumerate(_CODE))


@query(f"""WITH RECURSIVE b AS (SELECT p_partkey, p_partkey % {len(_CODE)} AS k, CASE p_partkey % {len(_CODE)} {_CASES} END AS block, CASE p_partkey % {len(_CODE)} {_TAGS} END AS tag FROM part),
code AS (SELECT *, array_to_string(string_split(block, chr(10))[2:-2], chr(10)) AS code FROM b WHERE strlen(block) > 60),
lines AS (SELECT p_partkey, tag, i, ls[i] AS line, CASE WHEN regexp_matches(ls[i], CASE k WHEN 0 THEN '^(func |type |var |const )' WHEN 1 THEN '^(class |def |async def )' ELSE '^(function |class |const |export |async function )' END) THEN 1 ELSE 0 END AS opens
 FROM (SELECT *, string_split(code, chr(10)) AS ls, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS i FROM code WHERE k IN (0, 1, 2))),
decl AS (SELECT p_partkey, tag, sec, {_STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS content FROM (SELECT *, sum(opens) OVER (PARTITION BY p_partkey ORDER BY i) AS sec FROM lines) GROUP BY ALL),
loose AS (SELECT p_partkey, tag, regexp_replace(code, '\\n\\n+', chr(10) || chr(10), 'g') AS content FROM code WHERE k IN (3, 4, 8)), {_packed("loose", "p_partkey, tag", 60)},
keys AS (SELECT p_partkey, key, '{{"' || key || '": ' || (json_extract(code, '$.' || key))::VARCHAR || '}}' AS body FROM (SELECT p_partkey, code, unnest(['name', 'size', 'tags']) AS key FROM code WHERE k = 5))
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY sec) - 1 AS i, CASE sec WHEN 0 THEN 'code_preamble' ELSE 'code_function' END AS chunk_type, '```' || tag || chr(10) || content || chr(10) || '```' AS content FROM decl WHERE content <> ''
UNION ALL SELECT p_partkey, pack, {_fenced('code_section', 'content')} FROM packs
UNION ALL SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY key) - 1, CASE WHEN strlen(body) + 12 <= 120 THEN 'json_key' ELSE 'json_key_large' END, '```json' || chr(10) || body || chr(10) || '```' FROM keys
UNION ALL SELECT p_partkey, j, 'json_array_batch', '```json' || chr(10) || CASE j WHEN 0 THEN '[1,2,3,4,5,6,7,8,9,10]' ELSE '["' || (json_extract_string(code, '$[10]')) || '",{{"a":null}}]' END || chr(10) || '```' FROM code, range(2) r(j) WHERE k = 6
UNION ALL SELECT p_partkey, 0, 'code', block FROM b WHERE strlen(block) <= 60 OR k = 7""")
def code_block_parts(spark, d):
    """Code in several languages cut by its structure, from blocks made of the parts' names."""
    k = F.col("p_partkey") % len(_CODE)
    block, tag = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (lang, code) in enumerate(_CODE):
        block = F.when(k == i, F.replace(F.lit(f"```{lang}\n{code}\n```"), F.lit("@"), F.col("p_name"))).otherwise(block)
        tag = F.when(k == i, F.lit(lang)).otherwise(tag)
    parts = corpus.table(spark, d, "part").select("p_partkey", block.alias("block"), tag.alias("tag"))
    rows = parts.select("p_partkey", F.posexplode(X.code_blocks(F.col("block"), F.col("tag"), 60)).alias("i", "part"))
    return rows.select("p_partkey", F.col("i").cast("bigint").alias("i"), "part.chunk_type", "part.content")


@query(f"SELECT document_id, CASE WHEN strlen(content) <= 200 THEN content ELSE ({_prefix('content', 200)}) || '...' END AS preview, {_prefix('title', 31)} AS short_title FROM {DOCS}")
def byte_previews(spark, d):
    """The first 200 bytes, whole characters only, with dots where something is cut off."""
    c = F.col("content")
    return corpus.documents(spark, d).select("document_id", X.clipped_bytes(c, 200).alias("preview"), X.byte_prefix(F.col("title"), 31).alias("short_title"))


@query(f"SELECT document_id, chunk_index FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY document_id, {_prefix('content', 200)} ORDER BY chunk_index) = 1")
def first_of_byte_prefix(spark, d):
    """Of chunks of a document that begin with the same 200 bytes, the first."""
    signed = corpus.chunks(spark, d).select("document_id", "chunk_index", X.byte_prefix(F.col("content"), 200).alias("sign"))
    return signed.groupBy("document_id", "sign").agg(F.min("chunk_index").alias("chunk_index")).select("document_id", "chunk_index")


@query(_bm25(5).replace("document_id AS id", "document_id || '_' || chunk_index AS id").replace(DOCS, CHUNKS) + f""", c AS (SELECT document_id || '_' || chunk_index AS id, document_id, chunk_index, CASE WHEN strlen(content) <= 300 THEN content ELSE ({_prefix('content', 300)}) || '...' END AS preview FROM {CHUNKS})
 SELECT query_id, a.document_id, a.chunk_index, rank, round(CASE WHEN quality IS NOT NULL THEN quality * 100.0 WHEN score > 0 THEN score ELSE 100.0 / (60 + rank) END, 6) AS score, p.preview AS previous, n.preview AS next
 FROM bm JOIN c a USING (id) LEFT JOIN c p ON p.document_id = a.document_id AND p.chunk_index = a.chunk_index - 1 LEFT JOIN c n ON n.document_id = a.document_id AND n.chunk_index = a.chunk_index + 1 LEFT JOIN labels l ON l.doc_id = a.document_id""")
def enriched_chunk_hits(spark, d):
    """The five best chunks of each question with the chunks before and after the one that was hit. A reranker's score, for
    which a document's label stands here, goes before the channel's, and that before the fused one."""
    chunks = corpus.chunks(spark, d).withColumn("chunk_id", F.concat_ws("_", "document_id", "chunk_index"))
    index = built(spark, d, "chunk-words", lambda path: inverted.build(chunks, path, "chunk_id", ["content"]))
    hits = index.search(_questions(spark, d), 5).withColumn("chunk", F.split("id", "_"))
    hits = hits.select("query_id", F.col("chunk")[0].cast("bigint").alias("document_id"), F.col("chunk")[1].cast("int").alias("chunk_index"), "rank", "score")
    mine = corpus.chunks(spark, d).join(hits.select("document_id").distinct(), "document_id", "left_semi")
    near = R.neighbours(mine.select("document_id", "chunk_index", X.clipped_bytes(F.col("content"), 300).alias("content")), 1000)
    given = corpus.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") * 100.0).alias("given"))
    met = hits.join(near, ["document_id", "chunk_index"]).join(given, "document_id", "left")
    score = K.final_score(F.col("given"), F.col("score"), 1.0 / (60 + F.col("rank")))
    return met.select("query_id", "document_id", "chunk_index", "rank", F.round(score, 6).alias("score"), "previous", "next")


# Chunks as lines of every kind, by their place and document.
_MIXED = f"""(SELECT document_id, chunk_index, CASE (chunk_index + document_id) % 8 WHEN 0 THEN '## ' || content WHEN 1 THEN '- - -' WHEN 2 THEN '| ' || content || ' | x |' WHEN 3 THEN '|:---|---:|' WHEN 4 THEN '  12. ' || content
 WHEN 5 THEN '* ' || content WHEN 6 THEN '#no heading' ELSE content END AS content FROM {CHUNKS})"""


def _mixed(spark, d):
    c, n = F.col("content"), (F.col("chunk_index") + F.col("document_id")) % 8
    line = F.when(n == 0, F.concat(F.lit("## "), c)).when(n == 1, "- - -").when(n == 2, F.concat(F.lit("| "), c, F.lit(" | x |"))).when(n == 3, "|:---|---:|")
    line = line.when(n == 4, F.concat(F.lit("  12. "), c)).when(n == 5, F.concat(F.lit("* "), c)).when(n == 6, "#no heading").otherwise(c)
    return corpus.chunks(spark, d).select("document_id", "chunk_index", line.alias("content"))


@query(f"SELECT document_id, kind, count(*) AS n FROM (SELECT document_id, {KIND} AS kind FROM {_MIXED}) GROUP BY document_id, kind")
def mixed_line_kinds(spark, d):
    return _mixed(spark, d).groupBy("document_id", _kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query(rf"""SELECT kind, keyword, n FROM (SELECT kind, keyword, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, keyword) AS r FROM
 (SELECT kind, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS keyword FROM (SELECT content, {KIND} AS kind FROM {_MIXED}))
 WHERE length(keyword) >= 2 AND keyword NOT IN ({STOPS}) GROUP BY kind, keyword) WHERE r <= 20""")
def mixed_keywords_by_kind(spark, d):
    return R.keywords_by(_mixed(spark, d).select(_kind(F.col("content")).alias("kind"), tokens(F.col("content")).alias("words")), "kind", T.STOP_WORDS)


@query(rf"""SELECT document_id, count(DISTINCT w) AS n_words, min(w) AS first_word FROM (SELECT document_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS w FROM {_MIXED} WHERE regexp_matches(trim(content, ' '), '^\|.*\|'))
 WHERE length(w) > 1 GROUP BY document_id""")
def mixed_table_keywords(spark, d):
    words = _mixed(spark, d).filter(T.is_table_row(F.col("content"))).select("document_id", F.explode(tokens(F.col("content"))).alias("w"))
    return words.filter("length(w) > 1").groupBy("document_id").agg(F.countDistinct("w").alias("n_words"), F.min("w").alias("first_word"))


# The conversations' texts in several scripts, by turn and conversation.
_TONGUES = ["", "你好世界，我们在说话。", "これは日本語のテスト", "12345 67890 !?", "Привет мир, как дела", "你好hello世界worlds"]
_SPOKEN = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % {len(_TONGUES) + 1} {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TONGUES))} ELSE text END AS text FROM conversations)"""


def _spoken(spark, d):
    n, out = (F.col("conv_id") + F.col("turn")) % (len(_TONGUES) + 1), F.col("text")
    for i, t in enumerate(_TONGUES):
        out = F.when(n == i, F.lit(t)).otherwise(out)
    return corpus.table(spark, d, "conversations").select("conv_id", "turn", out.alias("text"))


@query(rf"""SELECT conv_id, turn, CASE WHEN c > l THEN 'zh' WHEN l > 0 THEN 'en' ELSE 'unknown' END AS language FROM
 (SELECT conv_id, turn, length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM {_SPOKEN})""")
def mixed_query_language(spark, d):
    return _spoken(spark, d).select("conv_id", "turn", T.query_language(F.col("text")).alias("language"))


@query(rf"""SELECT conv_id, turn, language, round(CASE language WHEN 'mixed' THEN 0.6 WHEN 'zh' THEN c / t WHEN 'ja' THEN c / t WHEN 'en' THEN l / t ELSE CASE WHEN t = 0 THEN 0.0 ELSE 0.5 END END, 6) AS confidence FROM
 (SELECT *, CASE WHEN t = 0 THEN 'unknown' WHEN c / t > 0.3 AND l / t > 0.3 THEN 'mixed' WHEN c / t > 0.5 THEN CASE WHEN regexp_matches(s, '[\x{{3040}}-\x{{30ff}}]') THEN 'ja' ELSE 'zh' END WHEN l / t > 0.5 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT *, c + l + o AS t FROM
 (SELECT conv_id, turn, s, length(regexp_replace(s, '[^\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]', '', 'g'))::DOUBLE AS c, length(regexp_replace(s, '[^A-Za-z]', '', 'g'))::DOUBLE AS l, length(regexp_replace(s, '[\x00-\x7f\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]', '', 'g'))::DOUBLE AS o
 FROM (SELECT conv_id, turn, {_prefix("text", 2000)} AS s FROM {_SPOKEN}))))""")
def mixed_language_confidence(spark, d):
    """The language of the first 2000 bytes and how sure it is."""
    both = T.language_shares(X.byte_prefix(F.col("text"), 2000))
    return _spoken(spark, d).select("conv_id", "turn", both.alias("x")).select("conv_id", "turn", "x.language", F.round("x.confidence", 6).alias("confidence"))


@query(rf"""WITH s AS (SELECT kb_id, avg(CASE WHEN tenant_id = 'en' AND kb_id < 'src2' THEN 1.0 ELSE 0 END) AS en, avg(CASE WHEN tenant_id <> 'fr' AND kb_id >= 'src2' THEN 1.0 ELSE 0 END) AS zh FROM {DOCS} GROUP BY kb_id),
 q AS (SELECT conv_id, turn, 'src' || (conv_id % 20) AS kb_id, CASE WHEN length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM {_SPOKEN})
 SELECT conv_id, turn, kb_id, CASE WHEN language = 'zh' AND en >= 0.6 THEN 'en' WHEN language = 'en' AND zh >= 0.6 THEN 'zh' END AS translate_to FROM q LEFT JOIN s USING (kb_id)""")
def mixed_translation(spark, d):
    """A question goes to the other language where most documents of its base have it; some bases count as Chinese here."""
    late = F.col("kb_id") >= "src2"
    share = lambda test, name: F.avg(F.when(test, 1.0).otherwise(0.0)).alias(name)
    shares = corpus.documents(spark, d).groupBy("kb_id").agg(share((F.col("tenant_id") == "en") & ~late, "en"), share((F.col("tenant_id") != "fr") & late, "zh"))
    kb = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("kb_id")
    asked = _spoken(spark, d).select("conv_id", "turn", kb, T.query_language(F.col("text")).alias("language"))
    to = F.when((F.col("language") == "zh") & (F.col("en") >= 0.6), "en").when((F.col("language") == "en") & (F.col("zh") >= 0.6), "zh")
    return asked.join(shares, "kb_id", "left").select("conv_id", "turn", "kb_id", to.alias("translate_to"))
