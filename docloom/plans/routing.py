"""Registered queries: questions routed by intent, and a text channel with weighted keywords.

The tables' questions have no words of asking, so each is asked in every form below."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions import text as T
from docloom.operators import intents as I
from docloom.operators import retrieval as S
from docloom.plans.analytics import CHUNKS, DOCS
from docloom.plans.enrichment import STOPS
from docloom.plans.retrieval import _bm25, _questions
from docloom.session import settle

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Words of asking, which stand before a question.
_ASKED = [
    "Where is: ", "Where is it, and what is said there: ", "Jump to this and summarize it: ", "Give the outline, in short: ", "What is meant by: ",
    "Go to: ", "Which section, and a summary: ", "",
]
_FORMS = ", ".join(f"({i}, '{a}')" for i, a in enumerate(_ASKED))
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_KEYWORDS = f"list_distinct(list_filter({_WORDS.format('text')}, lambda w: length(w) > 3 AND w NOT IN ({STOPS}) AND w NOT IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in I.ASKING)})))"
_HAS = ", ".join(f"regexp_matches(lower(text), '{p}') AS {name}" for name, p in I.INTENTS.items())
_ROUTED = f"""asked AS (SELECT item_id AS item, item_id * {len(_ASKED)} + form AS query_id, 'src' || (item_id // 20 + form) % 20 AS kb_id, said || text AS text FROM benchmark, (VALUES {_FORMS}) f(form, said) WHERE item_id % 20 = 0),
 has AS (SELECT *, {_HAS} FROM asked),
 routed AS (SELECT item, query_id, kb_id, text, CASE WHEN jump THEN CASE WHEN summarization THEN 'jump_and_summarize' ELSE 'search' END WHEN outline THEN CASE WHEN summarization THEN 'outline' ELSE 'search' END
  WHEN navigation AND content_search THEN 'navigate_and_search' WHEN navigation AND NOT summarization THEN 'navigate' ELSE 'search' END AS strategy FROM has)"""


def _asked(spark, d):
    """Every twentieth benchmark item (item), asked in every form; the base asked goes by the item's place and the form."""
    forms = F.posexplode(F.array(*[F.lit(a) for a in _ASKED])).alias("form", "said")
    rows = _questions(spark, d).select(F.col("query_id").alias("item"), "text", forms)
    kb = F.concat(F.lit("src"), ((F.floor(F.col("item") / 20) + F.col("form")) % 20).cast("string"))
    rows = rows.select("item", (F.col("item") * len(_ASKED) + F.col("form")).alias("query_id"), kb.alias("kb_id"), F.concat("said", "text").alias("text"))
    return rows.withColumn("strategy", I.strategy(I.intents(F.col("text"))))


@query(f"WITH {_ROUTED} SELECT query_id, strategy, len({_KEYWORDS}) AS n_keywords FROM routed")
def question_strategies(spark, d):
    """The strategy of each question by its intents."""
    return _asked(spark, d).select("query_id", "strategy", F.size(I.keywords(F.col("text"), T.STOP_WORDS)).cast("bigint").alias("n_keywords"))


@query(_bm25(10).replace("document_id AS id", "document_id || '_' || chunk_index AS id").replace(DOCS, CHUNKS) + f""", {_ROUTED},
 c AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY chunk_index) AS section FROM (SELECT document_id, kb_id, chunk_index, content, document_id || '_' || chunk_index AS id, CASE WHEN document_id % 3 <> 0 AND chunk_index % 4 = document_id % 3 THEN 1 ELSE 0 END AS opens FROM {CHUNKS})),
 found AS (SELECT query_id, strategy, document_id, section, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, document_id, section) AS rank
  FROM (SELECT query_id, strategy, unnest({_KEYWORDS}) AS w FROM routed WHERE strategy IN ('navigate', 'navigate_and_search', 'jump_and_summarize')) JOIN (SELECT document_id, section, unnest(list_distinct({_WORDS.format('content')})) AS w FROM c WHERE opens = 1) USING (w)
  GROUP BY query_id, strategy, document_id, section QUALIFY rank <= 10),
 scored AS (SELECT r.query_id, document_id, section, chunk_index, score FROM s JOIN c USING (id) JOIN routed r ON r.item = s.query_id),
 within AS (SELECT query_id, strategy, document_id, section, chunk_index, score FROM found JOIN scored USING (query_id, document_id, section) WHERE strategy = 'navigate_and_search'),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id, chunk_index) AS rank FROM
  (SELECT * FROM within UNION ALL SELECT query_id, strategy, document_id, section, chunk_index, score FROM routed JOIN scored USING (query_id) WHERE strategy IN ('search', 'navigate_and_search') AND query_id NOT IN (SELECT query_id FROM within)))
 SELECT query_id, strategy, document_id, section, chunk_index, rank, round(score, 6) AS score FROM best WHERE rank <= 10
 UNION ALL SELECT query_id, strategy, document_id, section, NULL, rank, 1.0 FROM found WHERE strategy = 'navigate'
 UNION ALL SELECT query_id, strategy, document_id, section, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY chunk_index), 1.0 FROM found JOIN c USING (document_id, section) WHERE strategy = 'jump_and_summarize' AND rank = 1
 UNION ALL SELECT query_id, strategy, c.document_id, section, NULL, row_number() OVER (PARTITION BY query_id ORDER BY section), 1.0 FROM routed JOIN (SELECT kb_id, min(document_id) AS document_id FROM c WHERE opens = 1 GROUP BY kb_id) f USING (kb_id) JOIN c ON c.document_id = f.document_id AND opens = 1 WHERE strategy = 'outline'""")
def routed_answers(spark, d):
    """Each question answered by its strategy: search, sections, search inside sections, a section's chunks, or an outline.
    In two documents of three every fourth line is a heading."""
    n = F.col("document_id") % 3
    chunks = I.numbered_sections(corpus.chunks(spark, d), (n != 0) & (F.col("chunk_index") % 4 == n))
    units = corpus.chunks(spark, d).select(F.struct("document_id", "chunk_index").alias("unit"), "content")
    asked = _asked(spark, d).withColumn("keywords", I.keywords(F.col("text"), T.STOP_WORDS))
    scores = settle(S.bm25_scores(units, _questions(spark, d), "unit", "content").withColumnRenamed("query_id", "item"))  # read by several strategies
    scores = scores.join(asked.select("item", "query_id"), "item").select("query_id", "id.*", "score")
    return I.answers(asked, chunks, scores).withColumn("score", F.round("score", 6))


@query(_bm25(10).split(",\nbm AS")[0] + f""", kw AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM p JOIN df USING (term) JOIN (SELECT item_id AS query_id, unnest({_KEYWORDS}) AS term FROM benchmark WHERE item_id % 20 = 0) USING (term) CROSS JOIN stats GROUP BY query_id, id),
 added AS (SELECT query_id, id, s.score AS score, coalesce(kw.score, 0) AS keyword_score FROM s LEFT JOIN kw USING (query_id, id))
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 1.5 * keyword_score, 9) DESC, id) AS rank, round(score + 1.5 * keyword_score, 6) AS score FROM added QUALIFY rank <= 10""")
def keyword_boosted_bm25(spark, d):
    """A question's text at weight 1 and its keywords at weight 1.5, each a clause of its own; the clauses add up."""
    asked = _questions(spark, d)
    clauses = {"text": (asked, 1.0), "keywords": (asked.select("query_id", F.array_join(I.keywords(F.col("text"), T.STOP_WORDS), " ").alias("text")), 1.5)}
    docs = corpus.documents(spark, d).select("document_id", "content")
    return S.top_k(S.weighted_clauses(docs, clauses, "document_id", "content"), ["query_id"], F.desc(F.round("score", 9)), "id", 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))
