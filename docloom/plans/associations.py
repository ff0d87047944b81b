"""Registered queries: query expansion from the corpus, segments of similar sentences, indexes of tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import corpus
from docloom.functions.text import STOP_WORDS
from docloom.operators import association as A
from docloom.operators.retrieval import tokens
from docloom.plans.analytics import CHUNKS, DOCS, TOK
from docloom.plans.enrichment import STOPS
from docloom.plans.retrieval import _questions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(rf"""WITH q AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark WHERE item_id % 20 = 0) WHERE length(term) >= 4),
 t AS (SELECT {TOK} AS ts FROM {CHUNKS}), n AS (SELECT w, count(*) AS c FROM (SELECT unnest(ts) AS w FROM t) GROUP BY w),
 p AS (SELECT ts, i, ts[i] AS term FROM (SELECT ts, unnest(range(1, len(ts) + 1)) AS i FROM t) WHERE ts[i] IN (SELECT term FROM q)),
 o AS (SELECT term, unnest(list_concat(ts[greatest(i - 5, 1) : i - 1], ts[i + 1 : i + 5])) AS other FROM p),
 s AS (SELECT term, other, count(*) AS n FROM o WHERE length(other) >= 4 AND other <> term AND other NOT IN ({STOPS}) GROUP BY ALL HAVING count(*) >= 5)
 SELECT term, other, n, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, other) AS rank FROM (SELECT term, other, n, round(n * n / (a.c * b.c)::DOUBLE, 9) AS score FROM s JOIN n a ON a.w = term JOIN n b ON b.w = other) QUALIFY rank <= 5""")
def corpus_expansions(spark, d):
    """The five words that stand most by a question's words, beyond what their counts explain."""
    terms = _questions(spark, d).select(F.explode(tokens(F.col("text"))).alias("term")).filter("length(term) >= 4")
    return A.expansions(corpus.chunks(spark, d), "content", terms, stop_words=tuple(STOP_WORDS))


_NEAR = f"""s AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS sentence, trim(x, ' ') AS s FROM (SELECT document_id, regexp_extract_all(content, '[^。！？.!?]+') AS xs FROM {DOCS}), UNNEST(xs) WITH ORDINALITY t(x, i) WHERE trim(x, ' ') <> ''),
 h AS (SELECT document_id, sentence, hex(encode(s)) AS h FROM s),
 c AS (SELECT document_id, sentence, ('0x' || substr(h, i, 4))::INTEGER % {A.DIMENSIONS} AS bucket, count(*) AS n FROM (SELECT *, unnest(range(1, length(h) - 2, 2)) AS i FROM h) GROUP BY ALL),
 nn AS (SELECT document_id, sentence, sum(n * n) AS norm FROM c GROUP BY ALL),
 dd AS (SELECT a.document_id, a.sentence, sum(a.n * b.n) AS dot FROM c a JOIN c b ON b.document_id = a.document_id AND b.sentence = a.sentence - 1 AND b.bucket = a.bucket GROUP BY ALL),
 near AS (SELECT s.document_id, s.sentence, CASE WHEN s.sentence > 0 THEN round(coalesce(dot / sqrt((a.norm * b.norm)::DOUBLE), 0.0), 9) END AS near FROM s LEFT JOIN nn a ON a.document_id = s.document_id AND a.sentence = s.sentence
 LEFT JOIN nn b ON b.document_id = s.document_id AND b.sentence = s.sentence - 1 LEFT JOIN dd ON dd.document_id = s.document_id AND dd.sentence = s.sentence)"""


@query(f"""WITH {_NEAR}, v AS (SELECT *, max(near) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l, max(near) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r,
 coalesce(lag(near) OVER w, 2) AS p, coalesce(lead(near) OVER w, 2) AS f FROM near WINDOW w AS (PARTITION BY document_id ORDER BY sentence))
 SELECT document_id, sentence, near, CAST(sum(CASE WHEN near IS NOT NULL AND round(l + r - 2 * near, 9) >= 0.2 AND near < p AND near <= f THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY sentence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM v""")
def sentence_segments(spark, d):
    """Sentences of every document, cut at the valleys of their similarity."""
    return A.similarity_segments(corpus.documents(spark, d), "document_id", "content")


# Rows of lineitem as tables of three sizes: of an order, of a part, of a quantity.
_LINES = """(SELECT CASE l_orderkey % 3 WHEN 0 THEN 'order ' || l_orderkey WHEN 1 THEN 'part ' || l_partkey ELSE 'quantity ' || l_quantity::BIGINT END AS tab, l_orderkey * 10 + l_linenumber AS line, l_returnflag, l_linestatus, l_quantity::BIGINT::VARCHAR AS quantity FROM lineitem)"""
_CELLS = f"""(SELECT tab, line, "column", value FROM {_LINES} UNPIVOT (value FOR "column" IN (l_returnflag, l_linestatus, quantity)) WHERE trim(value, ' ') <> '')"""
_COLUMNS = ["l_returnflag", "l_linestatus", "quantity"]


def _lines(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    tab = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("order "), "l_orderkey")).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("part "), "l_partkey")).otherwise(F.concat(F.lit("quantity "), q))
    return corpus.table(spark, d, "lineitem").select(tab.alias("tab"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_returnflag", "l_linestatus", q.alias("quantity"))


_SIZES = f"(SELECT tab, count(*) AS n, CASE WHEN count(*) <= 10 THEN 'small' WHEN count(*) <= 100 THEN 'medium' ELSE 'large' END AS tier FROM {_LINES} GROUP BY tab)"


@query(f"SELECT tab, n, tier FROM {_SIZES}")
def table_tiers(spark, d):
    return A.table_tiers(_lines(spark, d), "tab")


@query(f"""SELECT tab, "column", value, count(*) AS rows, min(line) AS first FROM {_CELLS} JOIN {_SIZES} USING (tab) WHERE tier <> 'small' GROUP BY ALL""")
def table_column_index(spark, d):
    """The values of each column of medium and large tables, with their rows."""
    lines = _lines(spark, d)
    some = A.table_tiers(lines, "tab").filter("tier <> 'small'").select("tab")
    return A.column_index(A.cells(lines.join(some, "tab", "left_semi"), "tab", "line", _COLUMNS), "tab", "line")


@query(f"""WITH c AS (SELECT tab, line, "column" || '=' || value AS cell FROM {_CELLS} JOIN {_SIZES} USING (tab) WHERE tier = 'large')
 SELECT x.tab, x.cell AS a, y.cell AS b, count(DISTINCT x.line) AS rows FROM c x JOIN c y ON x.tab = y.tab AND x.line = y.line AND x.cell < y.cell GROUP BY ALL""")
def table_cell_links(spark, d):
    """Cells of large tables that share rows, and how many."""
    lines = _lines(spark, d)
    large = A.table_tiers(lines, "tab").filter("tier = 'large'").select("tab")
    return A.cell_links(A.cells(lines.join(large, "tab", "left_semi"), "tab", "line", _COLUMNS), "tab", "line")
