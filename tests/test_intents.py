"""Intents, strategies and the rows that each strategy gives, on hand-made sections."""

from __future__ import annotations

import pytest
from docloom.operators import intents as I
from docloom.operators import retrieval as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "found", "strategy"),
    [
        ("Where is the pump", ["navigation"], "navigate"),
        ("Where is the pump and how does it work", ["navigation", "content_search"], "navigate_and_search"),
        ("JUMP TO pumps, in short", ["jump", "summarization"], "jump_and_summarize"),
        ("go to pumps", ["jump"], "search"),
        ("outline with a summary", ["outline", "summarization"], "outline"),
        ("which chapter, summarise", ["navigation", "summarization"], "search"),
        ("pumps", [], "search"),
        ("", [], "search"),
        (None, [], "search"),
    ],
)
def test_strategies(spark, text, found, strategy):
    row = spark.createDataFrame([(text,)], "text string").select(I.intents(F.col("text")).alias("i")).select("i", I.strategy(F.col("i")).alias("s")).first()
    assert (row.i, row.s) == (found, strategy)


def test_both_names_of_a_summary(spark):
    rows = spark.createDataFrame([(["jump", "summarize"],), (["jump", "summarization"],)], "i array<string>")
    assert [r.s for r in rows.select(I.strategy(F.col("i")).alias("s")).collect()] == ["jump_and_summarize"] * 2


@pytest.fixture(scope="module")
def answered(spark):
    lines = [
        (1, "a", ["intro pumps", "# pumps valves", "valves leak", "pumps fail", "# motors", "motors burn"]),
        (2, "a", ["# valves", "valves again"]),
        (3, "b", ["no heading with motors"]),
    ]
    rows = [(d, kb, i, x) for d, kb, xs in lines for i, x in enumerate(xs)]
    chunks = I.numbered_sections(spark.createDataFrame(rows, "document_id int, kb_id string, chunk_index int, content string"), F.startswith("content", F.lit("#")))
    asked = spark.createDataFrame(
        [
            (1, "a", "navigate", ["pumps", "valves"]),
            (2, "a", "navigate_and_search", ["motors"]),
            (3, "a", "navigate_and_search", ["unheard"]),
            (4, "a", "jump_and_summarize", ["pumps"]),
            (5, "a", "outline", []),
            (6, "b", "outline", []),
            (7, "a", "search", ["valves"]),
            (8, "a", "jump_and_summarize", ["unheard"]),
        ],
        "query_id int, kb_id string, strategy string, keywords array<string>",
    )
    units = chunks.select(F.struct("document_id", "chunk_index").alias("unit"), "content")
    texts = spark.createDataFrame([(2, "motors"), (3, "valves"), (7, "valves")], "query_id int, text string")
    scores = S.bm25_scores(units, texts, "unit", "content").select("query_id", "id.*", "score")
    got = {}
    for r in sorted(I.answers(asked, chunks, scores, 2).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.document_id, r.section, r.chunk_index))
    return got


def test_navigation_takes_the_titles_with_most_keywords(answered):
    assert answered[1] == [(1, 1, None), (2, 1, None)]


def test_search_stays_inside_the_sections(answered):
    assert set(answered[2]) == {(1, 2, 4), (1, 2, 5)}  # document 3 has the word, but no section


def test_without_a_section_plain_search_answers(answered):
    assert answered[3] == answered[7] and len(answered[7]) == 2


def test_a_jump_gives_the_section_in_order(answered):
    assert answered[4] == [(1, 1, 1), (1, 1, 2), (1, 1, 3)]
    assert 8 not in answered


def test_an_outline_lists_the_headings_of_the_first_document_that_has_any(answered):
    assert answered[5] == [(1, 1, None), (1, 2, None)]
    assert 6 not in answered


def test_clauses_add_up(spark):
    units = spark.createDataFrame([(1, "red pump"), (2, "blue valve"), (3, None)], "id int, text string")
    ask = lambda t: spark.createDataFrame([(1, t)], "query_id int, text string")
    one = {r.id: r.score for r in S.bm25_scores(units, ask("red"), "id", "text").collect()}
    two = {r.id: r.score for r in S.weighted_clauses(units, {"a": (ask("red"), 1.0), "b": (ask("red blue"), 1.5)}, "id", "text").collect()}
    assert two[1] == pytest.approx(2.5 * one[1]) and set(two) == {1, 2}
