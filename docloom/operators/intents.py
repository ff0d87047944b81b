"""Questions routed by what they ask for: intents from patterns, a strategy, and the strategy's rows from sections and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import retrieval as S

#: A question's intents in the order in which one is taken as the primary. Patterns for the lower-cased question.
INTENTS = {
    "jump": r"\b(jump|go) to\b",
    "outline": r"\b(outline|table of contents)\b",
    "navigation": r"\bwhere\b|\bwhich (section|chapter)\b",
    "content_search": r"\b(what|how|why) (is|are|does|do)\b",
    "summarization": r"\b(summari[sz]e|summary|in short)\b",
}
#: Words of the patterns, which are no keywords.
ASKING = ["jump", "outline", "table", "contents", "where", "which", "section", "chapter", "what", "does", "summarize", "summarise", "summary", "short"]


def intents(text: Column) -> Column:
    """The intents of a question, the primary one first; a null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in INTENTS.items()]))


def strategy(found: Column) -> Column:
    """One of five strategies by the primary and the secondary intents; without a rule for them, plain search.

    A wish for a summary may be named ``summarize`` or ``summarization``."""
    first, others = F.get(found, F.lit(0)), F.slice(found, 2, 10)
    short = F.arrays_overlap(others, F.array(F.lit("summarize"), F.lit("summarization")))
    return (
        F.when((first == "navigation") & F.array_contains(others, "content_search"), "navigate_and_search")
        .when((first == "jump") & short, "jump_and_summarize")
        .when((first == "outline") & short, "outline")
        .when((first == "navigation") & (F.size(others) == 0), "navigate")
        .otherwise("search")
    )


def keywords(text: Column, stop_words: list[str]) -> Column:
    """Distinct words of more than three letters that are neither stop words nor words of asking."""
    return F.array_distinct(F.filter(S.tokens(text), lambda w: (F.length(w) > 3) & ~w.isin(stop_words + ASKING)))


def numbered_sections(chunks: DataFrame, opens: Column) -> DataFrame:
    """Adds ``section``: how many headings a document has up to this chunk. 0 stands before the first."""
    w = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("opens", opens).withColumn("section", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(w))


def sections_by_title(asked: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """query_id, document_id, section, rank: of the headings (document_id, section, content) the k with most keywords of
    the question (query_id, keywords), ties to the smaller document and section. Words are met by an equi-join."""
    words = heads.select("document_id", "section", F.explode(F.array_distinct(S.tokens(F.col("content")))).alias("word"))
    wanted = asked.select("query_id", F.explode("keywords").alias("word"))
    held = words.join(wanted, "word").groupBy("query_id", "document_id", "section").agg(F.count("*").alias("held"))
    w = Window.partitionBy("query_id").orderBy(F.desc("held"), "document_id", "section")
    return held.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "document_id", "section", "rank")


def answers(asked: DataFrame, chunks: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """query_id, strategy, document_id, section, chunk_index, rank, score: the rows that each question's strategy gives.

    asked: query_id, kb_id, strategy, keywords. chunks: document_id, kb_id, chunk_index, content, opens, section, of
    ``numbered_sections``. scores: query_id, document_id, chunk_index, score, a channel's scores, not cut.

    - search: the k best chunks of the channel.
    - navigate: the k sections whose titles hold most keywords, at score 1, without chunks.
    - navigate_and_search: the k best chunks inside those sections; where no title or no chunk fits, plain search.
    - jump_and_summarize: the chunks of the first of those sections in order, at score 1.
    - outline: the headings of the first document of the question's base that has any, in order, without chunks.
    """
    heads = chunks.filter("opens")
    titled = asked.filter(F.col("strategy").isin("navigate", "navigate_and_search", "jump_and_summarize"))
    found = sections_by_title(titled, heads, k).join(asked.select("query_id", "strategy"), "query_id")
    none, one = F.lit(None).cast("int").alias("chunk_index"), F.lit(1.0).alias("score")
    places = ["query_id", "strategy", "document_id", "section"]

    def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(*order)
        return rows.withColumn("rank", F.row_number().over(w)).select(*places, "chunk_index", "rank", "score")

    best = [F.desc(F.round("score", 9)), "document_id", "chunk_index"]
    navigate = found.filter("strategy = 'navigate'").select(*places, none, "rank", one)
    here = chunks.select("document_id", "section", "chunk_index")
    jump = ranked(found.filter("strategy = 'jump_and_summarize' and rank = 1").drop("rank").join(here, ["document_id", "section"]).withColumn("score", one), "chunk_index")
    scored = scores.join(here, ["document_id", "chunk_index"])
    within = found.filter("strategy = 'navigate_and_search'").drop("rank").join(scored, ["query_id", "document_id", "section"])
    inside = ranked(within, *best).filter(F.col("rank") <= k)
    plain = asked.filter("strategy in ('search', 'navigate_and_search')").join(within.select("query_id").distinct(), "query_id", "left_anti")
    search = ranked(plain.select("query_id", "strategy").join(scored, "query_id"), *best).filter(F.col("rank") <= k)
    first = heads.groupBy("kb_id").agg(F.min("document_id").alias("document_id"))
    outlined = asked.filter("strategy = 'outline'").select("query_id", "strategy", "kb_id").join(first, "kb_id")
    outline = ranked(outlined.join(heads.select("document_id", "section"), "document_id").select(*places, none, one), "section")
    return reduce(DataFrame.unionByName, [navigate, jump, inside, search, outline])
