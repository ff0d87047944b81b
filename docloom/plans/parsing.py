"""Registered queries: format conversion and structural chunking, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import corpus
from docloom.functions import markdown as M
from docloom.sources.html import to_markdown

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@F.pandas_udf(T.StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)


_BLOCKS = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("content", T.StringType()).add("start", T.IntegerType()).add("stop", T.IntegerType())
)


@F.pandas_udf(_BLOCKS)
def markdown_blocks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [(b.kind, b.text, b.start, b.end) for b in M.blocks(t or "")])


@F.pandas_udf(_BLOCKS)
def semantic(text: pd.Series) -> pd.Series:
    def run(t):
        parts = [x for b in M.blocks(t or "") for x in (M.expand_table(b) if b.kind == "table" else [b])]
        return [(kind, body, a, z) for body, a, z, kind in M.pack_blocks(parts, 500)]

    return text.map(run)


@F.pandas_udf(_BLOCKS)
def by_section(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [(path, body, a, z) for body, a, z, path in M.sections(M.blocks(t or ""), 500)])


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("content", T.StringType())))
def windows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: M.sliding(t or "", 500, 50))


def _pages(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", html_markdown("html").alias("content"))


@query
def html_to_markdown(spark, d):
    return _pages(spark, d)


@query
def md_blocks(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(markdown_blocks("content")).alias("i", "b")).select("page_id", "i", "b.*")


@query
def semantic_chunks(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(semantic("content")).alias("i", "b")).select("page_id", "i", "b.*")


@query
def section_chunks(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(by_section("content")).alias("i", "b")).select("page_id", "i", F.col("b.kind").alias("path"), "b.content", "b.start", "b.stop")


@query
def sliding_chunks_boundary(spark, d):
    docs = corpus.documents(spark, d)
    return docs.select("document_id", F.posexplode(windows("content")).alias("i", "w")).select("document_id", "i", "w.*")


@query
def toc_flatten(spark, d):
    """Headings with their parent: the last earlier heading of a smaller level on the page."""
    heads = md_blocks(spark, d).filter("kind = 'heading'").select("page_id", "i", F.length(F.regexp_extract("content", "^ *(#+)", 1)).alias("level"), F.regexp_replace("content", r"^[ #]+", "").alias("title"))
    before = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("i"))).over(before)) for k in range(1, 6)]
    return heads.select("page_id", "i", "level", "title", F.greatest(*last).alias("parent"))


_FAMILY = T.ArrayType(T.StructType().add("parent", T.IntegerType()).add("child", T.IntegerType()).add("content", T.StringType()).add("start", T.IntegerType()).add("stop", T.IntegerType()))


@F.pandas_udf(_FAMILY)
def families(text: pd.Series) -> pd.Series:
    return text.map(lambda t: M.parent_child(t or "", 1000))


@query
def parent_child_chunks(spark, d):
    """Parents (null child) and their children; page and ordinal make the parent's id."""
    rows = _pages(spark, d).select("page_id", F.explode(families("content")).alias("f")).select("page_id", "f.*")
    return rows.withColumn("parent_id", F.concat_ws(":", "page_id", "parent"))
