"""Filters, paging, updates, lookups and usage analytics over the model's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    """AND of equalities; an empty or missing value leaves its filter out, a list means membership."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in equal.items() if v not in (None, "")]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def contains_any(df: DataFrame, keyword: str, *columns: str) -> DataFrame:
    """Case-insensitive substring in any of the columns; the keyword's own % and _ are literal."""
    if not keyword:
        return df
    safe = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{safe}%") for c in columns]))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of a totally ordered result; number below 1 is 1, size outside 1..100 is 20."""
    number, size = max(number, 1), size if 0 < size <= 100 else 20
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def unexpired(df: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    """A null expiry never ends."""
    return df.filter(F.col(column).isNull() | (F.col(column) > now))


def partial_update(df: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-empty values of ``delta`` replace those of ``df``; nulls and empty strings change nothing."""
    d = delta.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    new = {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in columns}
    return df.join(d, key, "left").withColumns(new).select(*df.columns)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full replacement: rows of the keys that ``new`` has go, its rows come."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def totals(usage: DataFrame, *by: str) -> DataFrame:
    """Calls, token sums and cost; without rows the sums are zero, not null."""
    zero = lambda c, kind: F.coalesce(F.sum(c), F.lit(0).cast(kind))
    aggs = [
        F.count("*").alias("calls"),
        zero("input_tokens", "bigint").alias("input_tokens"),
        zero("output_tokens", "bigint").alias("output_tokens"),
        zero(F.col("input_tokens") + F.col("output_tokens"), "bigint").alias("total_tokens"),
        F.round(zero("cost", "double"), 4).alias("cost"),
    ]
    return usage.groupBy(*by).agg(*aggs) if by else usage.agg(*aggs)


def top_documents(usage: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The k documents with most tokens, with their titles; an unknown document has an empty title.

    Only k rows are joined, so the title side is looked up, not scanned into memory."""
    best = totals(usage, "document_id").orderBy(F.desc("total_tokens"), "document_id").limit(k)
    return best.join(docs.select("document_id", "title"), "document_id", "left").select(
        "document_id", "calls", "total_tokens", F.coalesce("title", F.lit("")).alias("title")
    )


def share_by(df: DataFrame, group: str, key: str) -> DataFrame:
    """Share of each non-empty key within its group; empty keys count in the denominator only."""
    counts = df.groupBy(group, key).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("share", F.col("n") / whole).filter(F.coalesce(F.col(key), F.lit("")) != "")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Join a small price table (model_type, input_price, output_price per 1000 tokens)."""
    return usage.join(prices, "model_type", "left").withColumn(
        "estimated_cost",
        F.coalesce((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1000, F.lit(0.0)),
    )


def neighbours(chunks: DataFrame, size: int = 300) -> DataFrame:
    """Each chunk with the text of the chunks at index - 1 and + 1 of its document, where they exist."""
    near = lambda shift, name: chunks.select(
        "document_id", (F.col("chunk_index") + shift).alias("chunk_index"), F.left("content", F.lit(size)).alias(name)
    )
    key = ["document_id", "chunk_index"]
    return chunks.join(near(1, "previous"), key, "left").join(near(-1, "next"), key, "left")


def neighbours_by_order(chunks: DataFrame, size: int = 300) -> DataFrame:
    """The chunks before and after in order, whatever their index: gaps are stepped over."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    cut = F.left("content", F.lit(size))
    return chunks.withColumns({"previous": F.lag(cut).over(w), "next": F.lead(cut).over(w)})


def resolve_ids(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Resolve a reference by id, else by name; rows that resolve to nothing are dropped."""
    by_id = names.select(F.col("id").alias("__id"))
    by_name = names.groupBy(F.col("name").alias("__name")).agg(F.min("id").alias("__named"))
    out = rows.join(by_id, F.col(column) == F.col("__id"), "left").join(by_name, F.col(column) == F.col("__name"), "left")
    found = F.coalesce("__id", "__named")
    return out.filter(found.isNotNull()).withColumn(column, found).select(*rows.columns)


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as one aggregate that combines before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*")


def cache_hits(calls: DataFrame, by: str, *content: str) -> DataFrame:
    """Calls per group and how many of them a cache keyed by the content's hash answers."""
    key = F.sha2(F.concat_ws("|", by, *content), 256).alias("__k")
    return calls.groupBy(by, key).agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("hits"))


def row_text(columns: list[str]) -> Column:
    """A table row as a sentence of "header is value" parts; empty cells are left out."""
    cell = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}为"), F.col(c).cast("string")))
    return F.concat_ws("，", *[cell(c) for c in columns])


def merged(*maps: Column) -> Column:
    """One map of several; a later value of a key wins."""
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    last = lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])) == 0
    return F.map_from_entries(F.filter(entries, last))


def resolved(rows: DataFrame, original: str, enrichments: list[str], source: str = "source") -> DataFrame:
    """Add ``resolved``: what ``source`` names, "original", "enrichment:NAME" or "composite:A+B". Parts of a
    composite that are null are left out, the others stand in the order named."""
    known = F.create_map(F.lit("original"), F.col(original), *[x for n in enrichments for x in (F.lit(n), F.col(n))])
    names = F.split(F.regexp_replace(source, "^(enrichment|composite):", ""), r"\+")
    parts = F.filter(F.transform(names, lambda n: F.element_at(known, n)), lambda p: p.isNotNull())
    return rows.withColumn("resolved", F.array_join(parts, "\n\n"))


def keywords_by(rows: DataFrame, by: str, stop_words: list[str], k: int = 20) -> DataFrame:
    """The k commonest words of each group (``by``, words: an array per row), of two letters or more and no stop words.

    The group is a column of its own before the words are unfolded, so it is computed once a row."""
    words = rows.select(by, F.explode("words").alias("keyword")).filter((F.length("keyword") >= 2) & ~F.col("keyword").isin(stop_words))
    n = words.groupBy(by, "keyword").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), "keyword")
    return n.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")
