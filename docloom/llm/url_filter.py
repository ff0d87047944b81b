"""URL allow and block rules by hash-prefix lookup of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, free_name

#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Hex digits of the SHA-256 digest that the first join compares; the rest is confirmed after it.
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest
    rule (host and path together) wins; of equally long rules a block wins, then the smaller text.
    Rules with a null part are ignored. Without a rule the verdict is ``default`` and ``rule`` null.
    Null urls, and urls without ``://``, have an empty host and path and so get the default. Columns
    of ``pages`` that carry one of the four names are replaced. Repeated rows are all kept.

    Only distinct (host, path) pairs are expanded: into the host and its parents at every dot, times
    the path's prefixes at the lengths that rules have. Expressions meet all rules of one short
    prefix of their digests in an equi-join; among those the full digest decides. A url has a bounded
    number of expressions, whatever the number of rules of one length.
    """
    live = rules.dropna(subset=["host", "path", "verdict"]).select(
        ascii_lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    keyed = live.withColumn("r_digest", F.sha2(F.concat_ws("\x00", "r_host", "r_path"), 256)).withColumn(
        "r_short", F.substring("r_digest", 1, PREFIX_HEX)
    )
    lengths = live.agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"))
    dropped = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    host, path, found = (free_name(pages, n) for n in ("url_host", "url_path", "url_rule"))
    parts = pages.withColumns({host: url_host(F.col(url_col)), path: url_path(F.col(url_col))}).drop(*dropped)
    labels = F.split("url_host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    expressions = (
        parts.select(F.col(host).alias("url_host"), F.col(path).alias("url_path"))
        .distinct()
        .crossJoin(F.broadcast(lengths))  # one row
        .withColumn("host_part", F.explode(suffixes))
        .withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("url_path"))))
        .withColumn("path_part", F.expr("substring(url_path, 1, n)"))
        .withColumn("digest", F.sha2(F.concat_ws("\x00", "host_part", "path_part"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"),
        (F.col("r_verdict") == "block").alias("b"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    by_prefix = keyed.groupBy("r_short").agg(F.collect_set(F.struct("r_digest", rank.alias("rank"))).alias("rules"))
    confirmed = F.filter("rules", lambda r: r["r_digest"] == F.col("digest"))
    best = (
        expressions.join(by_prefix, F.col("short") == F.col("r_short"))
        .select("url_host", "url_path", F.array_max(F.transform(confirmed, lambda r: r["rank"])).alias("rank"))
        .groupBy(F.col("url_host").alias(host), F.col("url_path").alias(path))
        .agg(F.max("rank").alias(found))
    )
    kept = [c for c in pages.columns if c not in dropped]
    return parts.join(best, [host, path], "left").select(
        *kept,
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(f"{found}.rule").alias("rule"),
        F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page of the table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h0,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
q AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, arg_max(rh || rp, length(rh) + length(rp)) AS rule,
         arg_max(rv, length(rh) + length(rp)) AS v
  FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
