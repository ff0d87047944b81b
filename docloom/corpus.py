"""The document-service model as views over the given tables (all lazy, nothing is written)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, tenant_id (language), kb_id (source), title (first line), content."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("kb_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line: (document_id, chunk_index) is the key, byte positions are kept."""
    docs = documents(spark, sf_dir)
    lines = docs.select("document_id", "tenant_id", "kb_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "content"))
    return lines.filter(F.trim("content") != "").select(
        "document_id", "tenant_id", "kb_id", F.col("line_no").alias("chunk_index"), "content"
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-usage log from the events: service, model, document (user), tokens, cost and time."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("document_id"),
        F.col("event_type").alias("service"),
        F.when(F.col("event_id") % 3 == 0, "embedding").otherwise("chat").alias("model_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"),
        F.col("value").alias("cost"),
        F.col("ts").alias("created_at"),
    )


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as nodes (id, name, type)."""
    def part(name: str, key: str, label: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("type")
        )

    return (
        part("region", "r_regionkey", "r_name", "region")
        .unionByName(part("nation", "n_nationkey", "n_name", "nation"))
        .unionByName(part("customer", "c_custkey", "c_name", "customer"))
        .unionByName(part("supplier", "s_suppkey", "s_name", "supplier"))
    )


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTAINS edges from region to nation to customer and supplier (src, dst, type, weight)."""
    def edge(name: str, a_kind: str, a: str, b_kind: str, b: str, weight: float) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{a_kind}:"), F.col(a).cast("string")).alias("src"),
            F.concat(F.lit(f"{b_kind}:"), F.col(b).cast("string")).alias("dst"),
            F.lit("CONTAINS").alias("type"),
            F.lit(weight).alias("weight"),
        )

    return (
        edge("nation", "region", "n_regionkey", "nation", "n_nationkey", 1.0)
        .unionByName(edge("customer", "nation", "c_nationkey", "customer", "c_custkey", 0.5))
        .unionByName(edge("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", 0.8))
    )
