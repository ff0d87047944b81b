"""Tables in buckets of their key, changed in place bucket by bucket.

A change rewrites the buckets that hold a key of the delta and leaves the files of all others alone. The new rows are
computed and cut from the old files before any file goes; the same change made again gives the same table, so a change
that was broken off is simply repeated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import settle

BUCKETS = 64


@dataclass
class KeyedTable:
    """Rows in Parquet folders by a hash of ``key``; several rows may have one key, such as the chunks of a document."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """Write all rows; a null key has a bucket like any other."""
        table = cls(rows.sparkSession, path, key, buckets)
        rows.withColumn("bucket", table._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys, from their buckets only; the numbers of these, at most ``buckets``, become a partition filter."""
        found = [r.bucket for r in keys.select(self._bucket().alias("bucket")).distinct().collect()]
        return self._stored().filter(F.col("bucket").isin(found)).join(keys.select(self.key).distinct(), self.key, "left_semi").drop("bucket")

    def merge(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, partial: bool = False) -> list[int]:
        """Replace, add and delete in one pass; returns the buckets that were rewritten.

        ``deletes`` (key) goes first. Then the rows of ``upserts`` stand in place of all rows of their keys. With ``partial``
        they must have one row a key: a value that is null or empty there leaves the old one, and columns that ``upserts``
        lacks stay. A null key is like no other and is neither replaced nor deleted."""
        touched = [x.select(self._bucket().alias("bucket"), F.col(self.key).alias("k")).filter("k is not null") for x in (upserts, deletes) if x is not None]
        if not touched:
            return []
        keys = touched[0] if len(touched) == 1 else touched[0].union(touched[1])
        found = sorted(r.bucket for r in keys.select("bucket").distinct().collect())
        old = self._stored().filter(F.col("bucket").isin(found)).select("bucket", *self.read().columns)
        if deletes is not None:
            old = old.join(deletes.select(self.key).distinct(), self.key, "left_anti").select(old.columns)
        new = old
        if upserts is not None:
            given = upserts.filter(F.col(self.key).isNotNull())
            if partial:
                columns = [c for c in given.columns if c != self.key]
                delta = given.select(self.key, F.struct(*columns).alias("given"))
                kinds = dict(old.dtypes)
                said = {c: F.col(f"given.{c}") if kinds[c] != "string" else F.nullif(F.col(f"given.{c}"), F.lit("")) for c in columns}
                both = old.join(delta, self.key, "left").withColumns({c: F.coalesce(v, F.col(c)) for c, v in said.items()}).select(old.columns)
                fresh = given.join(old.select(self.key).distinct(), self.key, "left_anti")
                new = both.unionByName(fresh.withColumn("bucket", self._bucket()), allowMissingColumns=True)
            else:
                rest = old.join(given.select(self.key).distinct(), self.key, "left_anti").select(old.columns)
                new = rest.unionByName(given.withColumn("bucket", self._bucket()))
        new = settle(new)
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        left = {r.bucket for r in new.select("bucket").distinct().collect()}
        for b in sorted(set(found) - left):
            self._remove(f"{self.path}/bucket={b}")
        return found

    def _remove(self, folder: str) -> None:
        """A bucket without rows: overwriting by partition leaves it as it was."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def delete_documents(tables: list[KeyedTable], keys: DataFrame) -> None:
    """Delete the rows of the keys from every table, children first: pass them in that order. All are kept under one key."""
    for t in tables:
        t.merge(deletes=keys.withColumnRenamed(keys.columns[0], t.key))


def delete_nodes(nodes: KeyedTable, edges_by_src: KeyedTable, edges_by_dst: KeyedTable, ids: DataFrame) -> None:
    """Delete nodes (id) and the edges at either end. Edges are kept twice, by ``src`` and by ``dst``, so each end is a key."""
    gone = settle(ids.select("id").distinct())
    as_src, as_dst = gone.select(F.col("id").alias("src")), gone.select(F.col("id").alias("dst"))
    out, into = settle(edges_by_src.lookup(as_src)), settle(edges_by_dst.lookup(as_dst))
    _without(edges_by_dst, out)
    _without(edges_by_src, into)
    edges_by_src.merge(deletes=as_src)
    edges_by_dst.merge(deletes=as_dst)
    nodes.merge(deletes=gone)


def _without(table: KeyedTable, edges: DataFrame) -> None:
    """Take single edges out of the rows of their keys."""
    mine = table.lookup(edges)
    rest = mine.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(mine.columns)
    table.merge(upserts=rest, deletes=edges.select(table.key).distinct())
