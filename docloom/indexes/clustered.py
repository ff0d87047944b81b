"""A vector index by clusters: centroids fitted on a bounded sample, one Parquet folder for each cluster, probes in rounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import against_all, dot, top_k, unit
from docloom.session import settle, shuffles_dropped

#: The centroids are fitted on at most so many vectors, and there are at most so many.
SAMPLE, MOST_LISTS = 20_000, 1024
#: Lists that a query reads in its first round; each further round doubles them.
PROBE = 8


def build(vectors: DataFrame, path: str, id_col: str, vec_col: str, keep: tuple[str, ...] = (), batch: int = 0, seed: int = 7) -> VectorIndex:
    """Index the vectors, of one length and not zero, with the columns ``keep`` to filter by. Batch 0 fits about sqrt(n)
    centroids; other batches use them and are added. Null vectors are left out."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, unit(F.col(vec_col)).alias("vec"))
    rows = rows.withColumn("features", array_to_vector("vec"))
    if batch == 0:
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("vec", F.lit(seed)), "vec").limit(SAMPLE) if n > SAMPLE else rows
        lists = min(max(1, math.isqrt(n)), MOST_LISTS)
        model = KMeans(k=max(2, lists), seed=seed, maxIter=10, predictionCol="list").fit(settle(sample.select("features")))
        model.write().overwrite().save(f"{path}/centroids")
    model = KMeansModel.load(f"{path}/centroids")
    placed = model.transform(rows).drop("features").withColumn("batch", F.lit(batch))
    with shuffles_dropped(spark):
        placed.hint("rebalance", "list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list", "batch").parquet(f"{path}/vectors")
    return VectorIndex(spark, path)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    def _lists(self, cover: float) -> DataFrame:
        """list, its centre at length one and the angle round it that holds the share ``cover`` of its vectors. At most MOST_LISTS rows."""
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(KMeansModel.load(f"{self.path}/centroids").clusterCenters()) if any(c)]
        centres = self.spark.createDataFrame(centres, "list int, centre array<double>").select("list", unit(F.col("centre")).alias("centre"))
        rows = self.spark.read.parquet(f"{self.path}/vectors").join(F.broadcast(centres), "list")
        angle = F.acos(F.least(F.greatest(dot(F.col("vec"), F.col("centre")), F.lit(-1.0)), F.lit(1.0)))
        radius = F.max(angle) if cover >= 1 else F.percentile_approx(angle, cover, 10_000)
        return centres.join(F.broadcast(rows.groupBy("list").agg(radius.alias("radius"))), "list")

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, least: float | None = None, cover: float = 1.0, probe: int = PROBE) -> DataFrame:
        """query_id, id, score, rank: the k nearest others by cosine per query (query_id, qvec), ids unlike query_id.

        ``where`` filters by kept columns before ranking, inside the scan; ``least`` cuts by score. A query reads the lists
        in the order of their bound, the cosine at the angle to the centre less the list's radius, twice as many each
        round, until no bound reaches its k-th score. With ``cover`` 1 this is exact; below 1 a list counts as smaller than
        it is, so fewer are read and near ones may be missed. Ranks follow the score to nine places, then the id.
        """
        asked = queries.select("query_id", unit(F.col("qvec")).alias("qvec"))
        lists = F.broadcast(self._lists(cover))
        angle = F.acos(F.least(F.greatest(dot(F.col("qvec"), F.col("centre")), F.lit(-1.0)), F.lit(1.0)))
        bound = F.cos(F.greatest(angle - F.col("radius") - 1e-7, F.lit(0.0)))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), angle, "list")
        pairs = asked.crossJoin(lists).withColumn("bound", bound).withColumn("turn", F.row_number().over(order))
        left = settle(pairs.select("query_id", "list", "bound", "turn"))
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        rows = rows if where is None else rows.filter(where)
        found, done = None, 0
        with shuffles_dropped(self.spark):
            while True:
                now, done = left.filter(F.col("turn") <= done + probe), done + probe
                probe *= 2
                numbers = [r.list for r in now.select("list").distinct().collect()]  # at most MOST_LISTS
                if not numbers:
                    break
                read = rows.filter(F.col("list").isin(numbers)).select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), F.col("list").alias("part"))
                asks = now.groupBy("query_id").agg(F.collect_list("list").alias("parts")).join(asked.filter("qvec is not null"), "query_id")
                scored = against_all(read, settle(asks), k, least, parted=True).withColumnRenamed("vec_id", "id")
                both = scored if found is None else found.drop("rank").unionByName(scored)
                found = settle(top_k(both, ["query_id"], F.desc(F.round("score", 9)), "id", k))
                beat = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
                left = left.filter(F.col("turn") > done).join(beat, "query_id", "left").filter(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - 1e-9))
                left = settle((left if least is None else left.filter(F.col("bound") >= least)).drop("beat"))
        return found if found is not None else asked.limit(0).select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
