"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize
from docloom.llm.components import components
from docloom.llm.vectors import is_valid, keyed, random_leaves, unit_rows

THRESHOLD = 0.93
TREES, LEAF, SPILL = 12, 256, 0.08
#: The upper splits of a tree are fitted on at most so many vectors, and make groups of about GROUP.
SAMPLE, GROUP = 20_000, 20_000
_ROWS = 2048


def _upper_splits(reps: DataFrame, trees: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """Per tree, random directions and thresholds (sample medians) that cut the largest group of one label
    and length; vectors of other lengths are not cut by them."""
    top = reps.groupBy("label", F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    depth = int(np.ceil(np.log2(max(top["count"] / GROUP, 1)))) if top else 0
    if depth == 0:
        return None
    sample = reps.filter(F.size("vec") == top["d"]).orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).select("vec").toArrow()
    x = unit_rows(sample.column("vec"))
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees, depth, x.shape[1]))
    return planes, [np.median(x @ planes[t].T, axis=0) for t in range(trees)]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    seed: int = 11,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of one label and one length are compared by cosine in double precision where they share
    a leaf of some tree; those at ``threshold`` or above are linked. Null, empty and zero vectors,
    those with a null or non-finite component, and rows without label link with nothing. Equal
    vectors are one class from the start: its members are linked with each other and share the
    links of the class. An id may come with several vectors, each with links of its own. A row with a null id has no links and no component. No rows give no rows.

    A link is counted in the first leaf that its two ends share, which each end's list of leaves
    tells, so pairs never leave their task; a leaf only sends counts and a spanning forest.
    """
    rows = keyed(vectors, id_col, vec_col, label_col)
    classes = rows.groupBy("label", "h", "vec").agg(F.min("id").alias("vec_id"), F.count("*").alias("n"))
    # a number for each class, ascending with its least id: one id may stand for several vectors
    reps = materialize(classes.repartitionByRange("vec_id").sortWithinPartitions("vec_id").withColumn("id", F.monotonically_increasing_id()))
    kind, upper = "bigint", _upper_splits(reps, trees, seed)

    def plant(batches):
        """A row per tree with the upper group; rows close to a plane go to both of its sides."""
        for b in batches:
            ids, labels = b.column(0), b.column(1)
            dims = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                vec = b.column(2).take(pa.array(at))
                who, tree, group = [], [], []
                for t in range(trees):
                    w, g = np.arange(len(at)), np.zeros(len(at), np.int64)
                    if upper is not None and d == upper[0].shape[2]:
                        p = unit_rows(vec) @ upper[0][t].T - upper[1][t]
                        for k in range(p.shape[1]):
                            side = p[w, k]
                            both = np.abs(side) < 0.1
                            w, g = np.concatenate((w, w[both])), np.concatenate((g * 2 + (side > 0), g[both] * 2 + (side[both] <= 0)))
                    who.append(w), tree.append(np.full(len(w), t)), group.append(g)
                w = pa.array(at[np.concatenate(who)])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(w), labels.take(w).cast(pa.string()), pa.array(np.concatenate(tree).astype(np.int32)), pa.array(np.concatenate(group)), pa.array(np.full(len(w), d, np.int32)), b.column(2).take(w)],
                    names=["id", "label", "tree", "grp", "dim", "vec"],
                )

    vec_kind = dict(reps.dtypes)["vec"]
    planted = reps.select("id", "label", "vec").mapInArrow(plant, f"id {kind}, label string, tree int, grp bigint, dim int, vec {vec_kind}")

    def split(table: pa.Table) -> pa.Table:
        tree, grp = table.column("tree")[0].as_py(), table.column("grp")[0].as_py()
        table = table.sort_by("id")
        leaves = random_leaves(unit_rows(table.column("vec")), seed * 1000 + tree, LEAF, SPILL, threshold)
        at = np.concatenate(leaves)
        no = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        name = f"{table.column('label')[0].as_py()}|{table.column('dim')[0].as_py()}|{tree:03d}|{grp}|"
        return pa.table({"id": table.column("id").take(pa.array(at)), "leaf": pa.array([f"{name}{i:06d}" for i in no], pa.string())})

    in_leaf = planted.groupBy("label", "dim", "tree", "grp").applyInArrow(split, f"id {kind}, leaf string")
    lists = in_leaf.groupBy("id").agg(F.sort_array(F.collect_set(F.xxhash64("leaf"))).alias("leaves"))
    members = reps.join(lists, "id").select("id", "n", "vec", "leaves", F.explode("leaves").alias("leaf"))

    def compare(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        x, n = unit_rows(table.column("vec")), table.column("n").to_numpy().astype(np.float64)
        lists = [[k for k in y if k < leaf] for y in table.column("leaves").to_pylist()]
        names, at = np.unique(np.array([k for y in lists for k in y], np.int64), return_inverse=True)
        earlier = np.zeros((len(ids), len(names)), np.float32)
        earlier[np.repeat(np.arange(len(ids)), [len(y) for y in lists]), at] = 1
        earlier = earlier[:, earlier.sum(axis=0) > 1]
        links, root = np.zeros(len(ids)), np.arange(len(ids))
        blocks = []
        for i in range(0, len(ids), _ROWS):
            near = x[i : i + _ROWS] @ x.T >= threshold
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            counted = near & (earlier[i : i + _ROWS] @ earlier.T == 0)
            links[i : i + _ROWS] = counted @ n
            blocks.append(np.packbits(near, axis=1))
        while True:  # least row reachable within the leaf
            new = root.copy()
            for i, packed in zip(range(0, len(ids), _ROWS), blocks, strict=True):
                near = np.unpackbits(packed, axis=1, count=len(ids)).astype(bool)
                new[i : i + _ROWS] = np.minimum(new[i : i + _ROWS], np.where(near, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"id": pa.array(ids), "links": pa.array(links.astype(np.int64)), "root": pa.array(ids[root])})

    found = materialize(members.groupBy("leaf").applyInArrow(compare, f"id {kind}, links bigint, root {kind}"))
    joined = components(found.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    least = reps.select(F.col("id").alias("least"), F.col("vec_id").alias("component_id"))
    classes = (
        reps.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(joined, F.col("id") == F.col("node"), "left")
        .select("label", "h", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("least"))
        .join(least, "least")
    )
    linked = rows.join(classes, ["label", "h", "vec"]).select("id", "n_links", "component_id")
    label = F.col(label_col) if label_col else F.lit(0)
    rest = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label.alias("label")).filter(
        ~F.coalesce(is_valid(F.col("vec")) & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    )
    alone = rest.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector of the table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
