"""Search channels: BM25, exact cosine neighbours, titles and bounded graph walks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script.
TOKEN = r"[\p{L}\p{N}_]+"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): one row per distinct term of a unit, with the unit's length in tokens."""
    t = units.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    return (
        t.withColumn("dl", F.size("terms"))
        .select("id", "dl", F.explode("terms").alias("term"))
        .groupBy("id", "term", "dl")
        .agg(F.count("*").alias("tf"))
    )


def bm25(units: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank: the k best units per query (query_id, text), ties to the smaller id."""
    return top_k(bm25_scores(units, queries, id_col, text_col, k1, b), ["query_id"], F.desc("score"), "id", k)


def bm25_scores(units: DataFrame, queries: DataFrame, id_col: str, text_col: str, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score of every unit that holds a term of the query.

    Terms of a query count once. Only postings of query terms are scored: queries are a stated set,
    so the term join filters the corpus before it is counted. Units without tokens have no score.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    lengths = units.select(F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = postings(units, id_col, text_col).join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return (
        hits.join(df, "term")
        .crossJoin(F.broadcast(stats))  # one row
        .withColumn("w", weight)
        .join(wanted, "term")
        .groupBy("query_id", "id")
        .agg(F.sum("w").alias("score"))
    )


def best_field(units: DataFrame, queries: DataFrame, id_col: str, boosts: dict[str, float]) -> DataFrame:
    """query_id, id, score: the best of several fields' BM25 scores, each with its own statistics and boost."""
    fields = [bm25_scores(units, queries, id_col, c).withColumn("score", F.col("score") * float(w)) for c, w in boosts.items()]
    return reduce(DataFrame.unionByName, fields).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def weighted_clauses(units: DataFrame, clauses: dict[str, tuple[DataFrame, float]], id_col: str, text_col: str) -> DataFrame:
    """query_id, id, score: the weighted sum of clauses. Each has questions of its own (query_id, text) and a weight; a unit
    that fits some clauses only has their part."""
    parts = [bm25_scores(units, asked, id_col, text_col).withColumn("score", F.col("score") * float(w)) for asked, w in clauses.values()]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def top_k(df: DataFrame, by: list[str], order: Column, tie: str, k: int) -> DataFrame:
    """The k first rows of each group with their rank; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def code_point(char: Column) -> Column:
    """The Unicode number of a character."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("bigint")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(vec: Column) -> Column:
    """The vector in double precision at length one; its norm is computed once."""
    wide = vec.cast("array<double>")
    return F.transform(F.array(F.sqrt(dot(wide, wide))), lambda n: F.transform(wide, lambda x: x / n))[0]


#: Rows of a query set that are broadcast at once, and rows of vectors and of queries that a task compares at once.
BLOCK, ROWS, ASKED = 4096, 1024, 256


def _packed(rows: DataFrame, size: int, names: list[str]) -> DataFrame:
    """rows (id, vecs: its vectors, all of one length) -> ``names``: ids, the number of vectors of each and these as
    bytes, up to ``size`` ids in a row; with a third column, arrays of int, also these and the number of each id's."""
    (id_col, kind), (_, wide) = rows.dtypes[:2]
    more = rows.columns[2:]
    dtype = np.float32 if "float" in wide else np.float64

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                ids, vecs = (b.slice(i, size).column(c) for c in (0, 1))
                x = vecs.flatten().flatten().to_numpy(zero_copy_only=False).astype(dtype)
                n = pa.compute.list_value_length(vecs)
                one = pa.array([0, len(ids)], pa.int32())
                made = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, n), pa.array([x.tobytes()], pa.binary())]
                if more:
                    parts = b.slice(i, size).column(2)
                    flat = parts.flatten()
                    made += [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.ListArray.from_arrays(one, pa.compute.list_value_length(parts))]
                yield pa.RecordBatch.from_arrays(made, names=names + [f"{c}_{names[0]}" for c in ("parts", "many") if more])

    extra = f", parts_{names[0]} array<int>, many_{names[0]} array<int>" if more else ""
    return rows.mapInArrow(pack, f"{names[0]} array<{kind}>, {names[1]} array<int>, {names[2]} binary{extra}")


class _Vectors:
    """A packed row: ids, vectors at length one in double precision, and where those of each id begin."""

    def __init__(self, ids: pa.Scalar, n: pa.Scalar, x: pa.Scalar, dtype: type) -> None:
        self.ids, self.n = ids.values, n.values.to_numpy()
        self.first = np.cumsum(self.n) - self.n
        x = np.frombuffer(x.as_py(), dtype).reshape(int(self.n.sum()), -1).astype(np.float64) if self.n.any() else np.zeros((0, 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def part(self, a: int, z: int) -> _Vectors:
        out = object.__new__(_Vectors)
        rows = slice(self.first[a], self.first[z - 1] + self.n[z - 1])
        out.ids, out.n, out.first, out.x = self.ids.slice(a, z - a), self.n[a:z], self.first[a:z] - self.first[a], self.x[rows]
        return out


def _cosines(q: _Vectors, v: _Vectors) -> np.ndarray:
    """The best cosine of an id of q (row) with one of v (column): inf for NaN, which comes first in an order as in SQL;
    -inf for null, where one has no vector, and for the same id."""
    out = np.full((len(q.n), len(v.n)), -np.inf)
    some, other = q.n > 0, v.n > 0
    if some.any() and other.any():
        s = q.x @ v.x.T
        s = s if len(q.x) == some.sum() else np.maximum.reduceat(s, q.first[some], axis=0)
        s = s if len(v.x) == other.sum() else np.maximum.reduceat(s, v.first[other], axis=1)
        out[np.ix_(some, other)] = np.where(np.isnan(s), np.inf, s)
    return out


def _met(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, type, type]:
    """Every packed row of ``vectors`` (id, vecs) beside every packed row of ``queries`` (id, vecs, ...), block by block, and
    the types of their components. ``queries`` is a stated set; each block of at most about BLOCK rows is broadcast."""
    id_col = queries.columns[0]
    blocks = max(1, -(-queries.count() // BLOCK))
    part = F.pmod(F.xxhash64(id_col), F.lit(blocks))
    v = _packed(vectors, ROWS, ["ids", "n", "x"]).repartition(max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    q = [_packed((queries.filter(part == i) if blocks > 1 else queries).repartition(1), BLOCK, ["asked", "m", "y"]) for i in range(blocks)]
    kind = lambda df: np.float32 if "float" in df.dtypes[1][1] else np.float64
    return reduce(DataFrame.unionByName, [v.crossJoin(F.broadcast(x)) for x in q]), kind(vectors), kind(queries)


def _vecs(vec: Column) -> Column:
    return F.filter(F.array(vec), lambda x: x.isNotNull())


def _wanted(b: pa.RecordBatch, r: int) -> np.ndarray:
    """Which parts (column) each query (row) of a packed row asks for."""
    parts, many = b.column("parts_asked")[r].values.to_numpy(), b.column("many_asked")[r].values.to_numpy()
    out = np.zeros((len(many), parts.max(initial=-1) + 2), bool)
    out[np.repeat(np.arange(len(many)), many), parts] = True
    return out


def against_all(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, several: bool = False, parted: bool = False) -> DataFrame:
    """query_id, vec_id, score: the cosine of every vector (vec_id, embedding) with every other query
    (query_id, qvec), an id of its own. With ``several`` an id that has several rows counts once, by the best of its vectors.

    Only scores from ``least`` on, if given, and of those that a task sees only the ``k`` best of a query, by nine places and
    then the id. With ``parted`` only vectors of a part (part, int) that the query asks for (parts, array of int), none of both null.
    Packed rows of vectors meet packed rows of queries, see _met; a task holds ASKED times ROWS scores at once."""
    if several:
        vectors = vectors.groupBy("vec_id").agg(F.collect_list("embedding").alias("vecs"))
        queries = queries.groupBy("query_id").agg(F.collect_list("qvec").alias("vecs"))
    else:
        vectors = vectors.select("vec_id", _vecs(F.col("embedding")).alias("vecs"), *[F.array("part").alias("parts")] * parted)
        queries = queries.select("query_id", _vecs(F.col("qvec")).alias("vecs"), *["parts"] * parted)
    met, v_type, q_type = _met(vectors, queries)
    (_, v_kind), (_, q_kind) = vectors.dtypes[0], queries.dtypes[0]

    def rows(asked: pa.Array, ids: pa.Array, score: np.ndarray) -> pa.RecordBatch:
        shown = np.where(score == np.inf, np.nan, score)
        return pa.RecordBatch.from_arrays([asked, ids, pa.array(shown, mask=score == -np.inf)], names=["query_id", "vec_id", "score"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict = {}  # with k: for each part of the queries its ids, then numbers of queries, ids of vectors and scores so far
        last = (None, None)
        for b in batches:
            for r in range(b.num_rows):
                key = (b.column("asked")[r].values[0].as_py(), b.column("y")[r].as_py())
                if key != last[0]:
                    last = (key, _Vectors(*(b.column(c)[r] for c in ("asked", "m", "y")), q_type), _wanted(b, r) if parted else None)
                v = _Vectors(*(b.column(c)[r] for c in ("ids", "n", "x")), v_type)
                for a in range(0, len(last[1].n), ASKED):
                    q = last[1].part(a, min(a + ASKED, len(last[1].n)))
                    if parted:
                        part = np.minimum(b.column("parts_ids")[r].values.to_numpy(), last[2].shape[1] - 1)
                        mine = last[2][a : a + ASKED][:, part]
                        rows_, columns = np.flatnonzero(mine.any(axis=1)), np.flatnonzero(mine.any(axis=0))
                        s = np.full(mine.shape, -np.inf)
                        if not len(rows_):
                            continue
                        s[np.ix_(rows_, columns)] = q.x[rows_] @ v.x[columns].T
                    else:
                        s = _cosines(q, v)
                    own = np.equal.outer(q.ids.to_numpy(zero_copy_only=False), v.ids.to_numpy(zero_copy_only=False))
                    own = own | ~mine if parted else own
                    old = held.get((key, a))
                    low = old[4][:, None] if old else -np.inf if least is None else least
                    if k and not old and len(v.n) > k:
                        low = np.maximum(low, np.partition(np.where(own, -np.inf, s), -k, axis=1)[:, -k:][:, :1] - 2e-9)
                    of, at = np.nonzero((s >= low) & ~own)
                    if k is None:
                        yield rows(q.ids.take(pa.array(of)), v.ids.take(pa.array(at)), s[of, at])
                        continue
                    new = (of, v.ids.take(pa.array(at)).to_numpy(zero_copy_only=False), s[of, at])
                    of, who, score = (np.concatenate(x) for x in zip(old[1:4], new, strict=True)) if old else new
                    order = np.lexsort((who, -np.round(score, 9), of))
                    of, who, score = of[order], who[order], score[order]
                    size = np.bincount(of, minlength=len(q.n))
                    rank = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                    beat = np.full(len(q.n), -np.inf if least is None else least)
                    beat[of[rank == k - 1]] = score[rank == k - 1] - 2e-9
                    held[key, a] = (q.ids, of[rank < k], who[rank < k], score[rank < k], beat)
        for ids, of, who, score, _ in held.values():
            yield rows(ids.take(pa.array(of)), pa.array(who, b.column("ids").type.value_type), score)

    return met.mapInArrow(compare, f"query_id {q_kind}, vec_id {v_kind}, score double")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, vec_id, score, rank: exact nearest others by cosine; see against_all."""
    return top_k(against_all(vectors, queries, k), ["query_id"], F.desc(F.round("score", 9)), "vec_id", k)


def best_of_variants(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vec_id, score: for every vector (vec_id, embedding) the best of its weighed cosines with the other variants
    (query_id, qvec, weight). A task gives one row for each vector and block of variants; see _met."""
    vectors = vectors.select("vec_id", _vecs(F.col("embedding")).alias("vecs"))
    weights = [(r.weight, queries.filter(F.col("weight") == r.weight)) for r in queries.select("weight").distinct().collect()]  # a stated few
    kind = vectors.dtypes[0][1]
    parts = []
    for weight, asked in weights:
        met, v_type, q_type = _met(vectors, asked.select("query_id", _vecs(F.col("qvec")).alias("vecs")))

        def compare(batches: Iterable[pa.RecordBatch], weight=weight, v_type=v_type, q_type=q_type) -> Iterable[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    asked = _Vectors(*(b.column(c)[r] for c in ("asked", "m", "y")), q_type)
                    v = _Vectors(*(b.column(c)[r] for c in ("ids", "n", "x")), v_type)
                    best, others = np.full(len(v.n), -np.inf), np.zeros(len(v.n), bool)
                    for a in range(0, len(asked.n), ASKED):
                        q = asked.part(a, min(a + ASKED, len(asked.n)))
                        own = np.equal.outer(q.ids.to_numpy(zero_copy_only=False), v.ids.to_numpy(zero_copy_only=False))
                        best = np.maximum(best, np.where(own, -np.inf, _cosines(q, v) * weight).max(axis=0))
                        others |= ~own.all(axis=0)
                    shown = pa.array(np.where(best == np.inf, np.nan, best), mask=best == -np.inf)
                    yield pa.RecordBatch.from_arrays([v.ids, shown], names=["vec_id", "score"]).filter(pa.array(others))

        parts.append(met.mapInArrow(compare, f"vec_id {kind}, score double"))
    return reduce(DataFrame.unionByName, parts).groupBy("vec_id").agg(F.max("score").alias("score"))


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, distance: nodes within ``hops`` undirected steps of the start nodes, which have distance 0.

    Each step joins the frontier with the edges and drops what was reached before."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = start.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = reached
    for d in range(1, hops + 1):
        step = frontier.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(frontier)
    return reached


def directed_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """origin, id, steps: every node reached from each start node along the edges, by each way of at most ``hops`` steps."""
    level = start.select(F.col("id").alias("origin"), "id", F.lit(0).alias("steps"))
    found = None
    for n in range(1, hops + 1):
        level = level.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("origin", F.col("dst").alias("id"), F.lit(n).alias("steps"))
        found = level if found is None else found.unionByName(level)
    return found


def shortest_paths(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, path, distance: a shortest undirected path to every node within ``hops`` of the start nodes.

    Of paths of one length the least is kept. Each hop reads the state once: a row gives itself and,
    if the last hop found it, its neighbours, so the plan grows by one join a hop."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    state = start.select("id", F.struct(F.lit(0).alias("distance"), F.array("id").alias("path")).alias("best")).distinct()
    for n in range(1, hops + 1):
        on = (F.col("id") == F.col("src")) & (F.col("best.distance") == n - 1)
        new = F.struct(F.lit(n).alias("distance"), F.concat("best.path", F.array("dst")).alias("path"))
        both_rows = F.array(F.struct("id", "best"), F.struct(F.col("dst").alias("id"), new.alias("best")))
        rows = state.join(both, on, "left").select(F.inline(both_rows)).filter("id is not null")
        state = rows.groupBy("id").agg(F.min("best").alias("best"))
    return state.select("id", "best.path", "best.distance")


def descendants(nodes: DataFrame, key: str, parent: str, by: list[str], depth: int) -> DataFrame:
    """ancestor, ``key``, steps: every node below every other, at most ``depth`` levels down."""
    down = nodes.filter(F.col(parent).isNotNull()).select(*by, F.col(parent).alias("ancestor"), key)
    found = level = down.withColumn("steps", F.lit(1))
    for n in range(2, depth + 1):
        up = level.select(*by, "ancestor", F.col(key).alias("__at"))
        level = down.withColumnRenamed("ancestor", "__at").join(up, [*by, "__at"]).select(*by, "ancestor", key, F.lit(n).alias("steps"))
        found = found.unionByName(level)
    return found
