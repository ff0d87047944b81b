"""Exact top-k inner products by a table of distances to pivots.

An inner product is (|q|^2 + |c|^2 - |q - c|^2) / 2, and |q - c| is at least |d(q, p) - d(c, p)| for every pivot p.
So the table bounds every score from above. Candidates are dealt into cells by their nearest pivot, large cells into
blocks. A query first searches one block of its own cell, which gives a score to beat; then it goes to the blocks of
those cells only whose range of distances lets them beat it. In its own block candidates are evaluated from the highest
bound down until the next bound is below the k-th score found. In the others there is a score to beat, and pivots together
bound more than one by one: the parts of two vectors within the pivots' span give their share of the score, and what is
left of them adds at most the product of its lengths. Matrix products bound many queries and a block at once so, and only
pairs whose bound reaches the score to beat are evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize
from docloom.llm.vectors import integers, is_finite, padded_rows

K, SCALE = 20, 64
#: Pivots lie far from each other within a sample of at most SAMPLE vectors.
PIVOTS, SAMPLE = 32, 4096
#: The span is that of as many pivots as this share of the components, and of SPAN_MOST at most.
SPAN, SPAN_MOST = 7 / 8, 256
#: Most candidates, and about the most queries, that meet in one task at a time.
BLOCK = 16_384
_QUERIES = 128  # whose bounds are computed at once
_LONG = 1 << 63
_LEAST = -_LONG
#: More than the rounding of a distance kept in single precision, as a share of it.
_ROUNDING = 2.0**-20
#: From this share of pairs left on, one matrix product evaluates them faster than each by itself.
_DENSE = 1 / 32
_GATHERED = 1 << 22  # components of pairs evaluated by themselves, at a time


def _norms(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y * y).sum(axis=1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    y, p = x.astype(np.float64), pivots.astype(np.float64)
    squares = _norms(y)[:, None] + _norms(p)[None, :] - 2 * (y @ p.T)
    return np.sqrt(np.maximum(squares, 0))


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n distinct rows of x, each the farthest from those before it."""
    chosen = [0]
    away = _to_pivots(x, x[:1])[:, 0]
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _to_pivots(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _span(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal columns whose span holds the pivots."""
    return np.linalg.qr(pivots.astype(np.float64).T)[0]


def _in_span(x: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Rows whose products are not below those of x: the part within the span, the length of the rest, room for rounding."""
    y = x.astype(np.float64)
    norms, inside = _norms(y), y @ span
    rest = np.sqrt(np.maximum(norms - _norms(inside), 0) + 1e-10 * norms)
    room = np.sqrt((span.shape[1] + 8) * 2.0**-23 * norms)
    return np.column_stack((inside, rest, room)).astype(np.float32)


class _Block:
    """Candidates of one block, by id (nulls last), then key: the order of ties."""

    def __init__(self, table: pa.Table, width: int, dtype: type, span: np.ndarray | None) -> None:
        table = table.sort_by([("id", "ascending"), ("key", "ascending")])
        self.ids, self.keys = table.column("id"), table.column("key").to_numpy()
        x = padded_rows(table.column("v"), width)
        self.norms = _norms(x)
        self.x, self.exact = x.astype(dtype), dtype is not object
        self.far = padded_floats(table.column("far")) if span is None and self.exact else None
        self.flat = None if span is None else _in_span(x, span)

    def bounds(self, norms: np.ndarray, far: np.ndarray) -> np.ndarray:
        """No score of a query (row) with a candidate (column) is above this. Without exact floats nothing is ruled out."""
        if not self.exact:
            return np.full((len(norms), len(self.keys)), np.inf)
        gap = np.zeros((len(norms), len(self.keys)), np.float32)
        for p in range(far.shape[1]):
            np.maximum(gap, np.abs(far[:, p, None] - self.far[None, :, p]), out=gap)
        reach = np.float32(_ROUNDING * (far.max(initial=0) + self.far.max(initial=0)))
        gap = np.maximum(gap - reach, 0).astype(np.float64)
        return np.floor((norms[:, None] + self.norms[None, :] - gap * gap) / 2 + 0.001)

    def best(self, q: np.ndarray, key: int, beat: int, bound: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Places and scores of the k best candidates with a score of ``beat`` at least, but the query's own row."""
        live = np.flatnonzero((bound >= beat) & (self.keys != key))
        live = live[np.argsort(-bound[live], kind="stable")]
        at, scores, done, step = np.zeros(0, np.int64), np.zeros(0, self.x.dtype), 0, 4 * k
        while done < len(live) and bound[live[done]] >= beat:
            here = live[done : done + step]
            new = self.x[here] @ q
            at, scores = np.concatenate((at, here)), np.concatenate((scores, new if self.exact else np.clip(new, -_LONG, _LONG - 1)))
            top = np.lexsort((at, -scores))[:k] if self.exact else np.array(sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k])
            at, scores = at[top], scores[top]
            if len(at) == k:
                beat = max(beat, scores[-1])
            done, step = done + step, 2 * step
        good = (scores >= beat).astype(bool)
        return at[good], [int(s) for s in scores[good]]

    def open(self, flat: np.ndarray, beats: np.ndarray) -> np.ndarray:
        """Whether a query (row) may score ``beats`` at least with a candidate (column), by their parts in the span."""
        return flat @ self.flat.T >= np.nextafter(beats.astype(np.float32), np.float32(-np.inf))[:, None]

    def scan(self, x: np.ndarray, keys: np.ndarray, beats: np.ndarray, flat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As best, for all queries at once: numbers of queries, places and scores."""
        left = self.open(flat, beats)
        if np.count_nonzero(left) < _DENSE * left.size:
            of, at = np.nonzero(left)
            step = max(1, _GATHERED // x.shape[1])
            parts = [slice(p, p + step) for p in range(0, max(1, len(of)), step)]
            scores = np.concatenate([np.einsum("ij,ij->i", x[of[p]], self.x[at[p]]) for p in parts])
        else:
            every = x @ self.x.T
            of, at = np.nonzero(left & (every >= beats.astype(every.dtype)[:, None]))
            scores = every[of, at]
        good = (scores >= beats[of]) & (self.keys[at] != keys[of])
        of, at, scores = of[good], at[good], scores[good].astype(np.int64)
        ends = np.cumsum(np.bincount(of, minlength=len(x)))
        good = np.ones(len(of), bool)
        for i, j in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
            if j - i > k:
                kth = np.partition(scores[i:j], j - i - k)[j - i - k]
                above = scores[i:j] > kth
                above[np.flatnonzero(scores[i:j] == kth)[: k - np.count_nonzero(above)]] = True
                good[i:j] = above
        return of[good], at[good], scores[good]


def padded_floats(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _searcher(width: int, dtype: type, k: int, span: np.ndarray | None):
    """Reads the candidates and then the queries of one block after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        name, waiting, block = None, [], None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in ("cell", "salt", "grp", "kind")], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1, [len(place)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                if name != tuple(place[i, :3]):
                    name, waiting, block = tuple(place[i, :3]), [], None
                if place[i, 3] == 0:
                    waiting.append(b.slice(i, j - i))
                    continue
                if waiting:
                    block, waiting = _Block(pa.Table.from_batches(waiting), width, dtype, span), []
                if block is not None:
                    for at in range(i, j, _QUERIES):
                        yield _answer(block, b.slice(at, min(_QUERIES, j - at)), width, k, span)

    return run


def _answer(block: _Block, queries: pa.RecordBatch, width: int, k: int, span: np.ndarray | None) -> pa.RecordBatch:
    x, keys = padded_rows(queries.column("v"), width), queries.column("key").to_numpy()
    if span is None:
        bounds = block.bounds(_norms(x), padded_floats(queries.column("far")) if block.exact else None)
        beats, q = queries.column("beat").to_pylist(), x.astype(block.x.dtype)
        found = [block.best(q[i], int(keys[i]), beats[i], bounds[i], k) for i in range(len(keys))]
        of, at = np.repeat(np.arange(len(keys)), [len(y) for y, _ in found]), np.concatenate([y for y, _ in found])
        scores = [s for _, y in found for s in y]
    else:
        of, at, scores = block.scan(x.astype(block.x.dtype), keys, queries.column("beat").to_numpy(), _in_span(x, span), k)
    ids = block.ids.take(pa.array(at))
    return pa.RecordBatch.from_arrays(
        [queries.column("key").take(pa.array(of)), queries.column("id").take(pa.array(of)), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids,
         pa.array(block.keys[at]), pa.array(scores, pa.int64())],
        names=["query", "query_id", "id", "key", "score"],
    )


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
    k: int = K, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """query_id, rank, ``id_col``, score: for every row that ``is_query`` says, its k highest scores among all other rows.

    A score is the inner product of floor(scale * x) over the components, exact, held within a long. Ties go to the smaller
    id, null ids last, then to the row read first. Vectors that are null or hold a null or non-finite component take no
    part; shorter ones count as filled up with zeros. A repeated row is a candidate, also of its twin, and a repeated
    query answers once for each row. Fewer candidates than k are all returned. No rows give no rows. Components are held
    within 2^62 either way; where squares would leave the exact range of doubles, bounds are off and scores are Python integers.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(is_finite(F.col("vec"))).select("id", "asks", integers(F.col("vec"), scale).alias("v"))
    kind = dict(rows.dtypes)["id"]
    sample = rows.select("v").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(SAMPLE).toArrow()
    size = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    width, most = max(size.width or 1, 1), size.most or 0
    exact = 4 * most * most * width < 1 << 40
    dtype = object if not exact else np.float32 if most * most * width < 1 << 24 else np.float64  # whose sums of products are exact
    many = min(math.ceil(SPAN * width), SPAN_MOST)
    chosen = _far_apart(padded_rows(sample.column(0), width), max(pivots, many)) if len(sample) else np.zeros((1, width), np.int64)
    chosen, span = chosen[:pivots], _span(chosen[:many]) if exact else None
    m = len(chosen)

    def measure(batches):
        for b in batches:
            far = _to_pivots(padded_rows(b.column(2), width), chosen)
            flat = pa.ListArray.from_arrays(np.arange(0, far.size + 1, m, dtype=np.int32), far.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, flat, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(_norms(padded_rows(b.column(2), width)))], names=[*b.schema.names, "far", "cell", "norm"])

    whole = "int" if exact else "bigint"
    table = materialize(
        rows.withColumn("key", F.monotonically_increasing_id())
        .select("id", "asks", F.col("v").cast(f"array<{whole}>"), "key")
        .mapInArrow(measure, f"id {kind}, asks boolean, v array<{whole}>, key bigint, far array<float>, cell int, norm double")
    )
    ends = [f"{f}(far[{p}]) as {f}{p}" for f in ("min", "max") for p in range(m)]
    cells = table.groupBy("cell").agg(*map(F.expr, ["count(*) as n", "count_if(asks) as asks", "max(norm) as norm", *ends])).orderBy("cell").collect()
    salts = np.zeros(m, np.int64)
    for r in cells:
        salts[r.cell] = -(-r.n // block)
    low = np.array([[r[f"min{p}"] for p in range(m)] for r in cells], np.float64).reshape(-1, m)
    high = np.array([[r[f"max{p}"] for p in range(m)] for r in cells], np.float64).reshape(-1, m)
    norm, names = np.array([r.norm for r in cells]), [r.cell for r in cells]
    groups = max(1, -(-sum(r.asks for r in cells) // block))

    home = F.pmod(F.xxhash64("key", F.lit(1)), F.element_at(F.array(*[F.lit(max(1, int(s))) for s in salts]), F.col("cell") + 1)).cast("int")
    candidates = table.select("cell", home.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("kind"), "key", "id", "v", "far", F.lit(None).cast("bigint").alias("beat"))
    group = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(groups)).cast("int")
    asked = table.filter("asks").select("cell", home.alias("salt"), group.alias("grp"), F.lit(1).alias("kind"), "key", "id", "v", "far")
    out = f"query bigint, query_id {kind}, id {kind}, key bigint, score bigint"

    def search(candidates: DataFrame, queries: DataFrame, span: np.ndarray | None) -> DataFrame:
        met = candidates.unionByName(queries.select(*candidates.columns))
        return met.repartition("cell", "salt", "grp").sortWithinPartitions("cell", "salt", "grp", "kind").mapInArrow(_searcher(width, dtype, k, span), out)

    near = materialize(search(candidates, asked.withColumn("beat", F.lit(_LEAST).cast("bigint")), None))
    to_beat = near.groupBy(F.col("query").alias("q")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asked = asked.join(to_beat, F.col("key") == F.col("q"), "left").select(*asked.columns, F.coalesce("kth", F.lit(_LEAST).cast("bigint")).alias("beat"))

    def visit(batches):
        """A row for every block but the home block that may hold a score of ``beat``."""
        for b in batches:
            far, q = padded_floats(b.column("far")).astype(np.float64), _norms(padded_rows(b.column("v"), width))
            beat = np.array(b.column("beat").to_pylist(), np.float64)
            own, salt = b.column("cell").to_numpy(), b.column("salt").to_numpy()
            for i, cell in enumerate(names):
                gap = np.maximum(np.maximum(far - high[i], low[i] - far), 0) - _ROUNDING * (far + high[i])
                gap = np.maximum(gap, 0).max(axis=1)
                may = (q + norm[i] - gap * gap) / 2 + 1 >= beat if exact else np.ones(len(q), bool)
                for s in range(int(salts[cell])):
                    at = np.flatnonzero(may & ~((own == cell) & (salt == s)))
                    t = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell, np.int32)), pa.array(np.full(len(at), s, np.int32)), *t.columns[2:]], names=b.schema.names)

    visits = asked.mapInArrow(visit, asked.schema).drop("far")
    found = near.unionByName(search(candidates.drop("far"), visits, span))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every twentieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = f"""
with kept as (
  select vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::double)) v from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))
),
scored as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score
  from kept q join kept c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored)
select query_id, rank::int rank, vec_id, score from ranked where rank <= {K}
"""
