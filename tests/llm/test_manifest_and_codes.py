"""Brute-force versions and edge cases of the pivot search, the Merkle manifest and the vector codes."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from docloom.llm import merkle_manifest, pivot_search, vector_codes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, idx int, m int, hash string, node int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fanout):
    """The last node, and for each first node its (left, right) siblings by level."""
    paths, above = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for p, at in zip(paths, above, strict=True):
            run, own = runs[at // fanout], at % fanout
            p.append(("".join(run[:own]), "".join(run[own + 1 :])))
        nodes, above = [sha(*r) for r in runs], [a // fanout for a in above]
    return nodes[0], paths


def brute(rows, fanout):
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r[:5])))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: climb([x[2] for x in sorted(langs[lang])], fanout) for lang in order}
    root, tops = climb([trees[lang][0] for lang in order], fanout)
    for lang, top in zip(order, tops, strict=True):
        for (_, i, h), path in zip(sorted(langs[lang]), trees[lang][1], strict=True):
            out.append((lang, i, h, trees[lang][0], root, path + top))
    return out


def doc_rows():
    rows = [(i, f"s{i % 3}", ["en", "en", "de", "é", None, ""][i % 6], i * 7, f"text {i} ü") for i in range(1, 80)]
    rows += [(5, "s2", "en", 35, "text 5 ü")] * 3 + [(5, None, "en", None, None), (200, "a", "one", None, ""), (None, "a", "en", 3, "no id")]
    return [(*r, "g", 1, 2, "h", 3) for r in rows]


@pytest.mark.parametrize("fanout", [2, 3, 20])
def test_manifest_by_brute_force(spark, fanout):
    """Null and empty groups, a lone row, a null id, repeated rows and clashing column names."""
    rows = doc_rows()
    got = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(5), fanout=fanout).collect()
    key = lambda x: (str(x[0]), x[1], x[2], x[5])
    mine = sorted(((r.lang, r.doc_id or 0, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got), key=key)
    assert mine == sorted(brute(rows, fanout), key=key)


def test_manifest_folds_and_detects(spark):
    df = spark.createDataFrame(doc_rows(), DOCS)
    other = F.when(F.col("doc_id") % 2 == 0, merkle_manifest.leaf_digest(*[F.lit("x")] * 5))
    tree = merkle_manifest.manifest(df, carry={"other": other})
    seen = tree.select("doc_id", "root", merkle_manifest.fold(F.coalesce("other", "leaf"), F.col("proof")).alias("folded"), merkle_manifest.siblings(F.col("proof")).alias("s"), "proof").collect()
    for r in seen:
        assert (r.folded == r.root) == (r.doc_id is None or r.doc_id % 2 == 1)
        assert r.s == "".join(a + b for a, b in r.proof)


def test_manifest_of_little(spark):
    df = spark.createDataFrame(doc_rows(), DOCS)
    assert merkle_manifest.manifest(df.limit(0)).count() == 0
    one = merkle_manifest.manifest(df.filter("doc_id = 200")).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    long = spark.createDataFrame([(1, "s", "en", 9, "wö " * 400_000)], "doc_id int, source string, lang string, n_chars int, text string")
    assert merkle_manifest.manifest(long).first().root == leaf((1, "s", "en", 9, "wö " * 400_000))
    with pytest.raises(ValueError):
        merkle_manifest.manifest(df, fanout=1)


def test_op12_marks_raised_rows(spark):
    for r in merkle_manifest.op12_merkle_manifest(spark, SF).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) and (r.folded_root == r.root) == r.verified


def vectors(spark, scale=1.0):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)) * scale
    x[40:90] = x[40]  # copies
    x[100:140] = np.round(x[100:140])
    rows = [(i, [float(v) for v in y], i % 4 or None, "far", 0) for i, y in enumerate(x)]
    rows += [(20, rows[20][1], 1, "far", 0), (20, rows[21][1], 1, "far", 0), (None, rows[3][1], 2, "far", 0), (500, [0.0] * 16, 2, "", 0), (520, [1.5, -2.5], 3, "", 0)]
    rows += [(540, None, 1, "", 0), (560, [1.0, None], 1, "", 0), (580, [float("nan")] * 16, 1, "", 0), (600, [float("inf"), 1.0], 1, "", 0), (620, [], 1, "", 0)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, far string, cell int").repartition(3)


def whole(rows, factor):
    """The rows that take part, as whole numbers filled up with zeros."""
    fine = [(r[0], [math.floor(factor * v) for v in r[1]], r[2]) for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    return [(i, [*v, *[0] * (16 - len(v))], label) for i, v, label in fine]


@pytest.mark.parametrize("scale,block,pivots", [(1.0, 16_384, 32), (1.0, 16, 5), (1e12, 50, 8), (1e6, 50, 8)])
def test_pivot_search_by_brute_force(spark, scale, block, pivots):
    """Ties, copies, repeated ids, a null id, short, empty and zero vectors; blocks that split cells; numbers beyond doubles."""
    rows, df = vectors(spark, scale)
    kept = whole(rows, 64)
    want = []
    for a, (i, q, _) in enumerate(kept):
        if i is not None and i % 20 == 0:
            found = sorted((-max(-(1 << 63), min(sum(x * y for x, y in zip(q, c, strict=True)), (1 << 63) - 1)), j is None, j or 0) for b, (j, c, _) in enumerate(kept) if b != a)
            want += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(found[:20])]
    got = pivot_search.top_k(df, F.col("vec_id") % 20 == 0, block=block, pivots=pivots).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_pivot_search_of_little(spark):
    _, df = vectors(spark)
    asks = F.col("vec_id") % 20 == 0
    assert pivot_search.top_k(df.limit(0), asks).count() == 0
    assert pivot_search.top_k(df.filter("vec_id = 40"), asks).count() == 0
    few = pivot_search.top_k(df.filter("vec_id between 40 and 43"), asks, k=2).collect()
    assert [tuple(r)[:3] for r in few] == [(40, 1, 41), (40, 2, 42)]
    assert pivot_search.top_k(df.filter("vec_id in (500, 620)"), asks).count() == 2


def test_pivot_bounds_hold_and_rule_out():
    """No bound is below its score, and clustered vectors let whole groups be skipped."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-9, 9, (60, 12)) + c * 40 for c in rng.integers(-9, 9, (6, 12))])
    far = pivot_search._to_pivots(x, pivot_search._far_apart(x, 12)).astype(np.float32)
    block = pivot_search._Block.__new__(pivot_search._Block)
    block.x, block.norms, block.far, block.keys, block.exact = x.astype(float), pivot_search._norms(x), far, np.arange(len(x)), True
    bound, score = block.bounds(block.norms, far), x @ x.T
    assert (bound >= score).all()
    assert (bound < np.sort(score, axis=1)[:, -5:-4]).mean() > 0.5


@pytest.mark.parametrize("scale,block", [(1.0, 40), (300.0, 16), (300.0, 40)])
def test_pivot_search_across_blocks(spark, scale, block):
    """Blocks with and without a score to beat, in single and in double precision."""
    test_pivot_search_by_brute_force(spark, scale, block, 5)


def test_pivot_span_rules_out_without_clusters():
    """Pivots one by one rule out little here; their span leaves few pairs, and all that reach the score to beat."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    x[95:125] = x[95]
    chosen = pivot_search._far_apart(x[1000:2000], 56)
    span, far = pivot_search._span(chosen), pivot_search._to_pivots(x, chosen[:32]).astype(np.float32)
    table = pa.table({"id": np.arange(3000), "key": np.arange(3000), "v": list(x), "far": list(far)})
    alone, block = (pivot_search._Block(table, 64, np.float32, s) for s in (None, span))
    q, score = x[:100], x[:100] @ x.T
    beats = np.sort(score, axis=1)[:, -20]
    left = block.open(pivot_search._in_span(q, span), beats)
    assert (left | (score < beats[:, None])).all() and left.mean() < 0.15
    assert (alone.bounds(alone.norms[:100], far[:100]) >= beats[:, None]).mean() > 0.9
    flat = pivot_search._in_span(q, span)
    for n, dense in ((20, True), (1, False)):  # by one matrix product and pair by pair
        beats = np.sort(score, axis=1)[:, -n]
        assert (block.open(flat, beats).mean() >= pivot_search._DENSE) == dense
        of, at, found = block.scan(q.astype(np.float32), np.where(np.arange(100) < 90, -1, np.arange(100)), beats, flat, 20)
        for i in range(100):
            best = [j for j in sorted(range(3000), key=lambda j: (-score[i, j], j)) if score[i, j] >= beats[i] and (i < 90 or i != j)][:20]  # noqa: B023
            assert sorted(at[of == i].tolist()) == sorted(best) and (found[of == i] == score[i, at[of == i]]).all()


def test_walsh_is_by_sign_changes_and_keeps_distances():
    h = vector_codes.walsh(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in h] == list(range(8))
    rng = np.random.default_rng(1)
    a, b = rng.integers(-99, 99, (2, 50, 6))
    assert (((vector_codes.walsh(a) - vector_codes.walsh(b)) ** 2).sum(axis=1) == 8 * ((a - b) ** 2).sum(axis=1)).all()


@pytest.mark.parametrize("most", [3, 1000, 1 << 61])
@pytest.mark.parametrize("width", [1, 3, 4, 7])
def test_nearest_entry(most, width):
    rng = np.random.default_rng(width)
    x, e = rng.integers(-most, most, (200, width)), rng.integers(-most, most, (20, width))
    e[7] = e[3]
    x[:9] = e[3]
    d = ((x[:, None].astype(object) - e[None]) ** 2).sum(axis=2)
    at, error = vector_codes.nearest(x, e)
    assert at.tolist() == [list(r).index(min(r)) for r in d.tolist()] and [int(v) for v in error] == [min(r) for r in d.tolist()]
    assert len(vector_codes.nearest(x[:0], e)[0]) == 0


def codes_by_hand(rows, factor, parts, entries, rounds):
    kept = whole(rows, factor)
    w = 16 // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in kept:
                own.setdefault(near(cut(r[1], p), books[p])[1], []).append(cut(r[1], p))
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])]
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in found), (1 << 63) - 1)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
        sums[label] = min(sums.get(label, 0) + error, (1 << 63) - 1)
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return [(i, c, e, sums[label], digest) for i, c, e, label in out]


@pytest.mark.parametrize("scale,parts,entries", [(1.0, 4, 64), (1e9, 2, 9)])
def test_codes_by_brute_force(spark, scale, parts, entries):
    """Repeated and null ids, null labels, short, empty and zero vectors; sums beyond a long."""
    rows, df = vectors(spark, scale)
    got = vector_codes.compress(df, parts=parts, entries=entries).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    # repeated ids may be seeds: the tie goes to the smaller vector in both
    assert sorted((tuple(r) for r in got), key=key) == sorted(codes_by_hand(rows, 256, parts, entries, 2), key=key)


def test_codes_of_little(spark):
    rows, df = vectors(spark)
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.filter("vec_id = 540")).count() == 0
    one = vector_codes.compress(df.filter("vec_id = 3")).collect()  # and nothing else of that id
    assert [(r.code, r.error) for r in one] == [("00" * 16, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=300)


def test_codes_decode(spark):
    """What a code stands for is as far away as its error says."""
    _, df = vectors(spark)
    x = vector_codes.integer_vectors(df, "vec_id", "embedding", "label", 256)
    books = vector_codes.fit_codebooks(x, parts=4)
    back = books.decode(vector_codes.encode(x, books).withColumn("none", F.lit(None).cast("string")))
    both = back.select("id", "error", "decoded").join(x.select("id", "v"), "id").filter("id not in (20) and id is not null").collect()
    assert len(both) > 300
    for r in both:
        v = [*r.v, *[0] * (16 - len(r.v))]
        assert sum((a - b) ** 2 for a, b in zip(v, r.decoded, strict=True)) == r.error
    assert books.decode(back.drop("decoded"), "none").filter("decoded is not null").count() == 0
