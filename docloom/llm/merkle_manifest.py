"""Merkle manifest of a dataset: a digest for every row, a tree for every group, one root, a proof for every row.

A tree is built by pivots. One aggregate spreads the nodes below a common ancestor into slot columns (conditional
maxima), two to sixteen of them; their digests up to that ancestor are column expressions on the wide row. On the
way down the wide row gives each slot its siblings, which are the columns of its run but its own. So a tree over n
rows takes about log16(n) aggregates and as many joins, of n / 16, n / 256, ... rows, and no key is hot: the place of a
row in its group comes from a range partitioning and one prefix sum over the partitions' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Most slot columns of one aggregate. A larger fanout takes one level at a time.
SLOTS = 16
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated; null parts count as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within the group (from 0, nulls first), and ``m``, the rows of the group.

    Rows equal in group and order take their places in the order in which they are read."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [group, *order, "tie"]]
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("part").alias("p"), F.col(group).alias("g"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("m"))
    joined = placed.join(runs, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return joined.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "p", "g", "first", "before")


def _joined(columns: list[str]) -> str:
    return ", ".join(["''", *[f"coalesce({c}, '')" for c in columns]])


class _Tree:
    """Trees over ``nodes`` (grp, idx, m, hash and a struct ``node``), one for each group."""

    def __init__(self, nodes: DataFrame, fanout: int) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.fanout, self.levels = fanout, 1
        while fanout ** (self.levels + 1) <= SLOTS:
            self.levels += 1
        self.width = fanout**self.levels
        self.wides: list[DataFrame] = []
        most = nodes.agg(F.max("m")).first()[0] or 0
        while most > 1 or not self.wides:
            wide = materialize(self._pivot(nodes))
            self.wides.append(wide)
            above = F.expr(f"(m + {self.width - 1}) div {self.width}").alias("m")
            nodes = wide.select("grp", F.col("up").alias("idx"), above, F.col(f"h{self.levels}_0").alias("hash"), F.lit(None).cast("struct<x:int>").alias("node"))
            most = -(-most // self.width)
        self.roots = nodes.select("grp", "hash")

    def _pivot(self, nodes: DataFrame) -> DataFrame:
        """A row for every ``width`` consecutive nodes: slots n0, n1, ... and digests h<level>_<slot>."""
        f = self.fanout
        spread = [f"max(case when idx % {self.width} = {j} then {c} end) as {name}{j}" for j in range(self.width) for c, name in (("hash", "h0_"), ("node", "n"))]
        wide = nodes.groupBy("grp", "m", F.expr(f"idx div {self.width}").alias("up")).agg(*map(F.expr, spread))
        for level in range(self.levels):
            runs = [[f"h{level}_{j * f + i}" for i in range(f)] for j in range(self.width // f ** (level + 1))]
            parents = [f"if(m > {f**level} and {run[0]} is not null, sha2(concat({_joined(run)}), 256), {run[0]}) as h{level + 1}_{j}" for j, run in enumerate(runs)]
            wide = wide.selectExpr("*", *parents)
        return wide

    def _steps(self, slot: int) -> str:
        """The siblings of one slot on each level of a wide row; no step where its group has one node only."""
        f, steps = self.fanout, []
        for level in range(self.levels):
            own = slot // f**level
            run = [f"h{level}_{own // f * f + i}" for i in range(f)]
            step = f"named_struct('left', concat({_joined(run[: own % f])}), 'right', concat({_joined(run[own % f + 1 :])}))"
            steps.append(f"if(m > {f**level}, array({step}), cast(array() as {_STEP}))")
        return f"concat({', '.join(steps)})"

    def proofs(self, tops: DataFrame) -> DataFrame:
        """grp, hash and node of every first node, with its path and the other columns of ``tops`` (grp, path, ...)."""
        more = [c for c in tops.columns if c not in ("grp", "path")]
        above = tops.select("grp", F.lit(0).cast("bigint").alias("idx"), "path", *more)
        slots = [f"named_struct('slot', {j}, 'hash', h0_{j}, 'node', n{j}, 'steps', {self._steps(j)})" for j in range(self.width)]
        for wide in reversed(self.wides):
            here = wide.selectExpr("grp as g", "up", f"array({', '.join(slots)}) as slots")
            met = above.join(here, F.col("grp").eqNullSafe(F.col("g")) & (F.col("idx") == F.col("up")))
            out = met.select("grp", "up", "path", *more, F.explode("slots").alias("s")).filter("s.hash is not null")
            idx = (F.col("up") * self.width + F.col("s.slot")).alias("idx")
            above = out.select("grp", idx, "s.hash", "s.node", F.concat("s.steps", "path").alias("path"), *more)
        return above.drop("idx")


def manifest(
    rows: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", order_col: str = "doc_id", fanout: int = 2, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row: order_col, group_col, the columns of ``carry``, leaf, subroot, root and proof.

    A leaf is ``leaf_digest`` of the fields. In each group the leaves ascend by ``order_col`` (nulls first; equal ones by
    leaf, then in the order read, which matters to nobody as they are the same). While a group has several nodes, every
    ``fanout`` consecutive ones, of the last run fewer, become the digest of their digests; the last node, which may be a
    lone leaf, is the subroot. The subroots, by group (null first, as bytes), give the root in the same way. ``proof``
    has a step for every level from the leaf to the root: the digests left and right of the own node within its run, as
    one text each, both empty where it is alone. ``fold`` and ``siblings`` read it. Repeated rows are leaves of their own;
    other columns play no part; no rows give no rows. ``carry``: further values to keep for each row, such as another
    leaf to try. They and ``order_col`` need a type that can be ordered.
    """
    carry = {k: v.alias(f"k{i}") for i, (k, v) in enumerate((carry or {}).items())}
    leaves = rows.select(F.col(group_col).alias("grp"), F.col(order_col).alias("id"), leaf_digest(*[F.col(c) for c in fields]).alias("hash"), *carry.values())
    placed = places(materialize(leaves), "grp", ["id", "hash"])
    kept = F.struct("id", *[f"k{i}" for i in range(len(carry))])
    groups = _Tree(placed.select("grp", "idx", "m", "hash", kept.alias("node")), fanout)

    subroots = groups.roots.select(F.lit(0).alias("all"), F.col("grp").alias("id"), "hash")
    placed = places(subroots, "all", ["id"])
    whole = _Tree(placed.select(F.col("all").alias("grp"), "idx", "m", "hash", F.struct("id").alias("node")), fanout)
    top = whole.roots.select("grp", F.array().cast(_STEP).alias("path"), F.col("hash").alias("root"))
    tops = whole.proofs(top).select(F.col("node.id").alias("grp"), "path", F.col("hash").alias("subroot"), "root")

    proved = groups.proofs(tops)
    named = [F.col(f"node.k{i}").alias(k) for i, k in enumerate(carry)]
    return proved.select(F.col("node.id").alias(order_col), F.col("grp").alias(group_col), *named, F.col("hash").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what each proof says of a row whose n_chars may have been raised by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    raised = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    tree = manifest(docs, carry={"tampered": F.when(wrong, leaf_digest(*raised.values()))})
    folded = tree.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


ORACLE_SQL = f"""
with recursive
leaves as (
  select doc_id, lang, {_leaf("n_chars")} leaf, {_leaf("(n_chars::hugeint + 1)")} raised,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) crc
  from documents
),
tree as (
  select lang g, 0 lvl, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 idx, leaf h, count(*) over (partition by lang) m,
    doc_id, case when xor(crc, 4294967295) % 7 = 0 then raised end raised
  from leaves
  union all
  select g, lvl + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (any_value(m) + 1) // 2, null, null from tree where m > 1 group by g, lvl, idx // 2
),
top as (
  select g, 0 lvl, row_number() over (order by g nulls first) - 1 idx, h, count(*) over () m from tree where m = 1
  union all
  select null, lvl + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (any_value(m) + 1) // 2 from top where m > 1 group by lvl, idx // 2
),
climb as (
  select g, lvl, idx, m, doc_id, h leaf, coalesce(raised, h) node, '' proof from tree where lvl = 0
  union all
  select c.g, c.lvl + 1, c.idx // 2, (c.m + 1) // 2, c.doc_id, c.leaf,
    sha256(case when c.idx % 2 = 0 then c.node || coalesce(s.h, '') else s.h || c.node end), c.proof || coalesce(s.h, '')
  from climb c left join tree s on s.g is not distinct from c.g and s.lvl = c.lvl and s.idx = xor(c.idx, 1) where c.m > 1
),
last as (
  select t.lvl, t.idx, t.m, c.doc_id, c.leaf, t.h subroot, c.node, c.proof
  from climb c join top t on t.lvl = 0 and t.g is not distinct from c.g where c.m = 1
  union all
  select c.lvl + 1, c.idx // 2, (c.m + 1) // 2, c.doc_id, c.leaf, c.subroot,
    sha256(case when c.idx % 2 = 0 then c.node || coalesce(s.h, '') else s.h || c.node end), c.proof || coalesce(s.h, '')
  from last c left join top s on s.lvl = c.lvl and s.idx = xor(c.idx, 1) where c.m > 1
)
select l.doc_id, l.leaf, l.subroot, r.h root, sha256(l.proof) proof_sha256, l.node folded_root, l.node = r.h verified
from last l join top r on r.m = 1 where l.m = 1
"""
