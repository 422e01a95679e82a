"""A Merkle manifest of a table: a tree for each partition value, and one over their roots.

Every row is a leaf.  A tree's leaves stand in order and are dealt into aligned blocks of
2**HEIGHT; a block's nodes are one array in van Emde Boas order: the block's tree is cut at half its
height, the upper part is stored first, each of the lower parts after it, all by the same
rule.  The place of a node follows from its level and number by arithmetic that knows no
cache or page size (``Layout``); the same arithmetic fills a block and finds a leaf's siblings in it.
The roots of blocks are the leaves of the next table of blocks, until one block is left.  Proofs go
the other way: a block hands the siblings of its own root down to its leaves.

A node is the lower-case hexadecimal SHA-256 of its one or two children's digests; of an odd
number of nodes the last has one child.  Null fields are leaves' ``-``; leaves with a null id
come before all others, equal ids follow their leaves' digests, and repeated rows take one place each.  A table
without rows has no tree and gives no rows; texts may be of any length; other columns are allowed and no part of a leaf.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import Work

#: Levels of a block above its leaves.
HEIGHT = 12
#: Rows of one sorted run, about, when leaves are numbered.
RUN = 250_000
#: Files of a table of numbered rows: one for so many rows, but up to ``FILES`` in any case.
FILE_ROWS, FILES = 1 << 14, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof's step: the sibling's digest (null: the node has none) and whether it stands left.
STEP = "struct<left: boolean, digest: string>"


class Layout:
    """Places of the nodes of a complete tree of ``height`` levels above its leaves, in van Emde Boas order."""

    def __init__(self, height: int):
        self.height = height
        #: For each depth: where the upper part that ends above it starts, that part's size, and the size of a lower part.
        self.top_depth, self.top, self.bottom = [0] * (height + 1), [0] * (height + 1), [0] * (height + 1)
        self._cut(0, height)
        self.places = [np.zeros(1, np.int64)]
        for d in range(1, height + 1):
            number = np.arange(1 << d)
            up = self.places[self.top_depth[d]][number >> (d - self.top_depth[d])]
            self.places.append(up + self.top[d] + (number & self.top[d]) * self.bottom[d])

    def _cut(self, depth: int, height: int) -> None:
        """The tree of ``height`` whose root is at ``depth``: its lower parts start below its upper half."""
        if height == 0:
            return
        upper = (height - 1) // 2  # levels of the upper part above its leaves
        below = depth + upper + 1
        lower = height - upper - 1
        self.top_depth[below], self.top[below], self.bottom[below] = depth, (1 << (upper + 1)) - 1, (1 << (lower + 1)) - 1
        self._cut(depth, upper)
        self._cut(below, lower)

    def place(self, level: int, number):
        """The place of a node, counted from the leaves' level 0."""
        return self.places[self.height - level][number]


@cache
def layout(height: int) -> Layout:
    return Layout(height)


def _height(n: int, most: int) -> int:
    """Levels of the blocks of a tree with ``n`` leaves: all of them, or as many as lead to one node."""
    return most if n > 1 << most else (n - 1).bit_length()


def _sha(s: bytes) -> bytes:
    return hashlib.sha256(s).hexdigest().encode()


def _block(digests: list[bytes], height: int) -> list[bytes]:
    """All nodes of a block at their places; places without a node are empty."""
    at, out = layout(height), [b""] * ((2 << height) - 1)
    level = digests
    for k in range(height + 1):
        for where, digest in zip(at.place(k, np.arange(len(level))).tolist(), level, strict=True):
            out[where] = digest
        if k < height:
            level = [_sha(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return out


def _filled(most: int):
    def run(t: pa.Table) -> pa.Table:
        """The array of one block from its leaves ``pos, digest``."""
        t = t.sort_by("pos")
        height = _height(t.column("n")[0].as_py(), most)
        nodes = _block([d.encode() for d in t.column("digest").to_pylist()], height)
        return pa.table({"tree": t.column("tree")[:1], "block": t.column("block")[:1], "n": t.column("n")[:1], "nodes": pa.array([b"".join(d or b"-" * 64 for d in nodes)], pa.binary()), "root": pa.array([nodes[0].decode()], pa.string())})

    return run


def _siblings(nodes: bytes, height: int, number: int) -> list[dict]:
    """The steps from a block's leaf to its root."""
    at, out = layout(height), []
    for k in range(height):
        beside = int(at.place(k, number ^ 1))
        digest = nodes[64 * beside : 64 * beside + 64]
        out.append({"left": bool(number & 1), "digest": None if digest[:1] == b"-" else digest.decode()})
        number >>= 1
    return out


def _proved(most: int):
    def run(leaves: pa.Table, block: pa.Table) -> pa.Table:
        """Each leaf's steps within its block, then those of the block's root."""
        nodes, above = block.column("nodes")[0].as_py(), block.column("above")[0].as_py()
        height = _height(block.column("n")[0].as_py(), most)
        found = [_siblings(nodes, height, p & ((1 << most) - 1)) + above for p in leaves.column("pos").to_pylist()]
        steps = pa.array(found, pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())])))
        return leaves.drop_columns(["block"]).append_column("steps", steps)

    return run


def field(c: str) -> Column:
    """A leaf's part of one column: its UTF-8 length and value."""
    v = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def numbered(rows: DataFrame, tree: str, keys: list[str], work: Work) -> DataFrame:
    """Adds ``pos`` (from 0, in the order of ``keys`` within a tree) and ``n``, the tree's rows; equal rows take one place each.

    Distinct rows are dealt by ranges of their keys; a row's place is its place in its range
    plus what lies in the ranges before.  Both are stored, in files whose number follows the rows and not the
    shuffle partitions: each file that a task writes to a local folder starts processes, which the executor waits for.
    """
    columns, total = rows.columns, rows.count()
    order = [F.col(c).asc_nulls_first() for c in keys]
    distinct = rows.groupBy(*columns).agg(F.count("*").alias("_c"))
    ranged = distinct.repartitionByRange(max(1, -(-total // RUN)), F.col(tree), *order).withColumn("_part", F.spark_partition_id())
    inside = W.partitionBy(tree, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.withColumn("_own", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    ranged = work.save(ranged.coalesce(max(FILES, total // FILE_ROWS)))
    sizes = ranged.groupBy(tree, "_part").agg(F.sum("_c").alias("_size"))
    before = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = work.save(sizes.select(tree, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(W.partitionBy(tree)).alias("n")).coalesce(FILES))
    first = F.col("_before") + F.col("_own")
    return ranged.join(sizes, [tree, "_part"]).withColumn("pos", F.explode(F.sequence(first, first + F.col("_c") - 1))).select(*columns, "pos", "n")


class Manifest:
    """The blocks of a forest: ``levels[k]`` has ``tree, block, n, nodes, root``; ``roots`` each tree's ``tree, n, root``."""

    def __init__(self, leaves: DataFrame, work: Work, height: int = HEIGHT):
        """``leaves``: ``tree, pos, n, digest``, which are read more than once."""
        self.height, self.work, self.levels = height, work, []
        nodes = leaves.select("tree", "pos", "n", "digest")
        most = leaves.agg(F.max("n")).first()[0] or 0
        while True:
            dealt = nodes.withColumn("block", F.shiftright("pos", height))
            blocks = work.save(dealt.groupBy("tree", "block").applyInArrow(_filled(height), "tree string, block bigint, n bigint, nodes binary, root string"))
            self.levels.append(blocks)
            if most <= 1 << height:
                break
            most = -(-most // (1 << height))
            nodes = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << height)).alias("n"), F.col("root").alias("digest"))
        self.roots = blocks.select("tree", "root")

    def proofs(self, leaves: DataFrame, above: DataFrame | None = None) -> DataFrame:
        """Adds ``steps`` to ``leaves`` (``tree``, ``pos`` and others): the siblings up to the tree's root, then those of ``above (tree, above)``."""
        nothing = F.array().cast(f"array<{STEP}>")
        up = self.levels[-1].select("tree", "block")
        up = up.join(above, "tree", "left").select("tree", "block", F.coalesce("above", nothing).alias("above")) if above is not None else up.withColumn("above", nothing)
        for k in range(len(self.levels) - 1, -1, -1):
            children = self.levels[k - 1].select("tree", F.col("block").alias("pos")) if k else leaves
            children = children.withColumn("block", F.shiftright("pos", self.height))
            blocks = self.levels[k].join(up, ["tree", "block"]).select("tree", "block", "n", "nodes", "above")
            schema = ", ".join(f"`{c}` {t}" for c, t in children.dtypes if c != "block") + f", steps array<{STEP}>"
            found = children.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_proved(self.height), schema)
            up = self.work.save(found.select("tree", F.col("pos").alias("block"), F.col("steps").alias("above"))) if k else found
        return up


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    beside = lambda a, s: F.when(s["digest"].isNull(), a).when(s["left"], F.concat(s["digest"], a)).otherwise(F.concat(a, s["digest"]))
    return F.aggregate(steps, leaf, lambda a, s: F.sha2(beside(a, s).cast("binary"), 256))


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id", tampered: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, steps, folded_root, verified`` for every row.

    ``tampered`` replaces fields by other values in the leaf that is folded, as a change made
    after the manifest would.
    """
    work = Work(df.sparkSession)
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree)), F.lit("0"))  # null first, then by bytes
    other = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) if (v := (tampered or {}).get(c)) is not None else field(c) for c in fields]
    rows = df.select(name.alias("tree"), F.col(doc_id).alias("doc_id"), digest([field(c) for c in fields]).alias("digest"), digest(other).alias("changed"))
    leaves = numbered(rows, "tree", ["doc_id", "digest"], work)
    each = Manifest(leaves, work, height)
    tops = each.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    tops = numbered(tops, "tree", ["name"], work)
    whole = Manifest(tops, work, height)
    above = work.save(whole.proofs(tops).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("above")))
    found = each.proofs(leaves.select("tree", "pos", "doc_id", "digest", "changed"), above.select("tree", "above"))
    root = whole.roots.select("root")  # one row
    found = found.join(F.broadcast(above.select("tree", "subroot")) if above.count() <= 100_000 else above.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))
    found = found.withColumn("folded_root", folded(F.col("changed"), F.col("steps")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of a proof's siblings, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["digest"]), "").cast("binary"), 256)
