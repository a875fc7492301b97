"""Merkle manifest of a corpus: leaves in order per source, nodes of three, a tree over the sources' roots, proofs and checks.

The node store lies on disk. Leaves are hashed where they are read, sorted once, and written as level 0. A block is what
HEIGHT levels above a node cover: tasks read the nodes of one level block by block, in order, and write those of the next
levels to folders by level, so a tree of any size takes a few rounds. Proofs are taken by coordinate from the top: each
block's nodes and the path of its own root are merged with the leaves that ask, so no row meets another one's block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop, new_path
from quillstone.session import ship

FAN = 3
#: Levels that a task builds at a time: a block holds FAN ** HEIGHT nodes of its lowest level at most.
HEIGHT = 7
DIGITS = 64


def digest(text: str) -> str:
    """Lower-case hexadecimal SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def run_of(at: int, count: int) -> tuple[int, int]:
    """First node of a node's run, and how many there are, on a level of ``count`` nodes."""
    first = at // FAN * FAN
    return first, min(FAN, count - first)


def parents(nodes: list[str]) -> list[str]:
    """The nodes above a stretch of a level that begins with a run."""
    return [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def fold(value: str, path: str, *levels: tuple[int, int]) -> str:
    """The root that a leaf and its siblings lead to; levels: place and number of leaves, of each tree on the way."""
    taken = 0
    for at, count in levels:
        while count > 1:
            first, size = run_of(at, count)
            others = [path[i : i + DIGITS] for i in range(taken, taken + (size - 1) * DIGITS, DIGITS)]
            taken += (size - 1) * DIGITS
            value = digest("".join([*others[: at - first], value, *others[at - first :]]))
            at, count = at // FAN, -(-count // FAN)
    return value


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row with this text."""
    return F.sha2(F.concat(_field(F.col("doc_id")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars")), _field(text)), 256)


def tampered() -> Column:
    """Whether a row is one of those that the check tampers with."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with rank, the place of each row in this order from 0; rows are sorted by ranges, and only row counts of ranges are added up."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = cut(sorted_rows, name).withColumn("_part", F.shiftright("_at", 33))
    # One row a range goes to this window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(bases, "_part").withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_at")


@dataclass
class Tree:
    """Rounds of a node store: how many levels each adds, the nodes each begins with, and the folder of the levels above."""

    height: int
    inputs: list[DataFrame]
    folders: list[str]

    def built(self, spark: SparkSession, r: int) -> DataFrame:
        return spark.read.schema("group long, pos long, n long, node string, last boolean, level int").parquet(self.folders[r])


def _block(levels: int | Column) -> Column:
    """The block of a node that lies so many levels below its root."""
    size = F.pow(F.lit(FAN), levels if isinstance(levels, Column) else F.lit(levels)).cast("long")
    return F.floor(F.col("pos") / size).cast("long").alias("block")


def _up(base: int, height: int):
    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        nodes = table.column("node").take(pa.array(order)).to_pylist()
        at, count, group = int(table.column("pos")[int(order[0])].as_py()), table.column("n")[0].as_py(), table.column("group")[0].as_py()
        out, k = [], 0
        while k < height and count > 1:
            nodes, at, count, k = parents(nodes), at // FAN, -(-count // FAN), k + 1
            out += [(base + k, at + i, count, x, False) for i, x in enumerate(nodes)]
        out = [*out[:-1], (base + k, at, count, nodes[0], True)]
        level, pos, n, node, last = zip(*out)
        return pa.table({"group": pa.array([group] * len(out), pa.int64()), "pos": pa.array(pos, pa.int64()), "n": pa.array(n, pa.int64()), "node": node, "last": last, "level": pa.array(level, pa.int32())})

    return build


def grow(leaves: DataFrame, path: str, height: int = HEIGHT) -> Tree:
    """Build the levels above leaves (group, pos from 0, n of the group, node); a lone leaf has none."""
    spark, tree, rows = leaves.sparkSession, Tree(height, [], []), leaves.select("group", "pos", "n", "node")
    while True:
        r = len(tree.folders)
        tree.inputs.append(rows)
        tree.folders.append(f"{path}/round={r}")
        blocks = rows.groupBy("group", _block(height))
        blocks.applyInArrow(_up(r * height, height), "group long, pos long, n long, node string, last boolean, level int").write.partitionBy("level").parquet(tree.folders[r])
        rows = tree.built(spark, r).where("last").select("group", "pos", "n", "node")
        if not rows.where("n > 1").limit(1).count():
            return tree


def tops(tree: Tree, spark: SparkSession) -> DataFrame:
    """group and root of every group."""
    return tree.built(spark, len(tree.folders) - 1).where("last").select("group", F.col("node").alias("root"))


def _paths(left: pa.Table, right: pa.Table, height: int) -> list[tuple[str, str | None]]:
    """Siblings from each asking row up to the root, and the subroot, by the nodes of its block and what lies above."""
    k, pos = right.column("k").to_numpy(), right.column("at").to_numpy()
    order = np.lexsort((pos, k))
    nodes = right.column("node").take(pa.array(order)).to_pylist()
    k, pos = k[order], pos[order]
    above, subroot = (right.column(c)[int(order[0])].as_py() for c in ("path", "subroot"))
    starts = np.searchsorted(k, np.arange(height + 1))
    known: dict[tuple[int, int, int], str] = {}

    def path(level: int, at: int, count: int) -> str:
        if level == height or count <= 1:
            return above
        held = known.get((level, at, count))
        if held is None:
            first, size = run_of(at, count)
            a = int(starts[level]) + first - int(pos[starts[level]])
            own = a + at - first
            held = known[level, at, count] = "".join(nodes[a:own] + nodes[own + 1 : a + size]) + path(level + 1, at // FAN, -(-count // FAN))
        return held

    return [(path(0, at, n), subroot) for at, n in zip(left.column("pos").to_pylist(), left.column("n").to_pylist())]


def _with_paths(left: pa.Table, right: pa.Table, height: int) -> pa.Table:
    found = _paths(left, right, height) if left.num_rows else []
    return pa.table({"group": left.column("group"), "pos": left.column("pos"), "path": pa.array([p for p, _ in found], pa.string()), "subroot": pa.array([s for _, s in found], pa.string())})


def _ask(asking: DataFrame, tree: Tree, r: int, above: DataFrame, finish, schema: str) -> DataFrame:
    """One round of proofs: asking rows meet the nodes of their blocks, and what lies above these (group, block, path, subroot)."""
    spark, height, base = asking.sparkSession, tree.height, r * tree.height
    none = F.lit(None).cast("string")
    lowest = tree.inputs[r].select("group", _block(height), F.lit(0).alias("k"), "pos", "node", none.alias("path"), none.alias("subroot"))
    inner = tree.built(spark, r).where((F.col("level") > base) & (F.col("level") < base + height)).withColumn("k", F.col("level") - base)
    inner = inner.select("group", _block(height - F.col("k")), "k", "pos", "node", none.alias("path"), none.alias("subroot"))
    roots = above.select("group", "block", F.lit(-1).alias("k"), F.lit(0).cast("long").alias("pos"), none.alias("node"), "path", "subroot")
    # Names of their own, as both sides come from the same nodes.
    right = lowest.unionByName(inner).unionByName(roots).toDF("_group", "_block", "k", "at", "node", "path", "subroot")
    return asking.withColumn("block", _block(height)).groupBy("group", "block").cogroup(right.groupBy("_group", "_block")).applyInArrow(lambda left, nodes: finish(left, nodes, height), schema)


def prove(asking: DataFrame, tree: Tree, above: DataFrame, finish=_with_paths, schema: str = "group long, pos long, path string, subroot string") -> DataFrame:
    """Rows that ask (group, pos, n and more) with the siblings on their way up; above: group, path and subroot of each group.

    Block roots ask first, from the top, so that each round finds its paths in the one before.
    """
    above = above.select("group", F.lit(0).cast("long").alias("block"), "path", "subroot")
    for r in reversed(range(1, len(tree.folders))):
        above = cut(_ask(tree.inputs[r], tree, r, above, _with_paths, "group long, pos long, path string, subroot string"), "merkle-paths").withColumnRenamed("pos", "block")
    return _ask(asking, tree, 0, above, finish, schema)


def _checks(root: str, groups: int, kind: pa.DataType):
    def finish(left: pa.Table, right: pa.Table, height: int) -> pa.Table:
        found = _paths(left, right, height) if left.num_rows else []
        ids, leaves, forged, pos, n, group = (left.column(c).to_pylist() for c in ("doc_id", "leaf", "forged", "pos", "n", "group"))
        folded = [fold(f or x, p, (at, count), (g, groups)) for f, x, at, count, g, (p, _) in zip(forged, leaves, pos, n, group, found)]
        columns = {"doc_id": pa.array(ids, kind), "leaf": leaves, "subroot": [s for _, s in found], "root": [root] * len(found), "proof_sha256": [digest(p) for p, _ in found], "folded_root": folded}
        return pa.table({c: x if c == "doc_id" else pa.array(x, pa.string()) for c, x in columns.items()} | {"verified": pa.array([x == root for x in folded], pa.bool_())})

    return finish


def report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; half the rows are tampered with.

    Null columns are hashed as such, a null source is the first of the sources and a null doc_id the first of its source;
    rows that share source and doc_id are leaves of their own, in the order of their leaves, and where these are equal too
    any order gives the same tree. A row without doc_id isn't tampered with. A source of one row has its leaf as subroot,
    and a corpus of one row as root; its proof is the hash of nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    path = new_path(spark, "merkle")
    text = F.col("text")
    leaves = docs.select("doc_id", "source", leaf_of(text).alias("leaf"), F.when(tampered(), leaf_of(F.replace(text, F.lit("\n"), F.lit("")))).alias("forged"))
    hashed = cut(leaves, "merkle-leaves")
    order = ranked(hashed.withColumn("_place", F.monotonically_increasing_id()), ["source", "doc_id", "leaf", "_place"], "merkle-order")
    sources = ranked(order.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n")), ["first"], "merkle-sources")
    sources = sources.select(F.col("source").alias("_source"), "first", "n", F.col("rank").alias("group"))
    placed = order.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "leaf", "forged", "group", (F.col("rank") - F.col("first")).alias("pos"), "n")
    rows = cut(placed, "merkle-placed")
    groups = sources.count()
    drop(hashed)
    if not groups:
        empty = {"doc_id": docs.schema["doc_id"].dataType.simpleString()} | dict.fromkeys("leaf subroot root proof_sha256 folded_root".split(), "string") | {"verified": "boolean"}
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in empty.items()))
    tree = grow(rows.withColumnRenamed("leaf", "node"), f"{path}/sources", height)
    subroots = cut(tops(tree, spark), "merkle-subroots")
    corpus = grow(subroots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("pos"), F.lit(groups).cast("long").alias("n"), F.col("root").alias("node")), f"{path}/corpus", height)
    root = tops(corpus, spark).first()["root"]
    nothing = spark.range(1).select(F.col("id").alias("group"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    # The subroots ask in the upper tree, and what they find lies above the blocks of the lower one.
    upper = prove(corpus.inputs[0], corpus, nothing).select(F.col("pos").alias("group"), "path")
    above = cut(upper.join(subroots, "group").select("group", "path", F.col("root").alias("subroot")), "merkle-above")
    kind = docs.schema["doc_id"].dataType
    shape = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return prove(rows, tree, above, _checks(root, groups, rows.select("doc_id").limit(0).toArrow().schema.field(0).type), shape)
