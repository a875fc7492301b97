"""SimHash near-duplicates: pivot distance tables over pigeonhole blocks, verified by exact Hamming distance.

Prints that may be near meet under keys of agreeing blocks. In each such group a few prints serve as references: the
distances of all others to them are the group's table, and those within the limit are linked there and then. What is left
are pairs of different components; of these the fixed pivots' table discards those that differ too much in a coordinate,
and the rest are verified. So a dense group is never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm import textkit as K
from quillstone.llm.common import cut, texts
from quillstone.llm.components import components
from quillstone.session import ship

WIDTH = 4
SEED = 42
DISTANCE = 4
#: Prints of a group that the others are measured to: the least and the greatest, by value and by hash.
REFERENCES = 4
#: Seven distances fit a signed long, a byte each; two longs hold the table row of a fingerprint.
PIVOTS_PER_LONG = 7
PIVOT_LONGS = 2
PIVOTS = K.mix(np.arange(1, PIVOTS_PER_LONG * PIVOT_LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signed 64-bit fingerprints of consecutive groups of shingle hashes."""
    out = np.zeros(len(counts), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.concatenate([[0], np.cumsum(counts)])[full]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        over = 2 * ones > counts[full][:, None]
        out[full] = np.packbits(over, axis=1).reshape(-1).view(">u8").astype(np.uint64).view(np.int64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for first, rows, data, offsets in K.slices(batch.column("text")):
            data = K.LOWER[data]
            starts, ends, ranges = K.word_bounds(data, offsets, K.NON_SPACE)
            flat, at = K.spaced(data, starts, ends)
            flat, at, ranges = flat.tobytes(), at.tolist(), ranges.tolist()
            hashes: list[int] = []
            counts = np.zeros(rows, np.int64)
            for d in range(rows):
                a, n = ranges[d], ranges[d + 1] - ranges[d]
                if n:
                    width = min(WIDTH, n)
                    counts[d] = n - width + 1
                    hashes.extend([digest(flat[at[i] : at[i + width] - 1], SEED) for i in range(a, a + n - width + 1)])
            prints = _majority(np.array(hashes, np.uint64), counts)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, rows) for c in names), pa.array(prints)], [*names, "print"])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, more and print (long) of every whole text; a text without words, or null, has print 0."""
    ship(docs.sparkSession)
    held = texts(docs, *more)
    return held.mapInArrow(_fingerprint_batches, T.StructType([*(f for f in held.schema if f.name != "text"), T.StructField("print", T.LongType())]))


def block_plan(n: int, distance: int = DISTANCE) -> list[int]:
    """Widths of the blocks: the fewest whose keys leave about four chance candidates a fingerprint at most."""
    for blocks in range(distance + 2, 17):
        bits = 64 * (blocks - distance) // blocks
        if comb(blocks, distance) * n <= 4 * 2**bits:
            break
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _pivot_rows(print_: Column) -> list[Column]:
    """The pivot distance table: seven Hamming distances to a long."""
    out = []
    for k in range(PIVOT_LONGS):
        own = PIVOTS[k * PIVOTS_PER_LONG : (k + 1) * PIVOTS_PER_LONG]
        parts = [F.shiftleft(F.bit_count(print_.bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(own)]
        out.append(reduce(lambda x, y: x.bitwiseOR(y), parts).alias(f"pivots{k}"))
    return out


def _within(x: Column, y: Column, distance: int) -> Column:
    """True if all seven coordinates differ by the distance at most: byte-wise arithmetic that cannot carry."""
    every = sum(1 << (8 * i) for i in range(PIVOTS_PER_LONG))
    high, low = F.lit(0x80 * every), F.lit(0x7F * every)
    moved = x.bitwiseOR(high) - y + F.lit(distance * every)
    return (moved.bitwiseAND(high) == high) & ((moved.bitwiseAND(low) + F.lit((0x7F - 2 * distance) * every)).bitwiseAND(high) == 0)


def _met(prints: DataFrame, n: int, distance: int) -> tuple[DataFrame, list[int]]:
    """The columns of prints with combo, key and differ, a row for each key; and the masks of the blocks.

    Two prints at the distance or less agree on all but ``distance`` blocks, so they meet under a key of that many agreeing
    blocks; differ has a bit for each block that the first such key of a pair leaves out.
    """
    widths = block_plan(n, distance)
    masks, at = [], 0
    for w in widths:
        masks.append(_signed(((1 << w) - 1) << at))
        at += w
    keys = []
    for i, chosen in enumerate(combinations(range(len(widths)), len(widths) - distance)):
        mask = reduce(lambda x, y: x | y, (masks[b] for b in chosen))
        differ = sum(1 << b for b in range(chosen[-1]) if b not in chosen)
        keys.append((i, mask, differ))
    spread = F.inline(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("print").bitwiseAND(F.lit(m)).alias("key"), F.lit(d).alias("differ")) for i, m, d in keys]))
    return prints.select("*", spread), masks


def _sorted(df: DataFrame) -> DataFrame:
    """df as a side that joins by sorting: rows grow with the prints, and with their keys, of which the size of a file says nothing."""
    return df.hint("merge")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def references(prints: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of prints and the references of their groups at the distance or less: at most REFERENCES rows a print and key."""
    met, _ = _met(prints.select("print"), n, distance)
    by_hash = F.struct(F.xxhash64("print").alias("h"), "print")
    chosen = met.groupBy("combo", "key").agg(F.min("print").alias("r0"), F.max("print").alias("r1"), F.min(by_hash)["print"].alias("r2"), F.max(by_hash)["print"].alias("r3")).where("r0 < r1")
    rows = met.select("print", "combo", "key").join(_sorted(chosen), ["combo", "key"])
    table = rows.select("print", F.explode(F.array_distinct(F.array(*(f"r{k}" for k in range(REFERENCES))))).alias("r"))
    return table.where((F.col("print") != F.col("r")) & (_apart(F.col("print"), F.col("r")) <= distance)).select(F.least("print", "r").alias("a"), F.greatest("print", "r").alias("b"))


def crossings(named: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: the different roots of named (print, root, size) between which two prints are at the distance or less.

    In each group the root of the most prints stands aside, as every pair across roots has another one, and groups with
    one root alone go. A pair counts under the first key it meets by, if its rows of the pivot table are near.
    """
    met, masks = _met(named.select("print", "root", "size", *_pivot_rows(F.col("print"))), n, distance)
    main = F.max(F.struct("size", "root"))["root"].alias("main")
    mixed = met.groupBy("combo", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), main).where("lo < hi").select("combo", "key", "main")
    held = met.drop("size").join(_sorted(mixed), ["combo", "key"])
    x, y = held.where("root != main").alias("x"), held.alias("y")
    apart = F.col("x.print").bitwiseXOR(F.col("y.print"))
    first = reduce(lambda p, q: p & q, [(F.col("x.differ").bitwiseAND(F.lit(1 << b)) == 0) | (apart.bitwiseAND(F.lit(m)) != 0) for b, m in enumerate(masks)])
    near = reduce(lambda p, q: p & q, [_within(F.col(f"x.pivots{k}"), F.col(f"y.pivots{k}"), distance) for k in range(PIVOT_LONGS)])
    once = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.print") < F.col("y.print")))
    pairs = x.join(_sorted(y), (F.col("x.combo") == F.col("y.combo")) & (F.col("x.key") == F.col("y.key")) & once & near & (F.bit_count(apart) <= distance) & first)
    return pairs.select(F.least("x.root", "y.root").alias("a"), F.greatest("x.root", "y.root").alias("b")).distinct()


def roots(prints: DataFrame, distance: int = DISTANCE, n: int | None = None) -> DataFrame:
    """print and root of distinct prints: the smallest print that links of the distance or less lead to, its own included."""
    n = prints.count() if n is None else n
    linked = components(references(prints, n, distance), "a", "b", "simhash").withColumnRenamed("node", "print")
    whole = linked.groupBy("root").agg(F.count("*").alias("size"))
    named = prints.join(_sorted(linked.join(_sorted(whole), "root")), "print", "left").select("print", F.coalesce("root", "print").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    named = cut(named, "simhash-named")
    across = components(crossings(named, n, distance), "a", "b", "simhash-across").withColumnsRenamed({"node": "_node", "root": "_root"})
    return named.join(_sorted(across), F.col("root") == F.col("_node"), "left").select("print", F.coalesce("_root", "root").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Equal fingerprints form a class; only classes are compared, so copies are never paired with each other. Null or
    wordless texts have fingerprint zero and link like any other; repeated rows fall into one class; a null doc_id
    never becomes a component_id unless no document of its component has an id; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs), "simhash-prints")
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-classes")
    named = cut(classes.join(_sorted(roots(classes.select("print"), distance)), "print"), "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(_sorted(least), "root").select("print", "component_id")
    return prints.join(_sorted(ids), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component of near texts: that of the smallest doc_id, a null one last.

    Texts make the components, whatever ids they have: rows that share an id but not a near text both stay. Of rows with
    one id in a component the smallest hash of the text, then of all columns, decides, so the choice is the same when a
    task runs again; of rows alike in every column one stays.
    """
    twin, row = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_twin"), F.xxhash64(*docs.columns).alias("_row")
    prints = cut(fingerprints(docs, twin, row), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_twin", "_row")
    classes = cut(prints.groupBy("print").agg(F.min(order).alias("least")), "simhash-classes")
    kept = classes.join(_sorted(roots(classes.select("print"), distance)), "print").groupBy("root").agg(F.min("least").alias("least")).select("least._twin", "least._row")
    # What comes out is one row for each key; the join deals docs out by it, so telling repeats apart moves nothing more.
    held = docs.select(F.struct("*").alias("_docs"), twin, row)
    return held.join(_sorted(kept), ["_twin", "_row"], "left_semi").dropDuplicates(["_twin", "_row"]).select("_docs.*")
