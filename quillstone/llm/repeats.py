"""Substring dedup by repeated-phrase automata.

1. Every window of 20 words picks one anchor, a phrase of 8 of its words, by the smallest hash; equal windows pick equal
   anchors. An anchor is held as its words, 16 bits of hash each. Those found at two places or more are confirmed.
2. Documents are dealt into shards of bounded size. Each shard compiles an Aho-Corasick automaton of the confirmed phrases
   that were picked in it and streams all its documents through it; the matches are the places of every phrase.
3. Windows whose anchor was matched are grouped corpus-wide by a 128-bit hash; all but the first place of each go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textkit as K
from quillstone.llm.common import cut, drop, release
from quillstone.session import ship

WINDOW = 20
PHRASE = 8
#: Characters of text in a shard, about: an automaton holds at most one phrase for each few words of them.
SHARD = 4_000_000
#: Letters a word has in an automaton, a byte of its hash each.
LETTERS = 2


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, ranges = K.word_bounds(data, offsets, K.NON_SPACE)
    return starts, ends, ranges, K.document_of(ranges)


def _phrases(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the phrase at each place: four words of 16 bits each."""
    short = hashes >> np.uint64(48)
    n = max(len(short) - PHRASE + 1, 0)
    half = lambda k: sum(short[k + j : k + j + n] << np.uint64(48 - 16 * j) for j in range(4))
    return half(0), half(4)


def _anchors(high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the windows that lie in one document, and the place of each one's anchor."""
    n = len(owner) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = K.mix(high ^ K.mix(low))
    least, place = rank[:n].copy(), np.arange(n)
    for j in range(1, WINDOW - PHRASE + 1):
        lower = rank[j : j + n] < least
        np.copyto(least, rank[j : j + n], where=lower)
        np.copyto(place, np.arange(j, j + n), where=lower)
    windows = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    return windows, place[windows]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        for first, _, data, offsets in K.slices(batch.column("text")):
            starts, ends, _, owner = _words(data, offsets)
            high, low = _phrases(K.word_hashes(data, starts, ends))
            at = np.unique(_anchors(high, low, owner)[1])
            shard = shards[first + owner[at]]
            _, one, n = np.unique(K.mix(high[at] ^ K.mix(low[at] ^ K.mix(shard.astype(np.uint64)))), return_index=True, return_counts=True)
            columns = [pa.array(x[at[one]].view(np.int64)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard[one]), pa.array(n)], ["high", "low", "shard", "n"])


def compile_phrases(phrases: np.ndarray) -> ahocorasick.Automaton | None:
    """The automaton of phrases, two unsigned longs a row; none of no phrases."""
    if not len(phrases):
        return None
    width = PHRASE * LETTERS
    letters = phrases.astype(">u8").tobytes().decode("latin-1")
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for at in range(0, len(letters), width):
        machine.add_word(letters[at : at + width])
    machine.make_automaton()
    return machine


def locate(machine: ahocorasick.Automaton | None, hashes: np.ndarray) -> np.ndarray:
    """Places of a stream of words, given by their hashes, at which a phrase of the automaton starts."""
    if machine is None or len(hashes) < PHRASE:
        return np.zeros(0, np.int64)
    stream = (hashes >> np.uint64(48)).astype(">u2").tobytes().decode("latin-1")
    ends = np.fromiter((end for end, _ in machine.iter(stream)), np.int64) + 1
    return ends[ends % LETTERS == 0] // LETTERS - PHRASE


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its phrases (without a text) before its documents, of which a slice is held at a time."""
    shard, phrases, machine = None, [], None
    for batch in batches:
        shards, texts = batch.column("shard").to_numpy(), batch.column("text").is_valid().to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1) | np.diff(texts.astype(int), prepend=2))
        for a, z in zip(runs, [*runs[1:], len(shards)]):
            part = batch.slice(a, z - a)
            if shards[a] != shard:
                shard, phrases, machine = shards[a], [], None
            if not texts[a]:
                phrases.append(np.column_stack([part.column(c).to_numpy().view(np.uint64) for c in ("high", "low")]))
                continue
            if phrases:
                machine, phrases = compile_phrases(np.unique(np.concatenate(phrases), axis=0)), []
            if machine:
                yield from _located(machine, part)


def _located(machine: ahocorasick.Automaton, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first, rows, data, offsets in K.slices(batch.column("text")):
        starts, ends, ranges, owner = _words(data, offsets)
        hashes = K.word_hashes(data, starts, ends)
        confirmed = np.zeros(len(hashes) + 1, bool)
        confirmed[locate(machine, hashes)] = True
        windows, place = _anchors(*_phrases(hashes), owner)
        windows = windows[confirmed[place]]
        wide = K.window_hashes(hashes, WINDOW)[windows]
        more = K.window_hashes(K.word_hashes(data, starts, ends, 1), WINDOW)[windows] if len(windows) else wide
        cuts = pa.array(np.searchsorted(windows, ranges).astype(np.int32))
        own = [batch.column(c).slice(first, rows) for c in ("doc_id", "twin")]
        lists = (windows - ranges[owner[windows]]).astype(np.int32), wide.view(np.int64), more.view(np.int64)
        found = pa.RecordBatch.from_arrays([*own, *(pa.ListArray.from_arrays(cuts, pa.array(x)) for x in lists)], ["doc_id", "twin", "starts", "wide", "more"])
        yield found.filter(pa.array(np.diff(np.searchsorted(windows, ranges)) > 0))


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows, data, offsets in K.slices(batch.column("text")):
            starts, ends, ranges, _ = _words(data, offsets)
            whole = batch.column("whole").slice(first, rows).to_pylist()
            gone = batch.column("gone").slice(first, rows)
            spans, texts = [], []
            flat, at = K.spaced(data, starts, ends)
            flat_bytes = flat.tobytes()
            removed = np.zeros(rows, np.int64)
            for d in range(rows):
                a, z = int(ranges[d]), int(ranges[d + 1])
                n = z - a
                listed = gone[d].values
                if whole[d] and n >= WINDOW:
                    removed[d], kept = n, b""
                elif listed is None or not len(listed):
                    kept = flat_bytes[at[a] : at[z] - 1] if n else b""
                else:
                    marks = np.zeros(n + 1, np.int64)
                    at_words = listed.to_numpy(zero_copy_only=False)
                    np.add.at(marks, at_words, 1)
                    np.add.at(marks, at_words + WINDOW, -1)
                    covered = np.cumsum(marks[:-1]) > 0
                    removed[d] = covered.sum()
                    keep = np.repeat(~covered, np.diff(at[a : z + 1]))
                    kept = flat[at[a] : at[z]][keep].tobytes()[:-1]
                spans.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, rows), pa.array(np.diff(ranges)), pa.array(removed), pa.array(spans), pa.array(texts)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept: each text without the words of windows that start earlier too.

    Earlier means in a document of smaller doc_id, or in the same one before. A whole copy of an earlier document loses
    all its words at once. Null texts read as empty; texts under 20 words stay whole; repeated rows (same doc_id and
    text) are one document and come out alike; a null doc_id counts as the smallest; rows that share a doc_id but not the
    text are ordered by a hash of it.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.hash(text).alias("twin"), text.alias("text"))

    def on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.withColumnRenamed("doc_id", "_doc").withColumnRenamed("twin", "_twin")
        return left.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin")), how).drop("_doc", "_twin")

    same = cut(base.select("doc_id", "twin", F.xxhash64("text").alias("same"), F.length("text").alias("size")), "repeats-sizes", tidy=True)
    firsts = cut(same.groupBy("same", "twin", "size").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats-firsts-of")
    copies = same.join(firsts.drop("n"), ["same", "twin", "size"]).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "twin").distinct()
    copies = cut(copies, "repeats-copies")

    shards = max(1, ceil((same.agg(F.sum("size")).first()[0] or 0) / SHARD))
    once = on(base.where(F.length("text") >= 2 * WINDOW - 1), copies, "left_anti")
    if same.groupBy("doc_id", "twin").count().where("count > 1").limit(1).count():
        once = once.dropDuplicates(["doc_id", "twin"])
    dealt = once.withColumn("shard", F.pmod(F.xxhash64("doc_id", "twin"), F.lit(shards)).cast("int"))

    picked = cut(dealt.select("shard", "text").mapInArrow(_anchor_batches, "high long, low long, shard int, n long"), "repeats-anchors", tidy=True)
    recurring = picked.groupBy("high", "low").agg(F.sum("n").alias("n")).where("n > 1").select("high", "low")
    confirmed = cut(picked.drop("n").join(recurring, ["high", "low"], "left_semi"), "repeats-confirmed", tidy=True)
    drop(picked, same, firsts)
    streamed = confirmed.unionByName(dealt, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("text").isNotNull())
    windows = cut(streamed.mapInArrow(_window_batches, f"doc_id {kind}, twin int, starts array<int>, wide array<long>, more array<long>"), "repeats-windows", tidy=True)
    drop(confirmed)

    each = windows.select("doc_id", "twin", F.explode(F.arrays_zip("wide", "more", "starts")).alias("w")).select("w.wide", "w.more", "doc_id", "twin", F.col("w.starts").alias("start"))
    first = each.groupBy("wide", "more").agg(F.min(F.struct("doc_id", "twin", "start")).alias("f")).select("f.*")
    kept = cut(first.groupBy("doc_id", "twin").agg(F.collect_list("start").alias("firsts")), "repeats-firsts", tidy=True)
    gone = on(windows.select("doc_id", "twin", "starts"), kept, "left").select(
        "doc_id", "twin", F.when(F.col("firsts").isNull(), F.col("starts")).otherwise(F.array_except("starts", "firsts")).alias("gone"), F.lit(False).alias("whole")
    )
    gone = gone.where(F.size("gone") > 0).unionByName(copies.select("doc_id", "twin", F.array().cast("array<int>").alias("gone"), F.lit(True).alias("whole")))
    final = on(base, gone, "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.coalesce("whole", F.lit(False)).alias("whole"))
    release(spark)
    return final.mapInArrow(_kept_batches, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
