"""Phrase collocations by vertical positional inverted lists.

The words of the corpus are laid out in shards of whole pieces of text. In a shard, a phrase's inverted list holds the
places at which it starts. A phrase of k + 1 words stands wherever one of k words stands at a place and another, which
overlaps it in all but one word, at the next; so each level merges the lists of the one before with themselves, one place
on, and the length of the list that comes out is the new phrase's exact frequency in the shard. Between levels the
lengths are added up over all shards; phrases below the least frequency can't be part of frequent ones and go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import textkit as K
from quillstone.llm.common import cut, drop
from quillstone.session import ship

LEAST = 30
LONGEST = 4
TOP = 2_000
#: A phrase goes if a longer one that holds it has at least this many hundredths of its occurrences.
ABSORBED = 80
SCALE = 2_000_000
#: Characters of text in a shard, about; a longer text is one of its own.
SHARD = 12_000_000
#: Numbers set aside for the shards of a task, and for the phrases of a shard: a text has at most half as many words as bytes.
SHARDS_OF_TASK, PHRASES_OF_SHARD = 1 << 13, 1 << 30
#: Tasks over which the phrases that begin alike are dealt.
SPREAD = 8
#: Parts over which the phrases of a language are dealt before the best of each part meet.
PARTS = 64
#: A language that a row doesn't state.
NO_LANGUAGE = "und"

_GAP = -1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    breaks = np.zeros(256, bool)
    breaks[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    words = ~breaks
    words[[0x20, 0x09]] = False
    return words, breaks


WORDS, BREAKS = _tables()


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard: the words at its places (numbers of its own, a gap between pieces), and for each number its language, word and count."""
    shard = TaskContext.get().partitionId() * SHARDS_OF_TASK
    for batch in batches:
        named = batch.column("lang").dictionary_encode()
        languages = named.indices.to_numpy(zero_copy_only=False)
        for first, rows, data, offsets in K.slices(batch.column("text"), SHARD):
            data = K.LOWER[data]
            starts, ends, ranges = K.word_bounds(data, offsets, WORDS)
            if not len(starts):
                continue
            at = np.concatenate([[0], np.cumsum(ends - starts)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[WORDS[data]])]).dictionary_encode()
            document = K.document_of(ranges)
            both = languages[first + document].astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
            found, codes, counts = np.unique(both, return_inverse=True, return_counts=True)
            piece = np.searchsorted(np.flatnonzero(BREAKS[data]), starts)
            new = np.flatnonzero((np.diff(piece) != 0) | (np.diff(document) != 0)) + 1
            places = np.insert(codes.astype(np.int32), new, _GAP)
            texts = words.dictionary.take(pa.array(found % len(words.dictionary))).cast(pa.large_string()).cast(pa.string())
            lists = pa.array(places), named.dictionary.take(pa.array(found // len(words.dictionary))), texts, pa.array(counts)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.ListArray.from_arrays([0, len(x)], x) for x in lists)], ["shard", "places", "lang", "word", "n"])
            shard += 1
            if shard % SHARDS_OF_TASK == 0:
                raise OverflowError("a task reads more shards than numbers are set aside for")


def _extended(shard: pa.Table, frequent: pa.Table) -> pa.Table:
    """The lists of a shard's phrases of one word more, from its layout and the ids of its frequent phrases.

    The layout comes as the phrase's number at each place; what comes out is laid out likewise.
    """
    schema = pa.schema([("shard", pa.int64()), ("places", pa.list_(pa.int32())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    if not shard.num_rows or not frequent.num_rows:
        return schema.empty_table()
    numbers = shard.column("places").combine_chunks().flatten().to_numpy()
    # In order of ids, so that the pairs of a shard come sorted.
    ids = frequent.column("id").to_numpy()
    order = np.argsort(ids)
    ids, code = ids[order], frequent.column("code").to_numpy()[order]
    # Inverted lists of the frequent phrases, end to end: places in order of phrase and place.
    which = np.full(int(max(numbers.max(), code.max())) + 2, _GAP, np.int64)
    which[code] = np.arange(len(code))
    held = which[numbers]
    starts = np.flatnonzero(held >= 0)
    # The merge of all lists with those of the next place: places whose follower is in a list too.
    at = starts[:-1][np.diff(starts) == 1] if len(starts) else starts
    if not len(at):
        return schema.empty_table()
    joined = held[at] * len(code) + held[at + 1]
    pairs, own, lengths = np.unique(joined, return_inverse=True, return_counts=True)
    places = np.full(len(numbers), _GAP, np.int32)
    places[at] = own
    # Gaps at the ends and runs of gaps say no more than one gap.
    kept = (places != _GAP) | np.concatenate([[False], places[:-1] != _GAP])
    values = [places[kept]], [ids[pairs // len(code)]], [ids[pairs % len(code)]], [lengths]
    return pa.Table.from_arrays([shard.column("shard").combine_chunks(), *(pa.array(v, schema.field(k + 1).type) for k, v in enumerate(values))], schema=schema)


def _frequent(layout: DataFrame, key: list[str], least: int, name: str) -> DataFrame:
    """own, key, f and id: of each shard the numbers (own, in the corpus) of phrases that occur ``least`` times or more in the corpus.

    A phrase's rows, one from each shard, meet once: they are added up and kept apart in one exchange. Its id is the
    least of their numbers. Rows are dealt by the first half of the key and a part of the second, so that those of one
    first half, which a shard gives in order, travel together and are dealt over several tasks where they are many.
    """
    each = layout.select(F.posexplode(F.arrays_zip(*key, "n")).alias("code", "p"), "shard")
    each = each.select((F.col("shard") * PHRASES_OF_SHARD + F.col("code")).alias("own"), *[F.col(f"p.{c}").alias(c) for c in (*key, "n")])
    dealt = each.withColumn("part", F.pmod(F.xxhash64(key[1]), F.lit(SPREAD)).cast("int"))
    alike = Window.partitionBy(key[0], "part", key[1])
    counted = dealt.repartition(key[0], "part").withColumns({"f": F.sum("n").over(alike), "id": F.min("own").over(alike)}).where(F.col("f") >= least)
    return cut(counted.drop("n", "part"), name, tidy=True)


def _floor_score(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts), exactly: the product is a decimal."""
    product = (a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", product, parts.cast("decimal(38,0)"))


def _scored(level: DataFrame, k: int) -> DataFrame:
    """Phrases of k words with their weakest cut: score, l and r; of equal scores the first cut."""
    cuts = [F.struct(_floor_score(F.col("f"), F.col("heads")[j] + F.col("tails")[k - 2 - j]).alias("score"), F.lit(j).alias("cut"), F.col("heads")[j].alias("l"), F.col("tails")[k - 2 - j].alias("r")) for j in range(k - 1)]
    return level.withColumn("_cut", F.array_min(F.array(*cuts))).select("id", "lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")


def _apart(candidates: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Candidates without those that a longer phrase absorbs.

    A longer phrase that absorbs one is nowhere more frequent than the phrases of one word more between the two, so
    these alone, which are frequent themselves, need to be asked.
    """
    if longer is None:
        return candidates.drop("id")
    over = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_over"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    absorbed = F.coalesce(big("_over") * 100 >= big("a") * ABSORBED, F.lit(False))
    return candidates.join(over, "id", "left").where(~absorbed).drop("id", "_over")


def best(candidates: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """The first ``top`` candidates of each language with their rank; a language's best of each of many parts meet first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    within = candidates.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    return within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_part")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of two to ``longest`` words of each language.

    a, l and r are the exact frequencies of the phrase and of the two parts of its weakest cut, n the words of the
    language. Null texts read as empty; a null language is ``und``; repeated rows count each time; phrases end at stops
    and line ends; a corpus without a frequent phrase gives no rows. Texts of any length are read whole.
    """
    ship(docs.sparkSession)
    source = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    layout = cut(source.mapInArrow(_laid_out, "shard long, places array<int>, lang array<string>, word array<string>, n array<long>"), "phrases-words", tidy=True, apart=True)
    sizes = layout.select(F.explode(F.arrays_zip("lang", "n")).alias("p")).groupBy("p.lang").agg(F.sum("p.n").alias("n"))
    key, levels = ["word", "lang"], []
    while True:
        k = len(levels) + 1
        seen = _frequent(layout, key, least, f"phrases-seen{k}")
        phrases = seen.where("own = id")
        if k == 1:
            level = phrases.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"))
        else:
            head = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_phrase"), F.col("f").alias("_head"), F.col("heads").alias("_heads"))
            tail = levels[-1].select(F.col("id").alias("right"), "last", F.col("f").alias("_tail"), F.col("tails").alias("_tails"))
            level = phrases.join(head, "left").join(tail, "right").select(
                "id", "left", "right", "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "f", F.array_append("_heads", F.col("_head")).alias("heads"), F.array_append("_tails", F.col("_tail")).alias("tails")
            )
        levels.append(cut(level, f"phrases-level{k}"))
        if k == longest:
            break
        hits = seen.select(F.shiftright("own", PHRASES_OF_SHARD.bit_length() - 1).alias("shard"), F.col("own").bitwiseAND(PHRASES_OF_SHARD - 1).cast("int").alias("code"), "id")
        lists = layout.select("shard", "places").groupBy("shard").cogroup(hits.groupBy("shard"))
        wider = cut(lists.applyInArrow(_extended, "shard long, places array<int>, left array<long>, right array<long>, n array<long>"), f"phrases-lists{k + 1}", tidy=True, apart=True)
        if k > 1:
            drop(layout)
        else:
            sizes = cut(sizes, "phrases-sizes")
            drop(layout)
        drop(seen)
        layout, key = wider, ["left", "right"]
    drop(layout, seen)
    found = [_apart(_scored(levels[k - 1], k), levels[k] if k < longest else None) for k in range(2, longest + 1)]
    return best(reduce(DataFrame.unionByName, found), top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
