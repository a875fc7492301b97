"""Token ids as Parquet files: sorted documents, dictionary-coded id lists, delta-coded numbers, bounded row groups and pages.

A store is a folder of two tables. ``ids`` has a row for each document, in ascending order within and over its files:
part (its file), start_in_part (ids before it there), doc_id, n_tokens and ids. ``parts`` has a row for each file: base
(ids in all files before), n_docs and n_tokens. As documents lie in order, the statistics of row groups and the page
indexes lead a reader to the few pages it needs, and readers of the numbers never touch a page of ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import textkit as K
from quillstone.llm.common import new_path, texts
from quillstone.session import ship

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: Pieces of text whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 600_000
#: Lower-case letters that the normal form and lower-casing leave as they are.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
SLICE = 2 << 20
_END_PIECE = b" "

_LETTER, _DIGIT, _SPACE, _HIGH = 1, 2, 3, 4
_encoders: dict[str | None, Encoder] = {}


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[97:123], kinds[48:58], kinds[[32, 9, 10, 13]], kinds[128:] = _LETTER, _DIGIT, _SPACE, _HIGH
    return kinds


KINDS = _kinds()


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """held with room for n entries at least, grown by halves."""
    if n <= len(held):
        return held
    out = np.empty(max(n, len(held) * 3 // 2), held.dtype)
    out[: len(held)] = held
    return out


class Encoder:
    """Ids of texts under the public vocabulary of words.

    The tokenizer works on runs of letters, single digits and runs of other signs, and no rule of it looks across white
    space, from a letter to a sign behind it, or around a digit. So texts are cut there, every distinct piece is encoded
    once, and the ids are gathered. Before anything beyond ASCII there is no cut, as it may combine with what precedes
    it. Texts with the string of a special token, which is looked for before all else, go to the tokenizer whole.
    """

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(f"{folder}/{VOCABULARY}" if folder else public_tokenizers.path(VOCABULARY))
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        """Know nothing but what ends a text."""
        self.known: dict[bytes, int] = {_END_PIECE: 0}
        self.flat, self.at, self.n = np.array([END], np.int32), np.array([0, 1], np.int32), 1

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember the ids of new pieces: those of lower-case letters alone by the vocabulary, others by the tokenizer."""
        named = [p.decode() for p in pieces]
        plain = [PLAIN(w) is not None for w in named]
        words = [w for w, one in zip(named, plain) if one]
        # The vocabulary spells bytes beyond ASCII its own way.
        accented = [w for w in words if not w.isascii()]
        spelt = dict(zip(accented, self.letters.pre_tokenize_str("\n".join(accented))[0][0].split("Ċ"))) if accented else {}
        tokenize = self.whole.model.tokenize
        of_words = iter([[t.id for t in tokenize(spelt.get(w, w))] for w in words])
        of_rest = iter(self.whole.encode_batch_fast([w for w, one in zip(named, plain) if not one], add_special_tokens=False))
        found = [next(of_words) if one else next(of_rest).ids for one in plain]
        self.known.update(zip(pieces, range(self.n, self.n + len(pieces))))
        ends = self.at[self.n] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.at, self.n = _room(self.at, self.n + len(pieces) + 1), self.n + len(pieces)
        self.at[self.n + 1 - len(pieces) : self.n + 1] = ends
        self.flat = _room(self.flat, int(ends[-1]))
        self.flat[self.at[self.n - len(pieces)] : ends[-1]] = list(chain.from_iterable(found))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of a slice of texts, and each text's range of them."""
        data = K.LOWER[data]
        kind = KINDS[data]
        cut = np.zeros(len(data), bool)
        if len(data):
            before, after = kind[:-1], kind[1:]
            cut[1:] = (before == _SPACE) | (after == _DIGIT) | ((before == _DIGIT) & (after != _HIGH)) | ((before == _LETTER) & (after == 0))
            cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        kept = kind != _SPACE
        starts = np.flatnonzero(cut & kept)
        body = data[kept]
        at = np.append((np.cumsum(kept) - kept)[starts], len(body)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])
        return pieces.dictionary_encode(), np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice of texts, END after each text's, and the place of each text's first id (one more entry)."""
        held, ranges = self._pieces(data, offsets)
        distinct = held.dictionary.to_pylist()
        if self.n + len(distinct) > REMEMBERED:
            self._forget()
        known, first = self.known, self.n
        places = np.array([known.get(p, -1) for p in distinct], np.int32)
        new = np.flatnonzero(places < 0)
        if len(new):
            self._learn([distinct[i] for i in new.tolist()])
            places[new] = np.arange(first, self.n)
        texts = np.arange(len(offsets))
        which = np.insert(places[held.indices.to_numpy()], ranges[1:], known[_END_PIECE])
        starts = self.at[which]
        sizes = self.at[which + 1] - starts
        ends = np.cumsum(sizes, dtype=np.int32)
        ids = self.flat.take(np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32))
        bounds = np.concatenate([[0], ends])[ranges + texts]
        special = self._special(data, offsets)
        if not special:
            return ids, bounds
        each = [ids[a:z] for a, z in zip(bounds, bounds[1:])]
        for d in special:
            each[d] = np.array([*self.whole.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids, END], np.int32)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def _special(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that hold the string of a special token, in any case."""
        body = data.tobytes().lower()
        return [d for d in range(len(offsets) - 1) if any(s in body[offsets[d] : offsets[d + 1]] for s in self.special)] if any(s in body for s in self.special) else []


def encoder(folder: str | None) -> Encoder:
    """One encoder a worker."""
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def _encoded(folder: str | None):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, done = encoder(folder), TaskContext.get().partitionId(), 0
        for batch in parts:
            for first, rows, data, offsets in K.slices(batch.column("text"), SLICE):
                ids, at = tool.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                numbers = pa.array(np.full(rows, part, np.int32)), pa.array(done + at[:-1])
                done += len(ids)
                yield pa.RecordBatch.from_arrays([*numbers, batch.column("doc_id").slice(first, rows), pa.array(np.diff(at)), lists], ["part", "start_in_part", "doc_id", "n_tokens", "ids"])

    return batches


def write(docs: DataFrame, path: str, tokenizers: str | None = None) -> None:
    """Write the ids of every row's whole text, END after each, as a store in ascending doc_id order.

    Null and empty texts are the one id END; a null doc_id comes first; rows that share a doc_id have a row each, in the
    order in which they are read; an empty table gives a store without rows. Texts of any length are one list. Texts are
    shuffled once, by ranges of doc_id and of their place, so that a doc_id of many rows is dealt over several files.
    ``tokenizers`` names a folder with the vocabulary files.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = texts(docs).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange("doc_id", "_place").sortWithinPartitions("doc_id", "_place")
    found = ordered.mapInArrow(_encoded(tokenizers), f"part int, start_in_part long, doc_id {kind}, n_tokens long, ids array<int>")
    coded = found.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
    for name in ("part", "start_in_part", "doc_id", "n_tokens"):
        coded = coded.option(f"parquet.enable.dictionary#{name}", "false")
    coded.parquet(f"{path}/ids")
    sizes = spark.read.parquet(f"{path}/ids").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # One row a file goes to this window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def _placed(rows: DataFrame, path: str) -> DataFrame:
    parts = rows.sparkSession.read.parquet(f"{path}/parts").select("part", "base")
    rest = [c for c in rows.columns if c not in ("part", "start_in_part")]
    return rows.join(parts, "part").select(F.col("doc_id"), (F.col("base") + F.col("start_in_part")).alias("start"), *[c for c in rest if c != "doc_id"])


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens; no page of ids is read."""
    return _placed(spark.read.parquet(f"{path}/ids").select("part", "start_in_part", "doc_id", "n_tokens"), path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents from first to last (null: no bound), by the pages that hold them."""
    rows = spark.read.parquet(f"{path}/ids")
    for bound, test in ((first, lambda b: F.col("doc_id") >= b), (last, lambda b: F.col("doc_id") <= b)):
        rows = rows if bound is None else rows.where(test(bound))
    return _placed(rows, path)


def stretch(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """doc_id, start and ids of that part of each document that lies within ``length`` ids from ``start`` of the whole store.

    Only the files that hold a part of it are read, and of these only the pages: their bases, a row a file, come first.
    """
    end = start + length
    files = spark.read.parquet(f"{path}/parts").where((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > start)).select("part", "base").collect()
    inside = F.lit(False)
    for f in files:
        inside |= (F.col("part") == f["part"]) & (F.col("start_in_part") < end - f["base"]) & (F.col("start_in_part") + F.col("n_tokens") > start - f["base"])
    rows = _placed(spark.read.parquet(f"{path}/ids").where(inside), path)
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    taken = F.slice("ids", (skip + 1).cast("int"), (F.least(F.col("start") + F.col("n_tokens"), F.lit(end)) - F.col("start") - skip).cast("int"))
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), taken.alias("ids"))


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        crcs = [zlib.crc32(ids[a:z]) for a, z in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "start_in_part", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian unsigned 32-bit ids) of every document, read from the files."""
    ship(spark)
    rows = spark.read.parquet(f"{path}/ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _placed(rows.mapInArrow(_crcs, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long"), path)


def report(docs: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """What ``checksums`` reads back from a store of docs in the shared folder, for every row."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizers)
    return checksums(docs.sparkSession, path)
