"""Cost-balanced packing: descending pieces go to the open sequence of lowest attention cost with room left."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillstone.llm.common import texts
from quillstone.session import ship

CAPACITY = 2048
END = 1
#: Sequences that are filled together; a group is cut at this many times CAPACITY tokens.
GROUP = 256
#: Cost of a piece of n tokens: n plus QUADRATIC * n * n, in units of one token's linear cost.
QUADRATIC = 1 / CAPACITY

SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, object] = {}


class Encoder:
    """Token ids of texts under the public byte-level vocabulary.

    The ranks file holds the vocabulary of the tokenizer file, and encodes it several times faster; texts that contain
    the string of the special token, which only the tokenizer file knows, go to the tokenizer itself.
    """

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        self.whole = Tokenizer.from_file(at("byte_bpe_50k.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(at("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.ranks = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array([*ids, END], "<u4")


def encoder(folder: str | None) -> Encoder:
    """One encoder a worker."""
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def cost(n: int) -> float:
    """Estimated cost of a piece: the linear layers plus attention within the piece."""
    return n + QUADRATIC * n * n


def place(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths.

    Documents longer than the capacity fill whole sequences first. What is left of each goes, longest first, to the
    cheapest sequence with room for all of it; where none has room, it is cut over the roomiest ones. As many
    sequences are open as the tokens need, so all but the last few tokens of a group are full. Ties go to the
    earlier document and sequence.
    """
    out, rest, full = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        out.extend((d, k * capacity, capacity, full + k, 0) for k in range(whole))
        full += whole
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    need = -(-sum(n for n, _, _ in rest) // capacity)
    used = [0] * need
    by_cost = [(0.0, s) for s in range(need)]
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        passed, found = [], None
        while by_cost:
            c, s = heapq.heappop(by_cost)
            if used[s] + n <= capacity:
                found = (c, s)
                break
            passed.append((c, s))
        if found:
            c, s = found
            out.append((d, start, n, full + s, used[s]))
            used[s] += n
            passed.append((c + cost(n), s))
        else:
            costs = {s: c for c, s in passed}
            for s in sorted(costs, key=lambda s: (used[s], s)):
                take = min(n, capacity - used[s])
                if take:
                    out.append((d, start, take, full + s, used[s]))
                    used[s] += take
                    costs[s] += cost(take)
                    start, n = start + take, n - take
                if not n:
                    break
            passed = [(c, s) for s, c in costs.items()]
        for item in passed:
            if used[item[1]] < capacity:
                heapq.heappush(by_cost, item)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, tokenizers: str | None = None) -> DataFrame:
    """The pieces of every row's ids (its whole text's, then END), packed into sequences of ``capacity`` tokens.

    Each task packs the rows it reads in groups of about ``group`` sequences, so nothing is shuffled and a group's ids
    are all that is held; sequence_id has the partition's number in its upper bits. Null and empty texts are the one
    id END; repeated rows are packed once each; a text of any length is cut into whole sequences; an empty table gives
    no pieces. ``tokenizers`` names a folder with the vocabulary files.
    """
    ship(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizers)
        base = TaskContext.get().partitionId() << 32
        names, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal base
            placed = place([len(x) for x in held], capacity)
            columns = [
                pa.array([names[p[0]] for p in placed], kind_type),
                *(pa.array([p[k] for p in placed], pa.int64()) for k in (1, 2)),
                pa.array([zlib.crc32(held[p[0]][p[1] : p[1] + p[2]].tobytes()) for p in placed], pa.int64()),
                pa.array([len(held[p[0]]) for p in placed], pa.int64()),
                pa.array([base + p[3] for p in placed], pa.int64()),
                pa.array([p[4] for p in placed], pa.int64()),
            ]
            base += max(p[3] for p in placed) + 1
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind_type = pa.int64()
        for batch in parts:
            kind_type = batch.schema.field("doc_id").type
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                names.append(name.as_py())
                held.append(tool.encode(text.as_py()))
                size += len(held[-1])
                if size >= group * capacity:
                    yield close()
                    names, held, size = [], [], 0
        if held:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(batches, SCHEMA.format(kind=kind))
