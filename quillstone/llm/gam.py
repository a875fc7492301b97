"""Quality classifier: an additive model with pairwise interactions, boosted in cycles, scored by table lookups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textkit as K
from quillstone.llm.common import held_out, texts
from quillstone.session import ship

FEATURES = (
    "log_words word_length symbol_share upper_share digit_share mark_share distinct_share repeat_share "
    "line_repeat_share long_word_share pipe_share bang_share".split()
)
#: Most labelled rows the model is fitted on: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 120, 0.15


def _byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _PIPE, _BANG = _byte_table(b"#*$%&<>~^=_\\@{}[]"), _byte_table(b"|"), _byte_table(b"!?")
_MARK, _DIGIT = _byte_table(b".,;:'\"()-"), _byte_table(b"0123456789")
_UPPER = _byte_table(bytes(range(65, 91)))
_LETTER = _byte_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_NOT_BREAK = ~_byte_table(b"\n")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeated(keys: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many keys of each owner repeat an earlier key of the same owner."""
    if not len(keys):
        return np.zeros(rows, np.int64)
    both = K.mix(keys ^ K.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    again = both[order][1:] == both[order][:-1]
    return np.bincount(owner[order][1:][again], minlength=rows)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice; an empty text has zeros."""
    rows = len(offsets) - 1
    starts, ends, ranges = K.word_bounds(data, offsets, K.NON_SPACE)
    words, owner = np.diff(ranges), K.document_of(ranges)
    size = np.diff(offsets)

    def held(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    hashes = K.word_hashes(data, starts, ends)
    pairs = K.window_hashes(hashes, 3)
    inside = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    line_starts, line_ends, line_ranges = K.word_bounds(data, offsets, _NOT_BREAK)
    lines = K.word_hashes(data, line_starts, line_ends)
    body = np.bincount(owner, ends - starts, rows) if rows else np.zeros(0)
    long_words = np.bincount(owner, (ends - starts) > 14, rows)
    return np.column_stack(
        [
            np.log1p(words),
            _share(body, words),
            _share(held(_SYMBOL), body),
            _share(held(_UPPER), held(_LETTER)),
            _share(held(_DIGIT), body),
            _share(held(_MARK), words),
            _share(words - _repeated(hashes, owner, rows), words),
            _share(_repeated(pairs[inside], owner[2:][inside] if len(owner) > 2 else owner[:0], rows), words),
            _share(_repeated(lines, K.document_of(line_ranges), rows), np.diff(line_ranges)),
            _share(long_words, words),
            _share(held(_PIPE), words),
            _share(held(_BANG), words),
        ]
    ) * (size > 0)[:, None]


@dataclass
class Gam:
    """Cut points and lookup tables; a score is the sigmoid of an intercept plus one entry of each table."""

    cuts: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by vectorised additions of bins."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _stump(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per-bin steps of the best three-leaf tree over ordered bins."""
    step = np.full(len(gradient), gradient.sum() / (weight.sum() + 1.0))
    edges = [0, len(gradient)]
    for _ in range(2):
        best = (1e-9, None)
        for lo, hi in zip(edges, edges[1:]):
            g, w = np.cumsum(gradient[lo:hi]), np.cumsum(weight[lo:hi])
            if hi - lo > 1:
                gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1) - g[-1] ** 2 / (w[-1] + 1)
                at = int(np.argmax(gain))
                best = max(best, (float(gain[at]), lo + at + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    for lo, hi in zip(edges, edges[1:]):
        step[lo:hi] = gradient[lo:hi].sum() / (weight[lo:hi].sum() + 1.0)
    return step


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and per-cell steps of the best tree that splits a grid of bins once on each axis."""
    g, w = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (gradient, weight))
    rows, cols = gradient.shape
    best, step = 0.0, np.zeros_like(gradient)
    for i in range(1, rows):
        for j in range(1, cols):
            cells = [(0, i, 0, j), (0, i, j, cols), (i, rows, 0, j), (i, rows, j, cols)]
            sums = [tuple(a[r1, c1] - a[r0, c1] - a[r1, c0] + a[r0, c0] for a in (g, w)) for r0, r1, c0, c1 in cells]
            gain = sum(s * s / (v + 1) for s, v in sums)
            if gain > best:
                best, step = gain, np.zeros_like(gradient)
                for (r0, r1, c0, c1), (s, v) in zip(cells, sums):
                    step[r0:r1, c0:c1] = s / (v + 1)
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cycle over the features, one shallow tree each in turn, then over the strongest pairs on what is left.

    No rows, or one class alone, gives a model whose every score is 0.5 or that class's smoothed rate.
    """
    model = Gam()
    n, m = len(y), len(FEATURES)
    rate = (y.sum() + 1) / (n + 2)
    model.intercept = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return model
    model.cuts = [_quantile_cuts(x[:, j], BINS) for j in range(m)]
    model.pair_cuts = [_quantile_cuts(x[:, j], PAIR_BINS) for j in range(m)]
    bins = [np.searchsorted(model.cuts[j], x[:, j], "right") for j in range(m)]
    grid = [np.searchsorted(model.pair_cuts[j], x[:, j], "right") for j in range(m)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(n, model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(m):
            r, w = residual()
            k = len(model.tables[j])
            step = RATE * np.clip(_stump(np.bincount(bins[j], r, k), np.bincount(bins[j], w, k)), -4, 4)
            model.tables[j] += step
            total += step[bins[j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
        r, w = residual()
        at = grid[i] * shape[1] + grid[j]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (r, w))

    ranked = sorted(combinations(range(m), 2), key=lambda p: (-_quadrants(*cells(*p))[0], p))[:PAIRS]
    tables = {p: np.zeros((len(model.pair_cuts[p[0]]) + 1, len(model.pair_cuts[p[1]]) + 1)) for p in ranked}
    for _ in range(ROUNDS // 4):
        for i, j in ranked:
            step = RATE * np.clip(_quadrants(*cells(i, j))[1], -4, 4)
            tables[i, j] += step
            total += step[grid[i], grid[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows, data, offsets in K.slices(batch.column("text")):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, rows), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], ["doc_id", *FEATURES]
            )


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every whole text; null reads as empty."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(_feature_batches, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Gam:
    """Fit on at most ``fit_rows`` labelled rows that are not held out: those whose doc_id has the smallest hash.

    Rows of labels without an id or a label don't count; contradicting labels of one document go to the majority, ties
    to 1. Only the chosen rows' features reach the driver.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # A bounded side: fit_rows rows of two numbers.
    labelled = document_features(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = labelled.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", *FEATURES, "label").collect()
    rows.sort()
    x = np.array([r[1:-1] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[-1] for r in rows], float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row; repeated rows score alike."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, rows, data, offsets in K.slices(batch.column("text")):
                p = model.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(p)], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(batches, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """docs without the rows that score below ``least``; every column stays as it is, and nothing is shuffled."""
    ship(docs.sparkSession)
    names = docs.columns

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            kept = [model.score(features(data, offsets)) >= least for _, _, data, offsets in K.slices(batch.column("text"))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.select(names).mapInArrow(batches, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all docs by a model of the labelled ones; texts that are empty or null score like any other.

    Without usable labels every score is 0.5 and every prediction 1.
    """
    return score(docs, learn(docs, labels))
