"""Quality classifier: naive-Bayes features in a linear support vector machine.

A document is the set of its n-grams (indicators, hashed): byte trigrams, word
uni- and bigrams, and uni- to trigrams of word shapes, a shape being a word's
case, ending, length and whether it repeats the word before.  Each indicator is
scaled by its log-count ratio between the classes; a hinge-loss model over the
scaled indicators is fitted by dual coordinate descent, and its margins are
turned into probabilities on rows held out of that fit.

Models are fitted on at most ``max_rows`` labelled rows, chosen by a hash of
their id, whatever the size of the corpus.  Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.llm import words as W

BITS = 16
SIZE = 4 << BITS
MAX_ROWS = 12_000
_LETTER = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 other byte, 5 stop, 6 sign
_LETTER[:128] = 6
_LETTER[97:123], _LETTER[65:91], _LETTER[48:58], _LETTER[128:] = 1, 2, 3, 4
_LETTER[list(b".,;:'\"-()")] = 5


def _slot(x: np.ndarray, bits: int, at: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) + at


def features(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted distinct features it has."""
    mark = np.zeros(SIZE, bool)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for block in W.blocks(column):
        d = block.data.astype(np.uint64)
        grams = _slot((((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) + np.uint64(1)) * odd, BITS, 0) if len(d) > 2 else np.zeros(0, np.int64)
        s, e, h = block.starts, block.ends, block.hashes
        n = len(h)
        same = np.zeros(n, bool)
        same[1:] = (h[1:] == h[:-1]) & (block.second[1:] == block.second[:-1])
        same[block.bounds[:-1][block.bounds[:-1] < n]] = False  # a text's first word follows none
        kind = _LETTER[block.data]
        uppers = np.r_[0, np.cumsum(kind == 2)]
        long = np.digitize(e - s, [2, 4, 8, 16])
        shape = (kind[s].astype(np.uint64) * np.uint64(7) + kind[e - 1].astype(np.uint64)) * np.uint64(5) + long.astype(np.uint64) if n else np.zeros(0, np.uint64)
        shape = (shape * np.uint64(2) + (uppers[e] - uppers[s] > 1)) * np.uint64(2) + same
        shape = W.mix(shape + np.uint64(17))
        one, two = _slot(h, BITS, 2 << BITS), _slot(W.shingles(h, 2), BITS, 3 << BITS)
        forms = [_slot(W.shingles(shape, k), BITS, 1 << BITS) for k in (1, 2, 3)]
        for i in range(len(block)):
            a, b = block.bounds[i], block.bounds[i + 1]
            lo, hi = block.offsets[i], block.offsets[i + 1]
            mark[grams[lo : max(lo, hi - 2)]] = True
            mark[one[a:b]] = True
            mark[two[a : max(a, b - 1)]] = True
            for k, x in enumerate(forms):
                mark[x[a : max(a, b - k)]] = True
            found = np.flatnonzero(mark)
            mark[found] = False
            yield found


@dataclass(frozen=True)
class Model:
    """``weights`` over all features with the ratios multiplied in."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = (float(self.weights[found].sum(dtype=np.float64)) + self.bias) * self.slope + self.shift
        return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((p + alpha) / |p|) - log((q + alpha) / |q|) of indicator counts."""
    counts = np.full((2, SIZE), alpha)
    for found, y in zip(rows, good, strict=True):
        counts[int(y), found] += 1
    counts = np.log(counts / counts.sum(1, keepdims=True))
    return counts[1] - counts[0]


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """L1-loss support vectors by dual coordinate descent; ``y`` is +1 or -1.

    Row ``i`` has ``values[rows[i]]`` at ``rows[i]`` and a constant for the bias.
    """
    w, bias = np.zeros(SIZE), 0.0
    dual = np.zeros(len(rows))
    norms = np.array([float(values[r] @ values[r]) for r in rows]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            scaled = values[rows[i]]
            slack = y[i] * (float(w[rows[i]] @ scaled) + bias) - 1
            new = min(max(dual[i] - slack / norms[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                moved = max(moved, abs(new - dual[i]) / cost[i])
                w[rows[i]] += step * scaled
                bias += step
                dual[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (with a prior)."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margin, np.ones(len(y))]
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - t) + 1e-3 * beta)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, c: float = 1.0, blend: float = 0.25) -> Model:
    """A model from feature rows and 0/1 labels.

    A quarter of the rows is kept for the probabilities.  With one class only,
    or no rows, every score is that class's smoothed share.
    """
    good = np.asarray(good, np.int64)
    share = (good.sum() + 1) / (len(good) + 2)
    prior = float(np.log(share / (1 - share)))
    aside = np.arange(len(good)) % 4 == 3
    if min((good[~aside] == 0).sum(), (good[~aside] == 1).sum()) == 0 or not aside.any():
        return Model(np.zeros(SIZE), 0.0, 1.0, prior)
    train = [r for r, x in zip(rows, aside, strict=True) if not x]
    y = good[~aside]
    ratios = log_count_ratios(train, y)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, bias = dual_descent(train, ratios, 2.0 * y - 1, c * weight)
    v = (blend * w + (1 - blend) * np.abs(w).mean()) * ratios
    margin = np.array([v[r].sum() + bias for r in rows])
    slope, shift = _sigmoid_fit(margin[aside], good[aside])
    return Model(v, float(bias), slope, shift)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``doc_id, text, good`` of at most ``max_rows`` labelled rows.

    Labels of held-out ids are never read further; of contradicting labels of
    an id the smaller counts.  The chosen ids are bounded by ``max_rows``, so
    they are broadcast and texts are filtered where they are read.
    """
    own = labels.where(~held_out(doc_id)).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    own = own.groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.min(label) > 0).cast("int").alias("good"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([x.astype("<i4").tobytes() for x in features(some.column(1))], pa.binary())], ["id", "good", "found"])


def _fitted(c: float, blend: float):
    """Fit on the rows of a partition, held as one array of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, good, sizes, parts = [], [], [], []
        for batch in batches:
            found = batch.column(2)
            ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
            ids.append(batch.column(0).to_numpy().astype(np.uint64))
            good.append(batch.column(1).to_numpy())
            sizes.append(np.diff(ends) // 4)
            parts.append(np.frombuffer(found.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i4").copy())
        if not sum(map(len, ids)):
            return
        ends = np.cumsum(np.concatenate(sizes))
        flat = np.concatenate(parts)
        parts.clear()
        order = np.argsort(W.mix(np.concatenate(ids)), kind="stable")
        rows = [flat[ends[i - 1] if i else 0 : ends[i]] for i in order]
        model = fit(rows, np.concatenate(good)[order], c, blend)
        columns = [pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (model.bias, model.slope, model.shift))]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "bias", "slope", "shift"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, c: float = 1.0, blend: float = 0.25, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on a bounded sample, in one task; only the model reaches the driver."""
    rows = sample(docs, labels, max_rows, text, doc_id, label).select("id", "text", "good").mapInArrow(_featured, "id long, good int, found binary")
    # One partition of at most max_rows rows.
    together = rows.repartition(1).sortWithinPartitions("id", "good", F.xxhash64("found"))
    got = together.mapInArrow(_fitted(c, blend), "weights binary, bias double, slope double, shift double").collect()
    if not got:
        return Model(np.zeros(SIZE), 0.0, 1.0, 0.0)
    return Model(np.frombuffer(got[0].weights, "<f4").astype(np.float64), got[0].bias, got[0].slope, got[0].shift)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and a last column with the probability that a text is good; a
    column that has its name already is replaced.

    A null or empty text has no features and gets the model's base score, a very
    long one is scored whole; repeated rows get equal scores, an empty table
    stays empty.  Nothing but the text is an input.
    """
    if name != text:
        docs = docs.drop(name)
    at = docs.columns.index(text)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    base_bias, base_slope, base_shift = model.bias, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights.value, base_bias, base_slope, base_shift)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(x) for x in features(batch.column(at))], pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lambda batches: W.returned(run(batches)), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def good_documents(docs: DataFrame, model: Model, cut: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, all columns kept."""
    return score(docs, model, text, "__tl_score").where(F.col("__tl_score") >= cut).drop("__tl_score")
