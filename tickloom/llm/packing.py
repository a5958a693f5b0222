"""Packing token pieces into fixed windows by non-negative least squares.

Documents are cut on a grid of one window first, so that all pieces but the last
of a document fill a window alone.  The histogram of the last pieces (at most
``window`` numbers, whatever the corpus) is coarsened to a few hundred length
bins; combinations of up to three bins that fill a window are enumerated, their
repeat counts solved by non-negative least squares against the histogram and
rounded, and what is left is packed greedily, first into the gaps of the
combinations and then into new windows.  Windows that would still be padded by
more than a small share are taken apart, and their pieces laid end to end and
cut where a window ends: at most one cut a window, and next to no padding for
any mix of lengths.  The driver handles the histogram and the plan only; pieces
find their places by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import put, small_batches
from tickloom.llm.tokens import tokenizer
from tickloom.llm.words import returned

END_ID = 2
WINDOW = 4096
BATCH_BYTES = 1 << 20
#: Pieces of one length ranked by one task.
RANKED_AT_ONCE = 1000
#: Up to so many pieces to be cut (some 80 bytes each) are broadcast to where the ids are; beyond, ids are shuffled.
BROADCAST_CUTS = 100_000
#: A window may be padded by one part in so many before its pieces are cut instead.
SLACK = 128


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Minimise ``|ax - b|`` over ``x >= 0`` by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slope, tol = a.T @ b, 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    while rounds > 0 and (~passive).any() and slope[~passive].max(initial=-1) > tol:
        passive[np.flatnonzero(~passive)[slope[~passive].argmax()]] = True
        while rounds > 0:
            rounds -= 1
            at = np.flatnonzero(passive)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= 0
            step = (x[at][low] / (x[at][low] - best[low] + 1e-300)).min()
            x[at] += step * (best - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            passive[gone if len(gone) else at[low]] = False
            x[~passive] = 0
        slope = a.T @ (b - a @ x)
    return x


def combinations(total: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to ``depth`` positive parts of ``total``."""
    out = [(total,)]
    if depth >= 2:
        out += [(total - b, b) for b in range(1, total // 2 + 1)]
    if depth >= 3:
        out += [(total - b - c, b, c) for c in range(1, total // 3 + 1) for b in range(c, (total - c) // 2 + 1)]
    return out


class _Stock:
    """Pieces not yet placed, by exact length."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)

    def largest(self, most: int) -> int:
        """The greatest length up to ``most`` of which pieces are left, or 0."""
        at = np.flatnonzero(self.left[: most + 1])
        return int(at[-1]) if len(at) else 0

    def take(self, length: int, n: int) -> int:
        """Take ``n`` pieces; the rank of the first."""
        first = int(self.used[length])
        self.used[length] += n
        self.left[length] -= n
        return first


def plan(counts: np.ndarray, window: int = WINDOW, grain: int | None = None, depth: int = 3) -> np.ndarray:
    """Rows ``length, low, high, position, stride`` that place every piece.

    ``counts[n]`` pieces have length ``n``.  Windows lie end to end, so that
    position ``p`` is in sequence ``p // window`` at offset ``p % window``.  The
    piece of rank ``r`` among its length, ``low <= r < high``, begins at
    ``position + stride * (r - low)`` and is cut where a window ends.  The number
    of rows depends on ``window``, not on the counts.
    """
    grain = grain or max(1, window // 128)
    stock, rows, sequence = _Stock(counts), [], 0
    if stock.left[window]:
        rows.append((window, 0, stock.left[window], 0, window))
        sequence = stock.take(window, stock.left[window]) + int(counts[window])
    bins = window // grain
    length_bin = -(-np.arange(window + 1) // grain)
    wanted = np.bincount(length_bin, weights=stock.left, minlength=bins + 1)[1 : bins + 1]
    opened: list[tuple[int, list[tuple[int, int]]]] = []  # repeats, [(length, rank of the first)]
    if wanted.any():
        shapes = [c for c in combinations(bins, depth) if all(wanted[p - 1] for p in c)]
        if shapes:
            a = np.zeros((bins, len(shapes)))
            for j, c in enumerate(shapes):
                for p in c:
                    a[p - 1, j] += 1
            used = np.flatnonzero(wanted)
            scale = wanted.max()
            repeats = np.rint(nnls(a[used], wanted[used] / scale) * scale).astype(np.int64)
            have = wanted.astype(np.int64)
            for j in np.argsort(-repeats, kind="stable"):
                parts = [(p, len(list(g))) for p, g in groupby(shapes[j])]
                n = min(int(repeats[j]), *(int(have[p - 1]) // m for p, m in parts))
                if n <= 0:
                    continue
                for p in shapes[j]:
                    have[p - 1] -= n
                opened += _fill(stock, shapes[j], n, grain)
    opened = [x for some in opened for x in _close(stock, *some, window)]
    while length := stock.largest(window):
        n, most = int(stock.left[length]), window // length
        each = min(n, most)
        times = n // each
        opened += _close(stock, times, [(length, stock.take(length, times)) for _ in range(each)], window)
    apart: list[tuple[int, int, int]] = []  # length, rank of the first, number
    for times, pieces in opened:
        if window - sum(length for length, _ in pieces) > window // SLACK:
            apart += [(length, first, times) for length, first in pieces]
            continue
        offset = 0
        for length, first in pieces:
            rows.append((length, first, first + times, sequence * window + offset, window))
            offset += length
        sequence += times
    position = sequence * window
    for length, first, times in sorted(apart, reverse=True):
        rows.append((length, first, first + times, position, length))
        position += length * times
    return np.array(rows, np.int64).reshape(-1, 5)


def _fill(stock: _Stock, shape: tuple[int, ...], n: int, grain: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``n`` sequences of the shape, from the exact lengths in its bins."""
    slots = []
    for p in shape:
        runs, missing = [], n
        for length in range(p * grain, (p - 1) * grain, -1):
            if missing and stock.left[length]:
                k = min(missing, int(stock.left[length]))
                runs.append((length, stock.take(length, k), k))
                missing -= k
        slots.append(runs)
    edges = sorted({0, *(int(x) for runs in slots for x in np.cumsum([k for *_, k in runs]))})
    out = []
    for lo, hi in zip(edges, edges[1:]):
        pieces = []
        for runs in slots:
            at = 0
            for length, first, k in runs:
                if at <= lo < at + k:
                    pieces.append((length, first + lo - at))
                at += k
        out.append((hi - lo, pieces))
    return out


def _close(stock: _Stock, times: int, pieces: list[tuple[int, int]], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fill what is left of ``times`` equal sequences, largest pieces first."""
    out = []
    gap = window - sum(length for length, _ in pieces)
    while times:
        length = stock.largest(gap) if gap else 0
        if not length:
            out.append((times, pieces))
            break
        n = min(times, int(stock.left[length]))
        first = stock.take(length, n)
        if n == times:
            pieces, gap = [*pieces, (length, first)], gap - length
        else:
            out += _close(stock, n, [*pieces, (length, first)], window)
            pieces, times = [(x, r + n) for x, r in pieces], times - n
    return out


def _cut(path: str, window: int, end_id: int, keep_ids: bool):
    """Pieces on the grid; of full windows, which are never cut again, the ids are kept on request only."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and (not some or size < BATCH_BYTES):
                    some.append((texts[at + len(some)].as_py() or "").encode())
                    size += len(some[-1])
                rows = []
                for doc, raw in zip(ids[at : at + len(some)], encode(some), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, window):
                        part = raw[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, part if keep_ids or len(part) < 4 * window else None))
                at += len(some)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return lambda batches: returned(run(batches))


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, *, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of at most ``window`` ids: ``doc_id, start, length, ids_crc32,
    doc_tokens, ids`` (little-endian unsigned 32-bit; null for full windows
    unless ``keep_ids``)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_cut(path, window, end_id, keep_ids), schema)


def _key() -> Column:
    return F.xxhash64("doc_id", "start", "ids_crc32", "length")


def place(cut: DataFrame, window: int = WINDOW, *, keep_ids: bool = False) -> DataFrame:
    """The pieces ``cut`` with ``sequence_id`` and ``offset``; a piece in which a
    window ends is two rows, each with its own start, length and crc32.

    ``cut`` must be stored (:func:`pack` writes it), as it is read three times.
    Sequence ids run from 0 without gaps and offsets are gapless from 0.  Equal
    rows change places freely, null ids are a value like others, and an empty
    table gives an empty table.
    """
    spark = cut.sparkSession
    counts = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    placed = plan(counts, window)
    # From Arrow, so that no Python worker is started to convert rows.
    table = spark.createDataFrame(pa.table(dict(zip(("length", "low", "high", "position", "stride"), placed.T, strict=True))))
    # Frequent lengths are ranked in several tasks.
    salts = F.array(*[F.lit(int(n)) for n in 1 + counts // RANKED_AT_ONCE])
    own = cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", _key().alias("__key"))
    salted = own.withColumn("__salt", F.pmod(F.col("__key"), F.get(salts, F.col("length").cast("int"))))
    before = salted.groupBy("length", "__salt").count().withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before.drop("count"), ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
    # The plan has a bound set by the window alone, so it may be broadcast.
    found = ranked.join(F.broadcast(table) if len(placed) <= 64 * window else table, "length").where("__rank >= low AND __rank < high")
    found = found.withColumn("__at", F.col("position") + F.col("stride") * (F.col("__rank") - F.col("low")))
    found = found.withColumn("__room", window - F.col("__at") % window)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    over = F.col("__room") < F.col("length")
    found = put(found.select("__key", *names[:5], "__at", "__room"), "places")
    split = found.where(over)
    n_split = split.count() if (placed[:, 4] < window).any() else 0
    ids = cut.where("ids IS NOT NULL").select(_key().alias("__key"), "ids")
    # Equal rows have one key and many places.
    whole = found.where(~over)
    found = (ids.join(whole, "__key").dropDuplicates(["__key", "__at"]) if keep_ids else whole).select(*names, "__at")
    if n_split:
        # The ids of a piece are cut where they are; only the parts' numbers go on, unless ids are wanted.
        split = ids.join(F.broadcast(split) if n_split <= BROADCAST_CUTS else split, "__key")
        part = lambda at, n: F.struct(at.cast("long").alias("at"), n.cast("long").alias("n"))
        split = split.withColumn("__part", F.explode(F.array(part(F.lit(0), F.col("__room")), part(F.col("__room"), F.col("length") - F.col("__room")))))
        split = split.withColumn("ids", F.expr("substring(ids, CAST(4 * __part.at + 1 AS INT), CAST(4 * __part.n AS INT))"))
        split = split.withColumns({"start": F.col("start") + F.col("__part.at"), "length": F.col("__part.n"), "ids_crc32": F.crc32("ids"), "__at": F.col("__at") + F.col("__part.at")})
        found = found.union(split.select("__key", *names, "__at").dropDuplicates(["__key", "__at"]).select(*names, "__at"))
    return found.select(*names, F.floor(F.col("__at") / window).cast("long").alias("sequence_id"), (F.col("__at") % window).alias("offset"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, *, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of every document with its place.

    A null or empty text is the end id alone; a very long one is many pieces.
    Repeated rows are packed each; a null id stays null; an empty table gives no
    rows, and columns other than the id and the text are not read.
    """
    small_batches(docs.sparkSession)
    return place(put(pieces(docs, path, window, end_id, keep_ids=keep_ids, text=text, doc_id=doc_id), "pieces"), window, keep_ids=keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids`` from the rows of
    ``pack(keep_ids=True)``; a group holds at most one window of ids.  A document
    with several pieces in a sequence is listed for each, a null id as null; no
    rows give no rows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )
