"""Removal of long passages that repeat across documents.

Every window of ``k`` consecutive words has a Rabin-Karp hash; windows that can
repeat are counted in Spark by this hash and a second one, which mixes the other
half of the words' digests pair by pair (128 bits together).  The words of
windows that also start in a document of smaller id merge into maximal removal
intervals.  Two exact reductions come first, so that only windows that can
repeat are shuffled:

* documents with equal word sequences are one class: all but the one of the
  smallest id lose every word if they have a window at all;
* equal windows have equal *minimizers* (the least hash of an 8-word run inside
  the window), so a window whose minimizer occurs in one document only cannot
  repeat.  Minimizers are some four hundredths of the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.scratch import doc_key, given_id, put

RUN = 8
#: Up to so many repeated windows (24 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_WINDOWS = 200_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    n, done = len(values) - width + 1, 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values[:n]


def _minimizers(hashes: np.ndarray, k: int) -> np.ndarray:
    """The minimizer of each window of ``k`` words."""
    run = min(RUN, k)
    return _least(W.shingles(hashes, run), k - run + 1)


def _sequence(joined: bytes) -> tuple[int, int, str]:
    """A 128-bit hash of a word sequence, joined by spaces, as two signed longs; and its SHA-256."""
    d = hashlib.sha256(joined)
    raw = d.digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:16], "little", signed=True), d.hexdigest()


def _joined(block: W.WordBlock, i: int, keep: np.ndarray | None = None) -> bytes:
    raw = block.words(i)
    return b" ".join(raw if keep is None else [w for w, k in zip(raw, keep, strict=True) if k])


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, n, sha, mins = [], [], [], [], []
            for block in W.blocks(batch.column(1)):
                for i in range(len(block)):
                    h = block.hashes[block.bounds[i] : block.bounds[i + 1]]
                    a, b, whole = _sequence(_joined(block, i))
                    k1.append(a)
                    k2.append(b)
                    n.append(len(h))
                    sha.append(whole)
                    mins.append(np.unique(_minimizers(h, k)).view(np.int64) if len(h) >= k else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _lists(mins, pa.int64())],
                ["id", "k1", "k2", "n_words", "sha", "mins"],
            )

    return run


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


def _windows(k: int):
    """Hashes of the windows whose minimizer is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, out = batch.column(2), [[], [], [], []]
            for block in W.blocks(batch.column(1)):
                for i in range(len(block)):
                    h = block.hashes[block.bounds[i] : block.bounds[i + 1]]
                    out[0].append(_sequence(_joined(block, i))[0])
                    at = np.zeros(0, np.int64)
                    if len(h) >= k:
                        wanted = shared[block.first + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        at = np.flatnonzero(np.isin(_minimizers(h, k), wanted))
                    hashes = W.window_hashes(h, k)[at]
                    check = W.run_hashes(block.second[block.bounds[i] : block.bounds[i + 1]], k)[at]
                    out[1].append(hashes.view(np.int64))
                    out[2].append(check.view(np.int64))
                    out[3].append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), batch.column(1), _lists(out[1], pa.int64()), _lists(out[2], pa.int64()), _lists(out[3], pa.int32())],
                ["id", "k1", "text", "hashes", "checks", "places"],
            )

    return run


def merge(places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals ``[start, end)`` covered by windows at ``places``."""
    places = np.unique(places)
    if not len(places):
        return places, places
    gap = np.flatnonzero(np.diff(places) > k)
    return places[np.r_[0, gap + 1]], places[np.r_[gap, len(places) - 1]] + k


def _remove(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, starts, ends, texts = [], [], [], []
            for block in W.blocks(batch.column(2), hashed=False):
                for i in range(len(block)):
                    n = block.bounds[i + 1] - block.bounds[i]
                    s, e = merge(batch.column(3)[block.first + i].values.to_numpy(zero_copy_only=False), k)
                    keep = np.ones(n, bool)
                    for x, y in zip(s, e, strict=True):
                        keep[x:y] = False
                    cut.append(int(n - keep.sum()))
                    starts.append(s.astype(np.int64))
                    ends.append(e.astype(np.int64))
                    texts.append(_joined(block, i, keep).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cut, pa.int64()), _lists(starts, pa.int64()), _lists(ends, pa.int64()), pa.array(texts, pa.string())],
                ["id", "k1", "n_removed", "starts", "ends", "kept_text"],
            )

    return run


def repeated(docs: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(profiles, removals)``.

    profiles: ``id, k1, k2, n_words, sha, first`` per row of ``docs``, ``first``
    being the least id with that word sequence.  removals: ``id, k1, n_removed,
    starts, ends, kept_text`` for the class representatives that lose words.
    """
    texts = docs.select(doc_key(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    seen = put(texts.mapInArrow(_profile(k), "id long, k1 long, k2 long, n_words long, sha string, mins array<long>"), "profiles")
    # Stored, so that the join has an exchange of its own on both sides and the copies of one text can be split.
    classes = put(seen.groupBy("k1", "k2", "n_words").agg(F.min("id").alias("first")), "classes")
    profiles = seen.drop("mins").join(classes, ["k1", "k2", "n_words"])

    heads = seen.where(F.col("n_words") >= k).groupBy("k1", "k2", "n_words").agg(F.min("id").alias("id"), F.first("mins").alias("mins"))
    runs = put(heads.select("id", F.explode("mins").alias("run")), "minimizers")
    shared = runs.groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("run")
    wanted = runs.join(shared, "run", "left_semi").groupBy("id").agg(F.collect_set("run").alias("runs"))
    found = put(texts.join(wanted, "id").select("id", "text", "runs").mapInArrow(_windows(k), "id long, k1 long, text string, hashes array<long>, checks array<long>, places array<int>"), "windows")

    each = found.select("id", "k1", F.explode(F.arrays_zip("hashes", "checks", "places")).alias("w")).select("id", "k1", F.col("w.hashes").alias("hash"), F.col("w.checks").alias("check"), F.col("w.places").alias("place"))
    first = each.groupBy("hash", "check").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("hash", "check", "least")
    # Stored, so that the join has an exchange of its own on both sides and hot windows can be split.
    first = put(first, "repeated")
    if first.count() <= BROADCAST_WINDOWS:
        first = F.broadcast(first)
    again = each.join(first, ["hash", "check"]).where("id > least").groupBy("id", "k1").agg(F.collect_set("place").alias("places"))
    cut = found.select("id", "k1", "text").join(again, ["id", "k1"]).select("id", "k1", "text", "places").mapInArrow(_remove(k), "id long, k1 long, n_removed long, starts array<long>, ends array<long>, kept_text string")
    return profiles, cut


def decide(docs: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A null text has no words; a text of fewer than ``k`` words has no window
    and stays whole.  A null id is larger than any other.  Repeated rows give
    repeated results: windows of the same id never remove each other.  Very long
    texts are read whole, an empty table gives no rows, and columns of any other
    name are not read.
    """
    profiles, cut = repeated(docs, k, text, doc_id)
    cut = cut.select("id", "k1", "n_removed", F.sha2("kept_text", 256).alias("cut_sha")).dropDuplicates(["id", "k1"])
    whole = (F.col("id") > F.col("first")) & (F.col("n_words") >= k)
    return (
        profiles.join(cut, ["id", "k1"], "left")
        .select(
            given_id(F.col("id")).alias("doc_id"),
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        )
    )


def intervals(docs: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, end``: maximal runs of words ``[start, end)`` to remove."""
    profiles, cut = repeated(docs, k, text, doc_id)
    copies = profiles.where((F.col("id") > F.col("first")) & (F.col("n_words") >= k)).select("id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    parts = cut.select("id", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("id", F.col("x.starts").alias("start"), F.col("x.ends").alias("end"))
    return parts.union(copies).distinct().select(given_id(F.col("id")).alias("doc_id"), "start", "end")
