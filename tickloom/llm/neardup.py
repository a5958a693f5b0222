"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Documents with equal shingle sets are one class (a group-by of a 128-bit
   hash of the set, made from 128-bit hashes of words); only its smallest id goes on.
2. MinHash signatures are cut into bands.  Documents that share a band are
   candidates; stars within buckets join them into coarse clusters without
   listing pairs.
3. A cluster is compared in blocks of bounded size.  Within a block, candidates
   are compared signature batch by batch, and a pair goes when the posterior
   probability of reaching the threshold falls below the chosen miss probability.
   Survivors are verified exactly on the full sets of shingles, compared word by
   word and not by hash; pairs that are connected already are skipped.
4. A cluster of several blocks is first compared inside each block, then by one
   representative of each connected part.  That leaves one large part and few
   others in a group of true copies.  Only documents outside the largest part
   are then compared with all the cluster's, by blocks of the cluster or by
   those of its buckets that hold several parts, whichever moves fewer texts:
   every candidate pair of different parts is seen.
5. Components of the links are the groups.

A pair at the threshold shares a band with probability 1 - (1 - t^rows)^bands:
at t = 0.85 it is missed with 5e-7 by 25 bands of 5 rows, at t = 0.8 by 37.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.graph import components
from tickloom.llm.scratch import put

BANDS, ROWS = 25, 5
K = 5
THRESHOLD = Fraction(85, 100)
MISS = 1e-6
#: Documents, shingles and bytes of text of one block.
BLOCK, BLOCK_SHINGLES, BLOCK_BYTES = 512, 4_000_000, 32 << 20
#: Up to so many large clusters, or documents to be compared (some 50 bytes each), are broadcast; beyond, they are joined by shuffle.
BROADCAST_CLUSTERS = 100_000

#: Bands for which there are hash functions; the first BANDS are the same for all.
MOST_BANDS = 64

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MUL = np.r_[_MUL, _rng.integers(1, 1 << 62, (MOST_BANDS - BANDS) * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_ADD = np.r_[_ADD, _rng.integers(0, 1 << 63, (MOST_BANDS - BANDS) * ROWS, dtype=np.uint64)]


def node(doc_id: str = "doc_id", text: str = "text") -> Column:
    """An id that is never null: rows without one get one of the largest 2**61 by text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))), 3))


def shingle_set(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``k`` words are one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(W.shingles(hashes, min(k, len(hashes))))


def signature(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    n = bands * ROWS
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _MUL[:n] + _ADD[:n]).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band for each row of signatures."""
    s = signatures.reshape(-1, bands, ROWS).astype(np.uint64)
    key = W.mix(np.arange(bands, dtype=np.uint64) + np.uint64(11)) + np.zeros((len(s), 1), np.uint64)
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9FB21C651E98DF25) + s[:, :, r])
    return key


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of ``n`` equal hashes with which a pair stays.

    Under a uniform prior the similarity after ``m`` of ``n`` matches is
    Beta(m + 1, n - m + 1), which exceeds t with the probability that
    Binomial(n + 1, t) is at most m.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, miss: float, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs ``left[a], right[b]`` after all signature batches, with matches."""
    matches = np.zeros(len(a), np.int32)
    for at in range(0, bands * ROWS, bands):
        stop = at + bands
        for lo in range(0, len(a), 65536):
            some = slice(lo, lo + 65536)
            matches[some] += (left[a[some], at:stop] == right[b[some], at:stop]).sum(1, dtype=np.int32)
        stay = matches >= least_matches(stop, threshold, miss)
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b, matches


def _summary(k: int, bands: int = BANDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            for block in W.blocks(batch.column(1), lower=True):
                for i in range(len(block)):
                    own = slice(block.bounds[i], block.bounds[i + 1])
                    found = shingle_set(block.hashes[own], k)
                    d = hashlib.blake2b(found.tobytes() + shingle_set(block.second[own], k).tobytes(), digest_size=16).digest()
                    n.append(len(found))
                    k1.append(int.from_bytes(d[:8], "little", signed=True))
                    k2.append(int.from_bytes(d[8:], "little", signed=True))
                    keys.append(band_keys(signature(found, bands), bands)[0].view(np.int64) if len(found) else np.zeros(0, np.int64))
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(x) for x in keys], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists, batch.column(2), size], ["id", "n", "k1", "k2", "bands", "lost", "bytes"])

    return lambda batches: W.returned(run(batches))


class _Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


class _Sets:
    """The exact shingle sets of some documents, as numbers that are equal for equal shingles only."""

    def __init__(self, texts: pa.ChunkedArray, wanted: np.ndarray, k: int):
        known = W.Numbers()
        short: dict[tuple[int, ...], int] = {}
        self.sets, ids = {}, []
        for block in W.blocks(texts.take(pa.array(wanted)), lower=True, hashed=False):
            ids += [known.of(block.words(i)) for i in range(len(block))]
        size = np.array([len(x) for x in ids], np.int64)
        # Runs over the end of a document are made with the others, and not used.
        runs = W.grams(np.concatenate(ids), k) if ids else np.zeros(0, np.int64)
        for at, n, x, own in zip(np.cumsum(size) - size, size, ids, wanted.tolist(), strict=True):
            if n >= k:
                self.sets[own] = np.unique(runs[at : at + n - k + 1])
            else:  # fewer words are one shingle, none are none
                key = tuple(x.tolist())
                self.sets[own] = np.array([-1 - short.setdefault(key, len(short))] if key else [], np.int64)

    def alike(self, x: int, y: int, num: int, den: int) -> bool:
        """Whether the similarity of two documents is at least ``num / den``."""
        a, b = self.sets[x], self.sets[y]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _compare(k: int, threshold: Fraction, miss: float, bands: int = BANDS):
    """Links ``a, b`` between the rows of a group.

    Rows of side 0 are compared among themselves, those of side 1 with those of
    side 2; rows of one ``part`` are connected already.
    """
    num, den = threshold.numerator, threshold.denominator

    def run(table: pa.Table) -> pa.Table:
        ids, side, part = (table[c].to_numpy() for c in ("id", "side", "part"))
        sets = []
        for x in W.blocks(table["text"], lower=True):
            sets += [shingle_set(x.hashes[x.bounds[i] : x.bounds[i + 1]], k) for i in range(len(x))]
        signs = np.array([signature(s, bands) if len(s) else np.zeros(bands * ROWS, np.uint32) for s in sets])
        keys = band_keys(signs, bands)
        among = not side.any()
        one = np.flatnonzero(side == 0 if among else side == 1)
        two = one if among else np.flatnonzero(side == 2)
        shared = np.zeros((len(one), len(two)), bool)
        for band in range(bands):
            shared |= keys[one, band][:, None] == keys[two, band][None, :]
        shared &= part[one][:, None] != part[two][None, :]
        a, b = np.nonzero(np.triu(shared, 1) if among else shared)
        a, b, matches = survivors(signs[one], signs[two], a, b, float(threshold), miss, bands)
        sets.clear()
        exact = _Sets(table["text"], np.unique(np.r_[one[a], two[b]]), k)
        forest, links = _Forest(), []
        for p in np.argsort(-matches, kind="stable"):
            x, y = int(one[a[p]]), int(two[b[p]])
            if forest.root(int(part[x])) == forest.root(int(part[y])):
                continue
            if exact.alike(x, y, num, den):
                forest.join(int(part[x]), int(part[y]))
                links.append((int(ids[x]), int(ids[y])))
        if among:  # each linked row with the least of its part
            least: dict[int, int] = {}
            for i, p in zip(ids.tolist(), part.tolist(), strict=True):
                r = forest.root(p)
                least[r] = min(i, least.get(r, i))
            links = sorted({(i, least[forest.root(p)]) for i, p in zip(ids.tolist(), part.tolist(), strict=True) if i != least[forest.root(p)]})
        columns = list(zip(*links, strict=True)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return run


def _blocks(n: str, size: str = "size", size_bytes: str = "bytes") -> Column:
    """The number of blocks of some documents, by their number, shingles and bytes."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES), F.ceil(F.col(size_bytes) / BLOCK_BYTES)).cast("int")


def _place(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def links(texts: DataFrame, heads: DataFrame, k: int = K, threshold: Fraction = THRESHOLD, miss: float = MISS, n_bands: int = BANDS) -> DataFrame:
    """Pairs ``a, b`` of connected documents that span each group.

    ``texts``: ``id, text``; ``heads``: ``id, n, bytes, bands`` of the classes' smallest ids.
    """

    def found(rows: DataFrame) -> DataFrame:
        """The links of dealt rows; where they are few, texts are picked where they are read."""
        rows = put(rows, "dealt")
        chosen = texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_CLUSTERS else rows, "id")
        return put(chosen.groupBy("cluster", "i", "j").applyInArrow(_compare(k, threshold, miss, n_bands), "a long, b long"), "links")

    bands = heads.select("id", F.explode("bands").alias("band"))
    buckets = put(bands.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1"), "buckets")
    inside = put(bands.join(buckets, "band").select("band", "id", "hub"), "inside")
    cluster = components(inside.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    sized = put(cluster.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(heads.select("id", "n", "bytes"), "id"), "clusters")
    totals = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.sum("bytes").alias("bytes"))
    large = put(totals(sized, "cluster").withColumn("blocks", _blocks("m")).where("blocks > 1"), "large")
    n_large = large.count()
    few = F.broadcast if n_large <= BROADCAST_CLUSTERS else (lambda df: df)

    # Inside each block.
    dealt = sized.join(few(large.select("cluster", "blocks")), "cluster", "left").withColumn("i", F.coalesce(_place(F.col("blocks")), F.lit(0)))
    first = found(dealt.select("id", "cluster", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("id").alias("part")))
    if not n_large:
        return first
    # One representative of each part.
    own = sized.join(few(large.select("cluster")), "cluster", "left_semi")
    parts = put(own.join(first.select(F.col("a").alias("id"), F.col("b").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id")), "parts")
    chosen = parts.where("id = part")
    several = totals(chosen, "cluster").withColumn("blocks", _blocks("m")).where("m > 1").select("cluster", "blocks")
    second = found(chosen.join(few(several), "cluster").select("id", "cluster", _place(F.col("blocks")).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("id").alias("part")))
    parts = put(parts.join(second.select(F.col("a").alias("part"), F.col("b").alias("now")), "part", "left").withColumn("part", F.coalesce("now", "part")).drop("now"), "parts")
    # Those outside a cluster's largest part, with all.
    counted = parts.groupBy("cluster", "part").agg(F.count("*").alias("m"))
    largest = put(counted.groupBy("cluster").agg(F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("n_parts")).where("n_parts > 1").select("cluster", F.col("top.part").alias("top")), "largest")
    if largest.isEmpty():
        return first.union(second)
    open_ = parts.join(few(largest), "cluster").withColumn("rest", F.col("part") != F.col("top"))

    def shares(rows: DataFrame, by: str) -> DataFrame:
        """For each group the blocks of the rest and of all, and the texts that they move."""
        outside = lambda c: F.sum(F.when(F.col("rest"), F.col(c)).otherwise(0))
        sums = rows.groupBy(by).agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), outside("n").alias("r_size"), outside("bytes").alias("r_bytes"), F.sum(F.col("rest").cast("long")).alias("r"), F.count_distinct("part").alias("n_parts"))
        sums = sums.where("n_parts > 1").withColumns({"all_blocks": _blocks("m"), "rest_blocks": _blocks("r", "r_size", "r_bytes")})
        return sums.select(by, "all_blocks", "rest_blocks", (F.col("m") * F.col("rest_blocks") + F.col("r") * F.col("all_blocks")).alias("moved"))

    whole = shares(open_, "cluster")
    in_bucket = put(inside.select("band", "id").join(open_, "id"), "mixed")
    apart = put(shares(in_bucket, "band"), "apart")
    cost = in_bucket.select("band", "cluster").distinct().join(apart, "band").groupBy("cluster").agg(F.sum("moved").alias("apart"))
    whole = put(whole.join(cost, "cluster", "left").withColumn("whole", F.col("moved") <= F.coalesce("apart", F.lit(0))), "whole")
    by_cluster = open_.join(few(whole.where("whole").select("cluster", "all_blocks", "rest_blocks")), "cluster")
    by_bucket = in_bucket.join(few(whole.where("NOT whole").select("cluster")), "cluster", "left_semi").join(apart.drop("moved"), "band").withColumn("cluster", F.col("band"))
    both = by_cluster.select("id", "cluster", "part", "rest", "all_blocks", "rest_blocks", F.lit(0).alias("kind")).union(by_bucket.select("id", "cluster", "part", "rest", "all_blocks", "rest_blocks", F.lit(1).alias("kind")))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    ones = both.where("rest").select("id", "cluster", (_place(F.col("rest_blocks")) * 2 + F.col("kind")).alias("i"), every("all_blocks").alias("j"), F.lit(1).alias("side"), "part")
    twos = both.select("id", "cluster", "kind", every("rest_blocks").alias("i"), _place(F.col("all_blocks")).alias("j"), F.lit(2).alias("side"), "part")
    third = found(ones.union(twos.select("id", "cluster", (F.col("i") * 2 + F.col("kind")).alias("i"), "j", "side", "part")))
    return first.union(second).union(third)


def classes(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD, miss: float = MISS, text: str = "text", doc_id: str = "doc_id", n_bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document.

    Documents without words are linked with nothing; very long ones are compared
    on their whole sets.  Rows that repeat an id are one document, linked through
    any of its texts; identical rows give one row.  Rows with a null id are told
    apart by their texts, and come after all ids below 2**63 - 2**61; a group
    named by such a row has a null ``component_id``.  An empty table gives no
    rows, and columns of any other name are not read.
    """
    texts = docs.select(node(doc_id, text).alias("id"), F.col(text).cast("string").alias("text"), F.col(doc_id).isNull().alias("lost"))
    seen = put(texts.mapInArrow(_summary(k, n_bands), "id long, n long, k1 long, k2 long, bands array<long>, lost boolean, bytes long"), "shingles")
    sets = seen.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("head"), F.min(F.struct("id", "lost"))["lost"].alias("lost"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes"))
    sets = put(sets, "sets")
    heads = sets.select(F.col("head").alias("id"), "n", "bytes", "bands")
    found = links(texts.select("id", "text"), heads, k, threshold, miss, n_bands)
    groups = components(found).select(F.col("node").alias("head"), "component")
    named = sets.drop("bands").join(groups, "head", "left").select("k1", "k2", "n", F.coalesce("component", "head").alias("component"), F.when(F.col("component").isNull(), F.col("lost")).alias("no_name"))
    heads_lost = put(sets.where("lost").select(F.col("head").alias("component"), F.lit(True).alias("nameless")), "lost")
    if not heads_lost.isEmpty():
        named = named.join(heads_lost, "component", "left").withColumn("no_name", F.coalesce("nameless", "no_name")).drop("nameless")
    # An id with several texts is in the group of each: the least one names it.
    out = seen.select("id", "n", "k1", "k2", "lost").join(named, ["k1", "k2", "n"], "left").select("id", "lost", "n", F.coalesce("component", "id").alias("component"), F.when(F.col("component").isNull(), F.col("lost")).otherwise(F.coalesce("no_name", F.lit(False))).alias("no_name")).distinct()
    return out.select(F.when(~F.col("lost"), F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~F.col("no_name"), F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"), F.col("id").alias("node"))


def deduplicate(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD, miss: float = MISS, text: str = "text", doc_id: str = "doc_id", n_bands: int = BANDS) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group.

    All columns stay.  Rows that repeat the id that stays are all kept, texts
    without words too; nulls, very long texts and empty tables as in :func:`classes`.
    """
    kept = classes(docs, k, threshold, miss, text, doc_id, n_bands).where("kept").select(F.col("node").alias("__tl_node")).distinct()
    own = docs.withColumn("__tl_node", node(doc_id, text))
    return own.join(kept, "__tl_node", "left_semi").drop("__tl_node")
