"""Alignment of two tokenizers over the same texts.

At a space between two visible characters both tokenizers start a token, so a
text falls into segments, and what becomes of a segment does not depend on its
neighbours.  A block of documents becomes its distinct segments, and for each
document the numbers of its segments; common words are tokenised and aligned
once a block.

The tokens of a block's segments stand in two rows, one a tokenizer.  Where
tokens of both end, both rows are cut into groups; the last ids of a group are
linked.  Arrow writes the groups out and puts those of a document's segments
together, so that Spark gets a document's groups as one text and its links as
longs, and keeps no object for a token.

Spark counts the links over the corpus by id pair.  The most frequent pairs, of
which there are at most ``HOT`` by the way they are chosen, are broadcast; every
other pair has less than one ``HOT``-th of all links and is joined by a shuffle,
so no key of that join is hot.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.scratch import put
from tickloom.llm.words import Numbers

#: Pairs with at least one HOT-th of all links, hence at most so many, are broadcast (24 bytes each).
HOT = 100_000
#: Bytes of text whose documents share a block (and one more document).
BLOCK_BYTES = 2 << 20
#: A space between two visible characters below U+0250.
_CUT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
#: Characters that every version of Unicode sorts into letters, digits, spaces and others alike.
_STABLE = re.compile("[\\0-ɏ\u2010-\u2027]*")
#: A segment of such characters that may have another on either side.
_INNER = re.compile("[!-~¡-ɏ](?:[\\0-ɏ\u2010-\u2027]*[!-~¡-ɏ])?")
#: Segments that the first tokenizer reads at once, at most.
RUN = 512
_SPACE = "▁"
#: Bytes of a segment, with the space before it, up to which its ends are bits of a long.
MARKED = 62
SEGMENT = ["a", "a_ends", "a_marks", "b", "b_ends", "b_marks"]
_loaded: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in printable]
        # A byte-level vocabulary writes a printable byte as itself and the n-th other as chr(256 + n).
        byte = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(rest)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        # Segments are independent if no token holds a space after another character; else texts stay whole.
        self.cut = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.quick = self._ranks(path_a, vocabulary)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        #: Each id with each sign that may follow it.
        self.written = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(self.ids)], pa.string())

    def _ranks(self, path_a: str, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        """The first tokenizer by its merges' ranks, which is quicker; None unless these are its ids in order."""
        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in told["model"].get("merges", [])]
        plain = told.get("normalizer") is None and told.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ids = [vocabulary.get(m) for m in merged]
        ranks = {self.bytes_a[i]: i for i in vocabulary.values() if i not in {t["id"] for t in told["added_tokens"]}}
        if not plain or ids != sorted(set(ids), key=lambda x: (x is None, x)) or len(ranks) != 256 + len(merged) or not ids or ids[0] < 256:
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level one, as published
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> list[str]:
        """A text in segments, each without the space before it."""
        return _CUT.split(text) if self.cut else [text]

    def encode(self, segments: list[str]) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """The ids of each segment, after a space, by both tokenizers; and whether both give back its bytes.  If not, it has none."""
        by_b = self.b.encode(segments, num_threads=1) if segments else []
        alone = np.array([not (self.quick is not None and self.cut and _INNER.fullmatch(s)) for s in segments], bool)
        first = alone.copy()
        first[1:] |= alone[:-1]
        first[::RUN] = True
        found = [x for lo, hi in pairwise([*np.flatnonzero(first), len(segments)]) for x in self._run(segments[lo:hi], by_b[lo:hi])]
        rows = [np.concatenate([np.zeros(0, np.int32), *x]) for x in list(zip(*found, strict=True))[:2] or ((), ())]
        n = np.concatenate([np.zeros((2, 0), np.int32), *(x[2] for x in found)], axis=1)
        a, b = (pa.ListArray.from_arrays(pa.array(_bounds(k)), pa.array(x)) for k, x in zip(n, rows, strict=True))
        return a, b, n[0] > 0

    def _run(self, segments: list[str], by_b: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ids of segments that may stand side by side, and how many are each segment's; by the first tokenizer at once."""
        text = " " + " ".join(segments)
        raw = text.encode()
        if self.quick is not None and _STABLE.fullmatch(text):
            ids_a = self.quick.encode_ordinary(text)
        else:
            ids_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids_b = list(chain.from_iterable(by_b))
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            a, b = np.array(ids_a, np.int32), np.array(ids_b, np.int32)
            ends = np.cumsum([len(s.encode()) + 1 for s in segments])
            rows = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            to = [np.searchsorted(x, ends) for x in rows]
            if all((x[at] == ends).all() for x, at in zip(rows, to, strict=True)):
                yield a, b, np.diff(to, prepend=-1).astype(np.int32)
                return
        if len(segments) == 1:
            yield np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((2, 1), np.int32)
        else:
            for s, y in zip(segments, by_b, strict=True):
                yield from self._run([s], [y])


@dataclass
class Block:
    """Documents: their ids and the numbers of their segments; and the ids of each distinct segment by both tokenizers."""

    ids: pa.Array
    parts: list[np.ndarray]
    a: pa.ListArray
    b: pa.ListArray

    def totals(self) -> list[pa.Array]:
        """Tokens of each document by either tokenizer."""
        return [pa.array([int(n[p].sum()) for p in self.parts], pa.int64()) for n in (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (self.a, self.b))]


def pair(path_a: str, path_b: str) -> Pair:
    """The worker's tokenizers, loaded once."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def _bounds(sizes) -> np.ndarray:
    """Where lists of such sizes start and end, laid end to end."""
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_bounds([len(p) for p in parts])), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def _ends(ids: pa.ListArray, size: np.ndarray) -> pa.ListArray:
    """Where each token of each segment ends."""
    offsets = ids.offsets.to_numpy()
    total = np.r_[0, np.cumsum(size[ids.values.to_numpy()])]
    ends = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(ids.offsets, pa.array(ends.astype(np.int32)))


def _marks(ends: pa.ListArray) -> np.ndarray:
    """The ends of each segment as the bits of a number; 0 without ends, or if the segment is longer than ``MARKED``."""
    offsets, at = ends.offsets.to_numpy(), ends.values.to_numpy().astype(np.int64)
    found = np.zeros(len(ends), np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        bits = np.left_shift(np.int64(1), np.minimum(at, MARKED))
        found[some] = np.where(at[offsets[1:][some] - 1] <= MARKED, np.bitwise_or.reduceat(bits, offsets[:-1][some]), 0)
    return found


def _text(raw: bytes | None) -> str | None:
    """A text whose bytes are not UTF-8 has no tokens."""
    try:
        return raw.decode() if raw else None
    except UnicodeDecodeError:
        return None


def _one(array: pa.Array) -> pa.ListArray:
    """A column of one row that holds ``array``."""
    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)


def _blocks(batches: Iterator[pa.RecordBatch], both: Pair) -> Iterator[Block]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK_BYTES, "right")))
            some = batch.slice(first, last - first)
            known = Numbers()
            parts = [known.of(both.segments(t)) if (t := _text(x.as_py())) else np.zeros(0, np.int64) for x in some.column(1)]
            a, b, good = both.encode(list(known))
            yield Block(pa.concat_arrays([some.column(0)]), [p if good[p].all() else p[:0] for p in parts], a, b)
            first = last


def _mapped(path_a: str, path_b: str, made: Callable[[Block, Pair], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        both = pair(path_a, path_b)
        for block in _blocks(batches, both):
            yield made(block, both)

    return run


def _own(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))


def _segments(block: Block, both: Pair) -> pa.RecordBatch:
    ends = _ends(block.a, both.size_a), _ends(block.b, both.size_b)
    marks = [pa.array(_marks(x)) for x in ends]
    columns = (block.ids, *block.totals(), _lists(block.parts), block.a, ends[0], marks[0], block.b, ends[1], marks[1])
    return pa.RecordBatch.from_arrays([_one(c) for c in columns], ["ids", "n_a", "n_b", "parts", *SEGMENT])


def tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks of documents: ``ids``, ``n_a``, ``n_b`` (its tokens) and ``parts`` of each, the last being numbers of segments;
    and ``a, a_ends, a_marks, b, b_ends, b_marks`` of each distinct segment, with the space before it: for a look at
    the tokens themselves, which :func:`aligned` does not give."""
    lists = ", ".join(f"{c} array<array<int>>" for c in ("parts", "a", "a_ends", "b", "b_ends"))
    longs = ", ".join(f"{c} array<long>" for c in ("ids", "n_a", "n_b", "a_marks", "b_marks"))
    order = ["ids", "n_a", "n_b", "parts", *SEGMENT]
    return _own(docs, text, doc_id).mapInArrow(_mapped(path_a, path_b, _segments), ", ".join(sorted(f"{longs}, {lists}".split(", "), key=lambda c: order.index(c.split()[0]))))


def _joined(texts: pa.StringArray, bounds: np.ndarray) -> pa.StringArray:
    """The texts from each bound to the next, as one."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[bounds] if len(texts) else np.zeros(len(bounds), np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at), data if data is not None else pa.py_buffer(b""))


def _cut(a: pa.ListArray, b: pa.ListArray, both: Pair) -> tuple[pa.StringArray, pa.ListArray]:
    """For each segment its groups, ``a1,a2|b1;a3|b2;``, and the last ids of each group as one number."""
    (from_a, ids_a), (from_b, ids_b) = ((x.offsets.to_numpy(), x.values.to_numpy()) for x in (a, b))
    # Both rows have the same bytes, and each segment's last tokens end together.
    ends_a, ends_b = np.cumsum(both.size_a[ids_a]), np.cumsum(both.size_b[ids_b])
    seen = np.zeros(ends_a[-1] + 1 if len(ends_a) else 0, np.int8)
    seen[ends_a] = 1
    seen[ends_b] += 2
    last_a, last_b = seen[ends_a] == 3, seen[ends_b] == 3
    at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    group_a, group_b = (np.r_[0, np.cumsum(x)] for x in (last_a, last_b))  # of each token, and one more
    # A group's tokens of the first row are written before those of the second.
    order = np.empty(len(ids_a) + len(ids_b), np.int32)
    order[np.arange(len(ids_a)) + np.r_[0, at_b + 1][group_a[:-1]]] = ids_a + both.ids * last_a
    order[np.arange(len(ids_b)) + (at_a + 1)[group_b[:-1]]] = ids_b + 2 * both.ids * last_b
    groups = _joined(both.written.take(pa.array(order)), from_a + from_b)
    links = ids_a[at_a].astype(np.int64) << 32 | ids_b[at_b]
    return groups, pa.ListArray.from_arrays(pa.array(group_a[from_a].astype(np.int32)), pa.array(links))


def _documents(block: Block, both: Pair) -> pa.RecordBatch:
    groups, links = _cut(block.a, block.b, both)
    parts = _lists(block.parts)
    bounds = parts.offsets.to_numpy()
    groups, links = groups.take(parts.values), links.take(parts.values)
    whole = pa.ListArray.from_arrays(pa.array(links.offsets.to_numpy()[bounds]), links.values)
    return pa.RecordBatch.from_arrays([block.ids, *block.totals(), pc.utf8_rtrim(_joined(groups, bounds), characters=";"), whole], ["id", "n_a", "n_b", "groups", "links"])


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, n_a, n_b, groups, links`` of each document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``; ``links[i]`` are the ids whose tokens end
    at the i-th common end, as one number, the first above the 32 bits of the
    second.  Documents without tokens have an empty text and no links.
    """
    return _own(docs, text, doc_id).mapInArrow(_mapped(path_a, path_b, _documents), "id long, n_a long, n_b long, groups string, links array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """``link, n, best``: links that hold each id pair, and whether no other pair of its B id has more."""
    counted = links.groupBy("link").agg(F.count("*").alias("n")).withColumn("b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    A text that is null, empty, or that either tokenizer changes has no tokens:
    zeros and an empty digest.  Very long texts are tokenised whole.  Repeated
    rows count each and give repeated rows, a null id stays null, ties for a B
    id's best are all best, an empty table gives no rows, and columns of any
    other name are not read.
    """
    slim = aligned(docs, path_a, path_b, text, doc_id).select(
        F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"),
        F.when(F.size("links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "links")
    slim = put(slim, "aligned")
    links = slim.select("row", F.explode("links").alias("link"))
    counts = put(pair_counts(links), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT >= total
    hot = links.join(F.broadcast(counts.where(often)), "link", "left")
    sums = lambda rows: rows.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    rare = hot.where("n IS NULL").select("row", "link").join(counts.where(~often), "link")
    scored = sums(hot.where("n IS NOT NULL")).union(sums(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return slim.drop("links").join(scored, "row", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
