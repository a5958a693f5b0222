"""Licence scans by a positional index of rare words.

The index holds, for each word of the templates, the templates and places where
it stands.  One pass over all texts counts in how many documents each of these
words occurs.  In a second pass every document looks up, template by template,
the rarest (highest-IDF) of its words: each occurrence at ``p`` of a word that
stands at ``q`` in the template votes for the template beginning at ``p - q``.  Places
with enough votes are verified by the template's mandatory key phrases, each of
which must stand within a few words of its own place.

The index is as large as the templates, whatever the corpus; counts reach the
driver for the templates' words only.  Texts are read whole, nothing is shuffled
but the counts, and the work of a document is linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rarest words looked up per template, and words by which a key phrase may be off its place.
RAREST, SLACK = 12, 8
STEP_BYTES = 1 << 20
#: Letters to lower case; all but letters, digits and bytes above 127 to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split(text: str) -> list[str]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return [w.decode() for w in text.encode().translate(_FOLD).split()]


@dataclass(frozen=True)
class Template:
    """A licence text, and phrases of it without which it is not that licence."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The notices of public licences.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("you may not use this file except in compliance with the license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("redistribute it and or modify it under the terms of the gnu general public license",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("subject to the terms of the mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
)


def find(words: Sequence, phrase: Sequence) -> list[int]:
    """The places where ``phrase`` stands in ``words``."""
    return [i for i in range(len(words) - len(phrase) + 1) if list(words[i : i + len(phrase)]) == list(phrase)]


class Index:
    """Words of the templates by number, and where each stands."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE):
        self.templates, self.base = tuple(templates), dict(base)
        texts = [split(t.text) for t in templates]
        self.words = sorted({w for t in texts for w in t} | {w for p in base for w in split(p)} | {w for t in templates for p in t.phrases for w in split(p)})
        self.number = {w.encode(): i for i, w in enumerate(self.words)}
        code = lambda ws: np.array([self.number[w.encode()] for w in ws], np.int32)
        self.texts = [code(t) for t in texts]
        self.base_phrases = [(code(split(p)), label) for p, label in base.items()]
        self.phrases = []
        for t, text in zip(templates, texts, strict=True):
            places = [(code(split(p)), find(text, split(p))) for p in t.phrases]
            if not all(at for _, at in places):
                raise ValueError(f"a key phrase of {t.label} is not in its text")
            self.phrases.append([(p, at[0]) for p, at in places])
        #: Votes that a place needs: two fifths of the words looked up, and 2 at least.
        self.need = [max(2, (2 * min(RAREST, len(set(t))) + 4) // 5) for t in texts]

    def ranked(self, frequency: np.ndarray) -> list[np.ndarray]:
        """The distinct words of each template, the rarest first, equal ones by spelling."""
        return [np.array(sorted(set(t.tolist()), key=lambda w: (frequency[w], self.words[w])), np.int32) for t in self.texts]


def _numbers(index: Index, raw: bytes) -> np.ndarray:
    """The numbers of a text's words; -1 for words of no template."""
    folded, parts, at = raw.translate(_FOLD), [], 0
    while at < len(folded):
        end = folded.find(b" ", at + STEP_BYTES) if len(folded) - at > STEP_BYTES else -1
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        parts.append(np.fromiter(map(index.number.get, words, repeat(-1)), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _stand(ids: np.ndarray, phrase: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Starts of ``phrase`` in ``ids`` between ``lo`` and ``hi``, both included."""
    lo, hi = max(lo, 0), len(ids) - len(phrase) if hi is None else min(hi, len(ids) - len(phrase))
    if hi < lo:
        return np.zeros(0, np.int64)
    at = lo + np.flatnonzero(ids[lo : hi + 1] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[ids[at + j] == phrase[j]]
    return at


def _matches(index: Index, ranked: list[np.ndarray], ids: np.ndarray) -> list[tuple[str, float]]:
    """Labels of the verified templates, with the share of their words found in place."""
    present = np.zeros(len(index.words), bool)
    present[ids[ids >= 0]] = True
    found = []
    for t, template in enumerate(index.templates):
        if not all(present[p].all() for p, _ in index.phrases[t]):
            continue
        looked_up = ranked[t][present[ranked[t]]][:RAREST]
        text = index.texts[t]
        votes = [np.flatnonzero(ids == w)[:, None] - np.flatnonzero(text == w)[None, :] for w in looked_up]
        starts, n = np.unique(np.concatenate([v.ravel() for v in votes]), return_counts=True)
        for start in starts[n >= index.need[t]].tolist():
            if all(len(_stand(ids, p, start + q - SLACK, start + q + SLACK)) for p, q in index.phrases[t]):
                lo, hi = max(start, 0), min(start + len(text), len(ids))
                found.append((template.label, float((ids[lo:hi] == text[lo - start : hi - start]).sum()) / len(text)))
    return found


def _count(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(index.words), np.int64)
        for batch in batches:
            for raw in batch.column(0):
                ids = _numbers(index, raw.as_py() or b"")
                seen[np.unique(ids[ids >= 0])] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["word", "n"])

    return run


def _scan(index: Index, ranked: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for raw in batch.column(1):
                ids = _numbers(index, raw.as_py() or b"")
                places = [(label, _stand(ids, phrase)) for phrase, label in index.base_phrases]
                base = {label for label, at in places if len(at)}
                at = np.concatenate([at for _, at in places]) if places else np.zeros(0, np.int64)
                matched = _matches(index, ranked, ids)
                score = 1.0 if base else max((s for _, s in matched), default=0.0)
                rows.append((len(ids), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in matched})), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def frequencies(docs: DataFrame, index: Index, text: str = "text") -> np.ndarray:
    """The number of documents that hold each of the index's words."""
    counted = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(_count(index), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(index.words), np.int64)
    for row in counted.collect():
        out[row["word"]] = row["n"]
    return out


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs``.

    ``n_base`` counts the places of all base phrases, ``first_word`` and
    ``last_word`` are the first and last of these, null without one.  ``labels``
    adds those of the verified templates; both lists are distinct, sorted and
    comma-joined.  ``score`` is 1 with a base phrase, else the largest share of a
    verified template's words that stand in their places, else 0.

    A null or empty text has no words; a very long one is read whole.  Repeated
    rows give repeated rows and count each in the frequencies, a null id stays
    null, words of equal frequency are taken by spelling, an empty table gives no
    rows, and columns of any other name are not read.
    """
    index = Index(templates, base)
    ranked = index.ranked(frequencies(docs, index, text))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(_scan(index, ranked), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
