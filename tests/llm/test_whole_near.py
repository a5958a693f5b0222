"""The pipeline's near-duplicate stage links at 0.8."""

from fractions import Fraction

from test_llm import copies, sets_of, table

import corpus_pipeline
from tickloom.llm import neardup


def kept_by_brute_force(rows, percent):
    docs = {i: sets_of(t) for i, t in rows}
    group = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and docs[a] and 100 * len(docs[a] & docs[b]) >= percent * len(docs[a] | docs[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return {i for i, g in group.items() if i == g}


def test_stage_links_at_four_fifths(spark):
    rows = copies(6, 12, seed=4)
    at80, at85 = kept_by_brute_force(rows, 80), kept_by_brute_force(rows, 85)
    assert at80 < at85
    docs = table(spark, rows)
    got = {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()}
    assert got == at80
    assert {r.doc_id for r in neardup.deduplicate(docs).collect()} == at85


def test_bands_at_four_fifths_miss_no_more():
    t = Fraction(80, 100)
    assert (1 - t**5) ** 37 < 1e-6 < (1 - t**5) ** 25


def thue_morse(n=1024):
    """Two words of equal length whose polynomial hashes modulo 2 ** 64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_are_told_apart(spark):
    from tickloom.llm import neardup, rules, substring

    t, u = thue_morse()
    frame = lambda *texts: spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    near = neardup.classes(frame(f"x y z {t} q r", f"x y z {u} q r", t, u)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near) == [(0, 2, 0), (1, 2, 1), (2, 1, 2), (3, 1, 3)]
    assert neardup.deduplicate(frame(f"x y z {t} q r", f"x y z {u} q r")).count() == 2
    rest = " ".join(f"w{i}" for i in range(49))
    assert [r.n_removed for r in substring.decide(frame(f"{t} {rest}", f"{u} {rest}")).orderBy("doc_id").collect()] == [0, 0]
    # The same pattern over words instead of letters, within windows.
    long = [" ".join("ab"[c == "b"] for c in x[:32]) + " " + " ".join(f"w{i}" for i in range(18)) for x in (t, u)]
    assert [r.n_removed for r in substring.decide(frame(*long)).orderBy("doc_id").collect()] == [0, 0]
    assert rules.ledger(frame(f"{t} a b {u} a b", f"{t} a b {t} a b")).orderBy("doc_id").collect()[0].n_repeat_words == 0
    assert rules.ledger(frame(f"{t} a b {t} a b")).first().n_repeat_words == 6


def test_links_rest_on_words_not_on_hashes(spark, monkeypatch):
    """With hashes that are all equal, candidates are many, and links still right."""
    import numpy as np
    import pyarrow as pa

    from fractions import Fraction
    from tickloom.llm import neardup
    from tickloom.llm import words as W

    monkeypatch.setattr(W, "digests", lambda words: np.ones((len(list(words)), 2), np.uint64))
    texts = ["a b c d e f g h", "p q r s t u v w", "a b c d e f g i", "a b", "a c", "b a"]
    n = len(texts)
    table = pa.table({"id": pa.array(range(n), pa.int64()), "side": pa.array([0] * n, pa.int32()), "part": pa.array(range(n), pa.int64()), "text": texts})
    got = neardup._compare(5, Fraction(1, 2), 1e-6)(table).to_pylist()
    assert got == [{"a": 2, "b": 0}]


def test_grams_and_numbers():
    import random

    from tickloom.llm import words as W

    r = random.Random(2)
    for many in (3, 5000):
        words = [f"w{r.randrange(many)}".encode() for _ in range(9000)]
        known = W.Numbers()
        ids = known.of(words)
        assert (known.of(words[::-1]) == ids[::-1]).all()
        for k in (1, 3, 5, 40):
            runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            got = W.grams(ids, k).tolist()
            assert len(set(zip(runs, got))) == len(set(runs)) == len(set(got))
            assert len(set(zip(runs, W.run_hashes(W.digests(words)[:, 1], k).tolist()))) == len(set(runs))
