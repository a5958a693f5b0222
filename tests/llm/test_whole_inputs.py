"""Pipeline stages on odd inputs, and texts of many megabytes through the operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import VOCAB, as_pairs, odd_docs, split, table

import corpus_pipeline as P
from tickloom.llm import exactdup, linedup, mixing, neardup, packing, quality, rules, scratch, substring


@pytest.fixture
def few_labels(spark, tmp_path):
    table(spark, [(1, 0), (4, 1), (4, 0), (None, 1), (9, None), (10, 1), (13, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_odd_and_empty_tables(spark, few_labels, name, stage):
    docs = odd_docs(spark)
    out = stage(spark, docs, few_labels)
    assert stage(spark, docs.limit(0), few_labels).count() == 0
    if name == "sequence_packing":
        assert {r.doc_id for r in out.collect()} == {i for i, _ in as_pairs(docs)}
        return
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(got) <= set(as_pairs(docs))
    if name == "exact_dedup":
        assert max(got.values()) == 1
    if name == "minhash_near_dedup":
        assert (1, None) in got and (2, "") in got and 6 not in {i for i, _ in got}


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(6)
    lines = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(9)) for _ in range(180_000)]
    text = "\n".join(lines)
    assert len(text) > 9 << 20
    return text


def test_long_texts_through_the_operators(spark, long_text):
    n = len(split(long_text))
    docs = table(spark, [(1, long_text, "s"), (2, long_text + " end", "s"), (3, long_text.replace("\n", "\n\n"), "s"), (4, "short", None)], "doc_id long, text string, source string").repartition(3).cache()
    led = {r.doc_id: r for r in rules.ledger(docs).collect()}
    assert led[1].n_words == n and led[1].word_chars == sum(map(len, split(long_text))) and led[3].n_lines == 2 * led[1].n_lines - 1
    assert {(r.doc_id, r.keep_id) for r in exactdup.decide(docs).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4)}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs).collect()}
    assert near[1] == (n - 4, 1) and near[2] == (n - 3, 1) and near[3] == near[1] and near[4] == (1, 4)
    cut = {r.doc_id: r.n_removed for r in substring.decide(docs).collect()}
    assert cut == {1: 0, 2: n, 3: n, 4: 0}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in linedup.strip(docs).collect()}
    assert lines[1][0] == 180_000 and lines[1][1] > 170_000 and lines[3][1] == 0
    packed = packing.pack(docs, VOCAB)
    assert packed.where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()[0] == packed.where("doc_id = 1").first().doc_tokens
    model = quality.train(docs, table(spark, [(1, 1)], "doc_id long, quality int"))
    assert quality.score(docs, model).count() == 4
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_intermediate_tables_can_be_dropped(spark):
    kept = scratch.put(table(spark, [(1, "a")]), "probe")
    path, store = scratch._path(spark, scratch._written[kept])
    assert store.exists(path) and kept.count() == 1
    scratch.drop(kept)
    assert not store.exists(path)
