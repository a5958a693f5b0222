import pyarrow as pa

from tickloom.llm import tokens, words
from tickloom.llm.packing import pack
from tickloom.llm.queries import tokenizer_path


def test_a_worker_keeps_the_words_of_one_kernel():
    encode = tokens.tokenizer(tokenizer_path()).encode
    first = encode([b"some plain words, and some more"])
    assert len(tokens.tokenizer(tokenizer_path()).cache) > 0
    lanes = words.digests([b"one", b"two"]).copy()
    assert not tokens.tokenizer(tokenizer_path()).cache and len(words._digests) == 2
    assert encode([b"some plain words, and some more"]) == first
    assert not words._digests and (words.digests([b"one", b"two"]) == lanes).all()


def test_arrow_memory_goes_back_at_the_end(monkeypatch):
    class Pool:
        n = 0

        def release_unused(self):
            self.n += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    rows = words.returned(iter([1, 2]))
    assert next(rows) == 1 and pool.n == 0
    assert list(rows) == [2] and pool.n == 1


def test_texts_reach_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a b c d")], "doc_id long, text string")
        found = []
        for rows, most in (("10000", 1000), ("0", 1000), ("2", 2)):
            spark.conf.set(name, rows)
            found.append(sorted((r.doc_id, r.ids_crc32, r.length) for r in pack(docs, tokenizer_path()).collect()))
            assert int(spark.conf.get(name)) == most
        assert found[0] == found[1] == found[2] and len(found[0]) == 3
    finally:
        spark.conf.set(name, given)
