import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import alignment as A

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """Rows by plain Python, each text tokenised whole."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    good = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, n = {chr(x): x for x in good}, 0
    for x in range(256):
        if x not in good:
            byte[chr(256 + n)] = x
            n += 1

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return [], [], [], []
        x = a.encode(" " + text, add_special_tokens=False)
        ids_a, ids_b = x.ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [of_b(i) for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return [], [], [], []
        ends_a, ends_b, at = [], [], 0
        for t in bytes_a:
            ends_a.append(at := at + len(t))
        at = 0
        for t in bytes_b:
            ends_b.append(at := at + len(t))
        return ids_a, ends_a, ids_b, ends_b

    def run(rows):
        made, links = [], Counter()
        for i, text in rows:
            ids_a, ends_a, ids_b, ends_b = one(text)
            at_a, at_b = {e: n for n, e in enumerate(ends_a)}, {e: n for n, e in enumerate(ends_b)}
            groups, own, pa, pb = [], [], 0, 0
            for e in sorted(set(ends_a) & set(ends_b)):
                qa, qb = at_a[e] + 1, at_b[e] + 1
                groups.append(",".join(map(str, ids_a[pa:qa])) + "|" + ",".join(map(str, ids_b[pb:qb])))
                own.append((ids_a[qa - 1], ids_b[qb - 1]))
                pa, pb = qa, qb
            links.update(own)
            made.append((i, len(ids_a), len(ids_b), groups, own))
        best = {}
        for (_, y), n in links.items():
            best[y] = max(n, best.get(y, 0))
        return [
            (i, na, nb, len(g), len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, na, nb, g, own in made
        ]

    return run


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(spark, brute, rows):
    got = A.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "it's we 'll 's", "x▁y", "<|endoftext|> a <|endoftext|>", "<0x41> <s>", "\n\n a\tb\r\n", "Zürich straße naïve", "中文 文本", "😀 👩‍👩‍👧 é é",
    " a  b", "\x85a \x1c b \x1d", "\x00 a", "1234 567,890.12 --- ***", "don't — “stop” …", "a​b 　 c", "word " * 40, "Ġġ Ċ", "ﬁ ½ Ⅷ",
]


def test_odd_texts(spark, brute):
    same(spark, brute, [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b")])


def test_random_texts(spark, brute):
    r = random.Random(3)
    parts = ["the", "Haus", " ", "  ", "\n", "'s", "été", "中", "é", "-", "…", "42", "é", " ", "­", "ab", "XY", "😀", ".", "ɏ"]
    same(spark, brute, [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 60)))) for i in range(400)])


def test_rare_and_frequent_pairs(spark, brute, monkeypatch):
    # With few hot pairs most links take the shuffled join.
    monkeypatch.setattr(A, "HOT", 20)
    r = random.Random(4)
    same(spark, brute, [(i, " ".join(r.choice(["the", "a", f"w{r.randrange(300)}", "Über"]) for _ in range(80))) for i in range(60)])


def test_empty_table_long_text_and_clashing_columns(spark, brute):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefgh ,.") for _ in range(12)) for _ in range(60_000)) + "x" * 3000
    rows = [(1, text), (2, "short text")]
    odd = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, a int, row int")
    assert sorted(map(tuple, A.align(odd, *PATHS).collect())) == sorted(brute(rows))


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert tuple(A.align(docs, *PATHS).first()) == (1, 0, 0, 0, 0, 0, 0, "")


def test_query_against_brute_force(spark, sf, brute):
    import __spark_entry__

    got = __spark_entry__.queries()["op12_cross_tokenizer_alignment"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_ends_as_bits_or_not(spark, brute):
    # Segments with their space of 61 to 64 bytes and more, on both sides of what a long can hold, and all pairs of odd lengths.
    r = random.Random(6)
    words = ["".join(r.choice("abcdeno,.$é") for _ in range(n)) for n in [*range(1, 12), *range(50, 70)] for _ in range(3)]
    same(spark, brute, [(i, " ".join(words[i : i + 4])) for i in range(len(words))])


def test_one_number_marks_the_ends_and_one_look_a_part(spark):
    row = A.tokens(spark.createDataFrame([(1, "the the and, " + "x" * 80)], "doc_id long, text string"), *PATHS).first()
    assert [sum(1 << e for e in ends) if ends[-1] <= A.MARKED else 0 for ends in row.a_ends] == row.a_marks
    assert row.a_marks[-1] == 0 and all(m for m in row.a_marks[:-1])
    assert row.n_a == [sum(len(row.a[p]) for p in row.parts[0])] and row.n_b == [sum(len(row.b[p]) for p in row.parts[0])]


def test_spark_keeps_no_object_for_a_token(spark):
    # Functions of array elements, which Spark interprets with an object for each, cost more CPU than both tokenizers.
    found = A.aligned(spark.createDataFrame([(1, "the the and, Zürich"), (2, None), (3, "x▁y a"), (4, "x")], "doc_id long, text string"), *PATHS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan and "Generate" not in plan
    rows = {r.id: r for r in found.collect()}
    groups = [[[int(i) for i in side.split(",")] for side in g.split("|")] for g in rows[1].groups.split(";")]
    assert rows[1].links == [x[-1] << 32 | y[-1] for x, y in groups]
    assert (rows[1].n_a, rows[1].n_b) == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups))
    assert [(rows[i].n_a, rows[i].groups, rows[i].links) for i in (2, 3)] == [(0, "", [])] * 2 and rows[4].links


def test_segments_read_at_once_or_alone(monkeypatch):
    both = A.Pair(*PATHS)
    r = random.Random(7)
    parts = ["the", "Haus", "\n", "'s", "é", "-", "42", "ɏ", "XY", ".", "…", "ab", "  ", "中", "\t", "½", "▁"]
    both.bytes_b[both.b.encode("Haus")[0]] = b" ?"  # as if it changed this word, which else may stand beside others
    segments = list(dict.fromkeys("".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(3000)))
    alone = []
    for s in segments:
        x, y = both.a.encode(" " + s, add_special_tokens=False).ids, both.b.encode(s)
        good = b"".join(both.bytes_a[i] for i in x) == (" " + s).encode() == b"".join(both.bytes_b[i] for i in y)
        alone.append((x, y) if good else ([], []))
    assert {bool(x) for x, _ in alone} == {True, False}
    for run in (1, 3, 512):
        monkeypatch.setattr(A, "RUN", run)
        a, b, good = both.encode(segments)
        assert list(zip(a.to_pylist(), b.to_pylist(), strict=True)) == alone and good.tolist() == [bool(x) for x, _ in alone]


def test_first_tokenizer_is_called_once_a_run():
    class Counted:
        calls = 0

        def encode_ordinary(self, text):
            self.calls += 1
            return both.a.encode(text, add_special_tokens=False).ids

    both = A.Pair(*PATHS)
    both.quick = Counted()
    both.encode([f"word{i}" for i in range(2000)])
    assert both.quick.calls <= 4
