"""Training-data operators against brute force, and on odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import chat, exactdup, graph, linedup, mixing, neardup, packing, pii, quality, queries, rules, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = queries.tokenizer_path()


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_docs(spark):
    """Nulls, empties, a very long text, ties, repeats and clashing names."""
    rng = random.Random(3)
    body = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))
    shared, long = body(60), body(30_000)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, shared), (4, shared), (5, "x " + shared + " y"), (6, shared.replace(" ", "\n")), (None, shared), (None, None), (7, long), (8, long + " end"),
        (9, "Ünïcödé wörds 漢字     é ok <|endoftext|> \x01"), (10, "a\nb\na\n" + "This line is long enough to count.\n" * 3), (11, "This line is long enough to count."), (12, "  this LINE is long enough to count. \r"), (13, body(80)), (13, body(90)),
    ]
    clash = "id long, row string, n int, hash string, keep string, at int, h1 int, bands int, good int, score double, length int, batch int, kind string, component int"
    extra = (0, "r", 1, "h", "k", 2, 3, 4, 5, 0.5, 6, 7, "z", 8)
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *extra) for k, (i, t) in enumerate(rows)], f"{SCHEMA}, {clash}")


def as_pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def split(text):
    return WORD.findall(text or "")


def test_word_blocks_match_a_pattern():
    texts = [None, "", " a b\x0bc ", "é x y", "tail", "  "]
    got = []
    for b in words.blocks(pa.array(texts, pa.string())):
        for i in range(len(b)):
            got.append([b.data[s:e].tobytes().decode() for s, e in zip(b.starts[b.bounds[i] : b.bounds[i + 1]], b.ends[b.bounds[i] : b.bounds[i + 1]])])
    assert got == [split(t) for t in texts]
    a, b = (next(words.blocks(pa.array([t]))).hashes for t in ("x one two", "one two x"))
    assert a[1] == b[0] and a[0] == b[2] and len({*a}) == 3


def check_packing(spark, docs, window=4096):
    """Every id lies in one piece, pieces hold the ids they say, and places are gapless; the number of sequences."""
    rows = packing.pack(docs, VOCAB, window=window).collect()
    plain = Tokenizer.from_file(VOCAB)
    want, of = Counter(), defaultdict(list)
    for i, t in as_pairs(docs):
        of[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    spans = defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in of[r.doc_id])
        spans[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for i, some in of.items():
        for n, times in Counter(map(len, some)).items():
            covered = Counter()
            for s, k in spans[i, n]:
                covered.update(range(s, s + k))
            assert covered == Counter({p: times for p in range(n)}), (i, n)
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    assert sorted(at) == list(range(len(at)))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end and n > 0
            end += n
        assert end <= window
    return len(at), sum(r.length for r in rows)


def test_packing_covers_every_id_once(spark):
    check_packing(spark, odd_docs(spark))


def test_pieces_over_half_a_window_are_cut(spark):
    rng = random.Random(8)
    docs = table(spark, [(i, " ".join(rng.choice("the of and to in is it on as be".split()) for _ in range(rng.randrange(34, 40)))) for i in range(300)])
    n, tokens = check_packing(spark, docs, window=64)
    assert n * 64 < 1.01 * tokens + 64


def test_packing_of_nothing(spark):
    assert packing.pack(table(spark, []), VOCAB).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    packed = packing.pack(table(spark, [(i, f"some words number {i} " * 3) for i in range(50)]), VOCAB, window=64, keep_ids=True)
    out = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 256 for r in out)
    assert sum(r.n_tokens for r in out) == packed.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_plans_waste_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    check_plan(counts, lengths.sum())


@pytest.mark.parametrize("lengths", [np.full(50_000, 2100), np.random.default_rng(1).integers(2100, 4000, 50_000), np.random.default_rng(2).normal(3000, 300, 50_000).astype(int).clip(1, 4096), np.random.default_rng(3).integers(1400, 2000, 50_000), np.full(3, 4095), np.array([1])])
def test_plans_waste_little_where_nothing_fits(lengths):
    check_plan(np.bincount(lengths, minlength=4097), lengths.sum())


def check_plan(counts, total):
    plan = packing.plan(counts)
    assert (np.bincount(plan[:, 0], weights=plan[:, 2] - plan[:, 1], minlength=4097) == counts).all() and len(plan) < 64 * 4096
    taken = []
    for length, low, high, position, stride in plan:
        at = position + stride * np.arange(high - low)
        taken.append(np.c_[at, at + length])
    taken = np.concatenate(taken)
    taken = taken[taken[:, 0].argsort()]
    assert (taken[1:, 0] >= taken[:-1, 1]).all()
    assert -(-taken[-1, 1] // 4096) * 4096 <= 1.01 * total + 4096


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 8)), rng.normal(size=20)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-8).all() and abs(x @ slope) < 1e-8


def test_chat_keeps_maximal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, "user", "hi"), (4, 1, "assistant", "other <|x|>"), (5, None, None, None), (None, 0, "user", "lost"), (2, 1, "assistant", "hello"), (6, 0, "user", "hello"), (6, 1, "user", "hi")]
    df = table(spark, [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, k int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(df).collect()}
    assert set(got) == {2, 4, 5, None, 6}
    assert got[2][:2] == (2, 2) and got[4][2] == "<|user|>\nhi<|end|>\n<|assistant|>\nother < |x|><|end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_chat_ties_and_lost_turns(spark):
    texts = [f"t{i}" for i in range(8)]
    ties = [(c, 0, "user", t) for c in (1, 2) for t in (texts if c == 1 else texts[::-1])] + [(2, 1, "user", "more")]
    rows = [*ties, (None, 0, "user", "a"), (None, 0, "user", "b"), (None, 0, "user", "b"), (None, 5, None, None), (3, 0, "user", "x" * (9 << 20))]
    got = sorted(((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in chat.render(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    order = sorted(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert [g[:3] for g in got] == [(2, 9, 1), (3, 1, 1), (None, 1, 1), (None, 1, 1), (None, 1, 1)]
    assert re.findall(r"t\d", got[0][3]) == order and len(got[1][3]) > 9 << 20


def test_rules_by_brute_force(spark):
    docs = odd_docs(spark).union(odd_docs(spark).limit(0))
    extra = table(spark, [(20, "go go go go go stop " * 12), (21, "$$$ a b " * 30), (22, "A\n a\n\nA\n")])
    both = docs.select("doc_id", "text").union(extra)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.ledger(both).collect())
    want = Counter()
    for i, t in as_pairs(both):
        w, t = split(t), t or ""
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        filled = [x for x in t.split("\n") if split(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(filled) - len(set(filled)), len(covered)] += 1
    assert got == want


def test_rule_bits_give_policies_and_ablations(spark):
    led = rules.ledger(table(spark, [(1, "word " * 80), (2, "short"), (3, "some different words here " + " ".join(f"w{i}" for i in range(70)))]))
    kept = {r.doc_id: r.kept for r in rules.apply_policy(led).collect()}
    assert kept == {1: False, 2: False, 3: True}
    alone = {r.rule: (r.n_failed, r.n_only_this) for r in rules.ablations(led, rules.POLICIES["base"]).collect()}
    assert alone == {"too_few_words": (1, 1), "repeated_windows": (1, 1)}
    assert {r.policy: r.n_kept for r in rules.compare(led).collect()}["base"] == 1
    assert {r.doc_id: r.kept_without for r in rules.apply_policy(led, rules.POLICIES["base"]).collect()} == {1: 2, 2: 1, 3: 0}
    assert "MapInArrow" not in led._jdf.queryExecution().toString() and rules.ledger(table(spark, [])).isEmpty()
    assert {r.n_docs for r in rules.compare(led.limit(0)).collect()} == {0}
    assert rules.ablations(led.limit(0)).count() == len(rules.PRODUCTION.bits)


def sets_of(text):
    w = split((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_by_brute_force(pairs, percent=85):
    docs = {i: sets_of(t) for i, t in pairs}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and docs[a] and 100 * len(docs[a] & docs[b]) >= percent * len(docs[a] | docs[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(docs[i]), root(i), root(i) == i) for i in ids}


def copies(n_groups, size, seed=1):
    """Chains of texts with edits, in which many pairs are near the threshold."""
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(120)]
        for _ in range(size):
            own = base[:]
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = own
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("block", [512, 7, 3])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [*copies(6, 25), (1001, ""), (1002, None), (1003, "one two"), (1004, "ONE two"), (1005, "one two three")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(table(spark, rows)).collect()}
    assert got == near_by_brute_force(rows)


def test_large_ids_and_lost_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [((1 << 62) + 5, text), ((1 << 62) + 6, text + " more"), (None, text + " again"), (None, "alone without an id"), ((1 << 62) + 9, "short"), (-3, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.classes(table(spark, rows)).collect()}
    top = (1 << 62) + 5
    assert got == {(top, top, True), (top + 1, top, False), (None, top, False), (None, None, True), (top + 4, top + 4, True), (-3, -3, True)}
    assert neardup.deduplicate(table(spark, rows)).count() == 4


def test_near_duplicates_on_odd_documents(spark):
    docs = odd_docs(spark)
    out = neardup.classes(docs)
    assert {r.doc_id for r in out.collect()} == {i for i, _ in as_pairs(docs)}
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").isEmpty() and not kept.where("doc_id = 7").isEmpty() and kept.where("doc_id = 8").isEmpty()
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.deduplicate(docs.limit(0)).count() == 0


def test_pruning_bound():
    t = neardup.least_matches(25, 0.85, 1e-6)
    assert 5 < t < 20 and neardup.least_matches(125, 0.85, 1e-6) > 80


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, j) for j in range(2, 60)] + [(7, 7), (1, 2)]
    got = {r.node: r.component for r in graph.components(table(spark, edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{j: 1 for j in range(1, 60)}}
    assert graph.components(table(spark, [], "a long, b long")).count() == 0


def test_exact_duplicates_by_brute_force(spark, monkeypatch):
    docs = odd_docs(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in as_pairs(docs):
        groups[norm(t)].append(float("inf") if i is None else i)
    want = set()
    for t, ids in groups.items():
        for i in ids:
            keep = min(ids)
            want.add((None if i == float("inf") else i, None if keep == float("inf") else keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exactdup.decide(docs).collect()]
    assert set(got) == want and len(got) == len(want)
    kept = exactdup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exactdup.decide(docs.limit(0)).count() == 0 and exactdup.deduplicate(docs.limit(0)).count() == 0
    # Without a broadcast the rows are the same.
    monkeypatch.setattr(exactdup, "BROADCAST_ROWS", -1)
    assert {tuple(r) for r in exactdup.decide(docs).collect()} == want and exactdup.deduplicate(docs).count() == len(groups)


def test_lines_by_brute_force(spark):
    docs = odd_docs(spark)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    top = 1 << 63
    seen = defaultdict(set)
    rows = [(top if i is None else i, t or "") for i, t in as_pairs(docs)]
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                seen[key(x)].add(i)
    want = Counter()
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(seen[key(x)]) >= 3 and i != max(seen[key(x)]))]
        want[None if i == top else i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter(tuple(r) for r in linedup.strip(docs).collect()) == want
    assert linedup.strip(docs.limit(0)).count() == 0


def test_line_runs_are_compacted(spark):
    index = linedup.LineRuns(spark, buckets=2)
    for b in range(4):
        index.add(table(spark, [(1, 1, 9 - b), (b + 10, 5, 9 - b), (b + 10, 5, 9 - b)], "h1 long, h2 long, id long"))
    assert sum(len(v) for (k, _), v in index.levels.items() if k == "run") == 1
    got = {(r.h1, r.n_docs, r["last"]) for r in index.counts().collect()}
    assert got == {(1, 4, 9), (10, 1, 9), (11, 1, 8), (12, 1, 7), (13, 1, 6)}
    assert index.new(table(spark, [(1, 1), (99, 9)], "h1 long, h2 long")).collect()[0].h1 == 99
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tickloom_run")]


def test_line_runs_hold_each_hash_once(spark):
    index = linedup.LineRuns(spark, buckets=2, fanout=9)
    sizes = []
    for b in range(3):
        index.add(table(spark, [(h, h, b) for h in range(50 + b)], "h1 long, h2 long, id long"))
        sizes.append(sum(r.count() for r in index.runs()))
    assert sizes == [50, 51, 52] and index.counts().where("n_docs = 3").count() == 50
    index.close()


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [
        (1, 'Write ann.lee7@mail.example.com or ANN.LEE7@MAIL.EXAMPLE.COM. Call +1 (017) 555-7713; card 4111 1111 1111 1111, again 4111111111111111.'), (2, 'token = "84f85083df6ea7c09829aa66c61b0f3fa2c57123" host 10.20.30.40, Mr. John Smith and Mrs. Smith, Господин Иван Петров'),
        (3, None), (4, ""), (5, "Version 4.0. is clean, 12 of 3."), (None, "ssn 123-45-6789 10.20.30.40"), (2, "again 10.20.30.40"),
    ]
    out = {}
    for r in pii.anonymise(table(spark, [(*r, "x") for r in rows], "doc_id long, text string, row string")).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[3][0].clean_text is None and out[4][0].clean_text == "" and out[5][0].clean_text == rows[4][1]
    one, two = out[1][0].clean_text, next(r.clean_text for r in out[2] if "token" in r.clean_text)
    assert "ann.lee7" not in one.lower() and "4111" not in one and "555-7713" not in one and "84f85083" not in two and "10.20.30.40" not in two
    mail = re.findall(r"(?i)\S+@\S+\.com\b", one)
    assert mail[0].upper() == mail[1] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)
    spaced, solid = re.search(r"card ([\d ]+),", one)[1], re.search(r"again (\d+)\.", one)[1]
    assert spaced.replace(" ", "") == solid and spaced.count(" ") == 3
    digits = [int(c) for c in solid]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    man, woman = re.search(r"Mr\. (\w+) \w+ and Mrs\. (\w+)", two).groups()
    assert man in pii.NAMES["man", "latin"] and woman[0].isupper() and re.search(r"Господин ([А-Яа-яё]+) [А-Я][а-я]+", two)[1] in pii.NAMES["man", "cyrillic"]
    ips = {re.search(r"\d+\.\d+\.\d+\.\d+", r.clean_text)[0] for k in (2, None) for r in out[k]}
    assert len(ips) == 1
    assert pii.anonymise(table(spark, [])).count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"ssn {i % 900 + 100:03d}-{i % 90 + 10:02d}-{i:04d}") for i in range(3000)]
    found = pii.entities(table(spark, rows)).select(F.explode("found").alias("e")).select("e.kind", pii.canonical(F.col("e.kind"), F.col("e.raw")).alias("value"))
    made = pii.dictionary(found)
    assert made.count() == made.select("surrogate").distinct().count() == found.distinct().count() == 3000
    assert made.join(found.select(F.col("value").alias("surrogate")), "surrogate", "left_semi").isEmpty()


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op8_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    # Labels of held-out rows and other columns are no inputs.
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = quality.train(docs, labels), quality.train(other, flipped)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_classifier_on_odd_inputs(spark):
    docs = odd_docs(spark)
    none = table(spark, [], "doc_id long, quality int")
    model = quality.train(docs, none)
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    one_class = table(spark, [(i, 1) for i in range(1, 14)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert quality.good_documents(docs, quality.train(docs, one_class)).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(0, 50, 20), 100 + (i % 2)]) for i in range(60)]
    y = np.array([2.0 * (i % 2) - 1 for i in range(60)])
    w, b = quality.dual_descent(rows, np.ones(quality.SIZE), y, np.ones(60))
    assert all(np.sign(w[r].sum() + b) == t for r, t in zip(rows, y))


def removed_by_brute_force(pairs, k=50):
    top = 1 << 63
    rows = [(top if i is None else i, split(t)) for i, t in pairs]
    first = {}
    for i, w in rows:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in rows:
        gone = {j + o for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for o in range(k)}
        out[None if i == top else i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    return out


def test_substrings_by_brute_force(spark):
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = body(70), body(50)
    rows = [(3, body(20) + " " + passage + " " + body(10)), (1, passage), (2, body(60) + " " + passage[: len(passage) // 2]), (5, passage + " " + passage + " " + other), (4, other + " " + body(5) + " " + other), (6, other), (7, " ".join(other.split()[:49])), (8, "a " * 200), (9, "a " * 120)]
    docs = table(spark, rows).union(odd_docs(spark).select("doc_id", "text"))
    got = Counter(tuple(r) for r in substring.decide(docs).collect())
    assert got == removed_by_brute_force(as_pairs(docs))
    assert substring.decide(docs.limit(0)).count() == 0
    spans = {(r.doc_id, r.start, r.end) for r in substring.intervals(table(spark, rows)).collect()}
    assert (3, 20, 90) in spans and (6, 0, 50) in spans


def test_mixing_reaches_its_rates(spark):
    rows = [(i, "x", "big" if i % 4 else "small") for i in range(8000)] + [(None, None, None), (None, None, None)]
    docs = table(spark, [(*r, 1) for r in rows], "doc_id long, text string, source string, n int")
    out = mixing.mix(docs, {"big": 0.5, "small": 0.5}, total=10_000)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert got["big"] == pytest.approx(5000, rel=0.05) and got["small"] == pytest.approx(5000, rel=0.05) and None not in got
    per = out.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("__tl_copy").alias("m"), F.max("__tl_n").alias("n"))
    assert per.where("c <> m OR c <> n").isEmpty()
    counts = Counter(r.c for r in out.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("c")).collect())
    assert counts[2] / 2000 == pytest.approx(2.5**2 / 2 * np.exp(-2.5), rel=0.12)
    same = mixing.mixed_documents(docs)
    assert same.columns == docs.columns and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_queries_run_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() > 0, name


def test_pipeline_stages_by_brute_force(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(P.STAGES) - 1:
            assert seen[-1].columns == docs.columns, name
    kept, unique, near, mixed, packed = seen[1:]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    dropped = ids(docs) - ids(kept)
    assert sum(labels.get(i) == 1 for i in dropped) <= 2 and any(labels.get(i) == 0 for i in dropped)
    texts = defaultdict(list)
    for i, t in as_pairs(kept):
        texts[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    assert ids(unique) == {min(v) for v in texts.values()}
    want = near_by_brute_force(as_pairs(unique), 80)
    assert ids(near) == {i for i, (_, _, stays) in want.items() if stays}
    assert ids(mixed) <= ids(near) and mixed.count() > near.count() / 2
    assert packed.select("doc_id", "start").groupBy("doc_id").count().count() == len(ids(mixed))
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.where("start = 0").collect())


def test_vocabulary_is_a_parameter():
    assert json.load(open(VOCAB))["model"]["type"] == "BPE"
