import random
import re

from tickloom.llm import licences as L


def brute(rows, templates=L.TEMPLATES, base=L.BASE):
    """The same by plain loops over words."""
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    texts = [(t.label, cut(t.text), [cut(p) for p in t.phrases]) for t in templates]
    docs = [(i, cut(t)) for i, t in rows]
    held = {w: sum(w in set(d) for _, d in docs) for _, t, _ in texts for w in t}
    out = []
    for i, words in docs:
        places, labels = [], set()
        for phrase, label in base.items():
            p = cut(phrase)
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        more, best = set(labels), 1.0 if labels else 0.0
        for label, text, phrases in texts:
            need = max(2, (2 * min(12, len(set(text))) + 4) // 5)
            chosen = sorted(set(text) & set(words), key=lambda w: (held[w], w))[:12]
            votes = {}
            for p, w in enumerate(words):
                for q, x in enumerate(text):
                    if w == x and w in chosen:
                        votes[p - q] = votes.get(p - q, 0) + 1
            for start, n in votes.items():
                def near(p):
                    q = next(k for k in range(len(text)) if text[k : k + len(p)] == p)
                    return any(k >= 0 and words[k : k + len(p)] == p for k in range(start + q - 8, start + q + 9))

                if n >= need and all(map(near, phrases)):
                    more.add(label)
                    if not labels:
                        best = max(best, sum(0 <= start + q < len(words) and words[start + q] == x for q, x in enumerate(text)) / len(text))
        out.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), best))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(spark, rows, **kw):
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, **kw), key=key)
    return {r.doc_id: r for r in got}


def varied(r, text):
    words = text.split()
    for _ in range(r.randrange(4)):
        at = r.randrange(len(words))
        words[at : at + r.randrange(2)] = [r.choice(["and", "x", "the", "license"])]
    return " ".join(words)


def test_templates_are_found_and_told_apart(spark):
    rows = [(i, f"Some words before it.\n{t.text.upper() if i % 2 else t.text}\nand after") for i, t in enumerate(L.TEMPLATES)]
    got = same(spark, rows)
    for i, t in enumerate(L.TEMPLATES):
        assert t.label in got[i].labels.split(",") and got[i].score == 1.0
    assert got[1].labels == "bsd" and got[1].base_labels == "" and got[8].labels == "lgpl"


def test_changed_templates_noise_and_odd_texts(spark):
    r = random.Random(1)
    noise = [w for t in L.TEMPLATES for w in L.split(t.text)]
    rows = [(i, varied(r, r.choice(L.TEMPLATES).text)) for i in range(60)]
    rows += [(100 + i, " ".join(r.choice(noise) for _ in range(200))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "MIT  license.MIT-License"), (203, "cc by cc by cc, BY!"), (204, "GNU general\npublic License é mit license"), (None, "cc by"), (None, "cc by"), (205, "ccé by"), (206, "\x00cc\x7fby\x00")]
    got = same(spark, rows)
    # Key phrases out of their places, or missing, are no licence.
    words = L.TEMPLATES[0].text.split()
    apart = same(spark, [(1, " ".join(words[:7] + ["word"] * 50 + words[7:])), (2, " ".join(words[:20])), (3, " ".join(words[7:]))])
    assert got[202].n_base == 2 and all(x.labels == "" for x in apart.values())


def test_empty_long_and_clashing(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "lorem ipsum " * 600_000 + L.TEMPLATES[2].text + " dolor" * 100_000
    odd = spark.createDataFrame([(1, long, 5)], "doc_id long, text string, labels int")
    row = L.scan(odd).first()
    assert row.labels == "isc" and row.n_words == 1_200_000 + len(L.split(L.TEMPLATES[2].text)) + 100_000


def test_own_templates(spark):
    own = (L.Template("house", "every copy of this house style guide belongs to the house", ("house style guide",)),)
    got = same(spark, [(1, "every copy of this house style guide belongs to the house"), (2, "a house style guide")], templates=own, base={})
    assert got[1].labels == "house" and got[2].labels == ""
