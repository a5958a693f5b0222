"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import alignment, chat, clustering, exactdup, licences, linedup, mixing, neardup, packing, pii, quality, rules, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of op1 and of the pipeline's last stage."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")))
    base = F.lit(rules.POLICIES["base"].mask)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits", "kept_without")


def op3_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.ledger(_table(spark, sf_dir, "documents"))
    each = [rules.ablations(led, policy) for policy in rules.POLICIES.values()]
    return functools.reduce(DataFrame.union, each)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).drop("node")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.decide(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.strip(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # These tables are synthetic, so a key that everyone knows will do where the session has none.
    key = spark.conf.get(pii.KEY_SETTING, "key of the registered query")
    return pii.anonymise(_table(spark, sf_dir, "documents"), key)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.decide(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "text", F.col("__tl_copy").alias("copy"), F.col("__tl_n").alias("n_copies"), F.col("__tl_order").alias("shuffle_key"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", "centroid"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_rules": op3_quality_rules,
    "op3_rule_ablations": op3_rule_ablations,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_license_scans": op11_license_scans,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 3)) AS o FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - list_unique(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
         len(list_filter(w, lambda x: regexp_full_match(x, '[#*$%&|<>]+'))) AS n_lone
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
         + 8 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::INT + 16 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT
         + 32 * (n_words >= 20 AND 10 * n_upper > 6 * n_words)::INT + 64 * (n_words >= 20 AND 10 * n_lone > 3 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits,
       CAST(CASE WHEN bit_count(fail_bits) = 1 THEN fail_bits ELSE 0 END AS BIGINT) AS kept_without FROM b
""",
    "op2_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, md5(text)) AS l FROM t GROUP BY conv_id),
p AS (SELECT conv_id, l, unnest(range(1, len(l))) AS k FROM c),
b AS (SELECT DISTINCT md5(CAST(l[1:k] AS VARCHAR)) AS h FROM p),
m AS (SELECT md5(CAST(l AS VARCHAR)) AS h, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY 1)
SELECT c.conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(l, lambda x: '<|' || replace(x.r, '|', '') || '|>' || chr(10) || replace(x.t, '<|', '< |') || '<|end|>' || chr(10)), '') AS rendered
FROM c JOIN m ON m.conv_id = c.conv_id WHERE m.h NOT IN (SELECT h FROM b)
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key),
g AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key AND f.n >= 3 AND f.last <> k.doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
""",
    "op10_source_mixing": r"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
a AS (SELECT sum(power(n, 0.5)) AS all_w, sum(n) AS all_n FROM s),
r AS (SELECT source, CAST(all_n AS DOUBLE) * power(n, 0.5) / (all_w * n) AS rate FROM s, a),
p AS (SELECT source, k, exp(-rate) * power(rate, k) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) AS p FROM r, range(0, 30) t(k)),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p) GROUP BY source),
u AS (SELECT doc_id, source, CAST('0x' || substr(md5('20240131|' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, u.source, CAST(len(list_filter(cdf, lambda x: x <= u)) AS INTEGER) AS n_copies FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source),
e AS (SELECT doc_id, source, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy, n_copies FROM n)
SELECT e.doc_id, e.source, d.lang, d.text, copy, n_copies, CAST('0x' || substr(md5('20240132|' || e.doc_id || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM e JOIN documents d ON d.doc_id = e.doc_id
""",
    "op4_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op9_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM x),
c AS (SELECT DISTINCT doc_id, i + o AS j FROM (SELECT doc_id, i, unnest(range(0, 50)) AS o FROM f WHERE doc_id > first)),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (SELECT e.doc_id, count(c.j) AS n_removed, coalesce(string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY e.j), '') AS kept
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
}


def _ablation_sql() -> str:
    """The policies' rules as values, over the failure bits of op3."""
    bits = ORACLE_SQL["op3_quality_rules"].rsplit("SELECT doc_id, n_words", 1)[0]
    used = ", ".join(f"('{p.version}', {p.mask}, '{r.name}', {1 << r.bit})" for p in rules.POLICIES.values() for r in rules.RULES if r.bit in p.bits)
    return f"""{bits}
SELECT policy, (SELECT count(*) FROM b) AS n_docs, (SELECT count(*) FROM b WHERE fail_bits & mask = 0) AS n_kept, rule,
       (SELECT count(*) FROM b WHERE fail_bits & bit <> 0) AS n_failed, (SELECT count(*) FROM b WHERE fail_bits & mask = bit) AS n_only_this
FROM (VALUES {used}) AS v(policy, mask, rule, bit)"""


ORACLE_SQL["op3_rule_ablations"] = _ablation_sql()


def _lloyd_sql(rounds: int, dims: int, k: int) -> str:
    """The rounds of Lloyd's method, one after the other."""
    best = """SELECT n, v, arg_min(c, (list_sum(list_transform(list_zip(v, u), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), c)) AS c,
      min(list_sum(list_transform(list_zip(v, u), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d FROM q, m{r} GROUP BY n, v"""
    parts = [f"""q AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS u FROM q QUALIFY c < {k})"""]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({best.format(r=r)})")
        parts.append(f"""m{r + 1} AS MATERIALIZED (
  WITH s AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY c, i),
  f AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS u FROM s GROUP BY c)
  SELECT m{r}.c, coalesce(f.u, m{r}.u) AS u FROM m{r} LEFT JOIN f ON f.c = m{r}.c)""")
    parts.append(f"z AS MATERIALIZED ({best.format(r=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(u, ',')) AS centroid_sha256
FROM z JOIN q ON q.n = z.n JOIN m{rounds} ON m{rounds}.c = z.c"""


ORACLE_SQL["op13_centroid_clustering"] = _lloyd_sql(clustering.ROUNDS, clustering.DIMS, clustering.K)


def _licence_sql() -> str:
    """The scan with the templates as values."""
    index = licences.Index()
    words = lambda codes: "[" + ", ".join(f"'{index.words[c]}'" for c in codes) + "]"
    texts = ", ".join(f"({t}, '{x.label}', {index.need[t]}, {words(index.texts[t])})" for t, x in enumerate(index.templates))
    phrases = ", ".join(f"({t}, {q}, {words(p)})" for t, own in enumerate(index.phrases) for p, q in own)
    base = ", ".join(f"('{label}', {words(p)})" for p, label in index.base_phrases)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {texts}) AS t(t, label, need, tw)),
k AS (SELECT * FROM (VALUES {phrases}) AS k(t, q, pw)),
b AS (SELECT * FROM (VALUES {base}) AS b(label, bw)),
o AS (SELECT t, unnest(range(0, len(tw))) AS q, unnest(tw) AS word FROM t),
u AS (SELECT r, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d),
v AS MATERIALIZED (SELECT r, p, word FROM u WHERE word IN (SELECT word FROM o UNION ALL SELECT unnest(bw) FROM b)),
f AS (SELECT word, count(DISTINCT r) AS df FROM v GROUP BY word),
h AS (SELECT r, t, word FROM (SELECT DISTINCT v.r, o.t, v.word, f.df FROM v JOIN o ON o.word = v.word JOIN f ON f.word = v.word)
      QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY df, word) <= {licences.RAREST}),
c AS (SELECT v.r, o.t, v.p - o.q AS start FROM v JOIN o ON o.word = v.word JOIN h ON h.r = v.r AND h.t = o.t AND h.word = v.word JOIN t ON t.t = o.t GROUP BY v.r, o.t, v.p - o.q, t.need HAVING count(*) >= t.need),
z AS (SELECT c.r, c.t, c.start FROM c JOIN k ON k.t = c.t JOIN d ON d.r = c.r
      WHERE len(list_filter(range(greatest(c.start + k.q - {licences.SLACK}, 0), c.start + k.q + {licences.SLACK} + 1), lambda x: d.w[x + 1 : x + len(k.pw)] = k.pw)) > 0
      GROUP BY c.r, c.t, c.start HAVING count(*) = (SELECT count(*) FROM k AS k2 WHERE k2.t = c.t)),
y AS (SELECT z.r, t.label, z.start, count(v.p) / CAST(len(t.tw) AS DOUBLE) AS share FROM z JOIN t ON t.t = z.t JOIN o ON o.t = z.t LEFT JOIN v ON v.r = z.r AND v.p = z.start + o.q AND v.word = o.word GROUP BY z.r, t.label, t.t, z.start, len(t.tw)),
a AS (SELECT v.r, v.p, b.label FROM v JOIN b ON b.bw[1] = v.word JOIN d ON d.r = v.r WHERE d.w[v.p + 1 : v.p + len(b.bw)] = b.bw),
g AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM a GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM a UNION ALL SELECT r, label FROM y) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM y GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n_base, 0) AS n_base, g.first_word, g.last_word, coalesce(g.base_labels, '') AS base_labels,
       coalesce(l.labels, '') AS labels, CASE WHEN g.r IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(s.share, 0)::DOUBLE END AS score
FROM d LEFT JOIN g ON g.r = d.r LEFT JOIN l ON l.r = d.r LEFT JOIN s ON s.r = d.r
"""


ORACLE_SQL["op11_license_scans"] = _licence_sql()
