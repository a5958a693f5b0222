"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule, and is written; a policy is a versioned mask over
those bits, so new policies and ablations are bit operations over what was
written and never read the texts again.  Ablations group the ledger by its bit
patterns, of which there are at most 2 ** rules, and work on those.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.scratch import put

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper_words long, n_bullet_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = bytes([0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; ``bit`` is for ever."""

    bit: int
    name: str
    fails: str


#: A rule keeps its bit; changed thresholds are new rules with new bits.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    Rule(4, "repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule(5, "upper_case", "n_words >= 20 AND 10 * n_upper_words > 6 * n_words"),
    Rule(6, "lone_symbols", "n_words >= 20 AND 10 * n_bullet_words > 3 * n_words"),
)
BASE = frozenset({0, 1})


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject a document."""

    version: str
    bits: frozenset[int]

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", BASE | {2, 3, 4}),
    "v2": Policy("v2", BASE | {2, 3, 4, 5, 6}),
}
PRODUCTION = POLICIES["v2"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        for block in W.blocks(batch.column(1), hashed=False):
            data, n = block.data, len(block.data)
            letters = np.zeros(n + 1, np.int64)
            np.cumsum(((data & 0xC0) != 0x80) & ~W._SPACE[data], out=letters[1:])
            symbols = np.zeros(n + 1, np.int64)
            np.cumsum(_SYMBOL[data], out=symbols[1:])
            small, large = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            np.cumsum((data >= 97) & (data <= 122), out=small[1:])
            np.cumsum((data >= 65) & (data <= 90), out=large[1:])
            s, e = block.starts, block.ends
            upper = (large[e] - large[s] > 0) & (small[e] == small[s])
            lone = (symbols[e] - symbols[s]) == (e - s)
            raw = data.tobytes()
            for i in range(len(block)):
                a, b = block.bounds[i], block.bounds[i + 1]
                lo, hi = block.offsets[i], block.offsets[i + 1]
                repeated = 0
                if b - a >= 4:
                    _, where, counts = np.unique(W.grams(W.Numbers().of(block.words(i)), 3), return_inverse=True, return_counts=True)
                    twice = counts[where] > 1
                    covered = np.zeros(b - a, bool)
                    for j in range(3):
                        covered[j : j + len(twice)] |= twice
                    repeated = int(covered.sum())
                lines = raw[lo:hi].split(b"\n")
                filled = [x for x in lines if x.strip(_BLANK)]
                found.append((b - a, letters[hi] - letters[lo], symbols[hi] - symbols[lo], len(lines), len(filled) - len(set(filled)), repeated, upper[a:b].sum(), lone[a:b].sum()))
        names = [x.split()[0] for x in MEASURES.split(", ")]
        columns = np.array(found, np.int64).reshape(-1, len(names)).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in columns)], ["doc_id", *names])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` for every row of ``docs``, stored.

    A null or empty text has no words (and one empty line), a very long one is
    measured whole; repeated rows give repeated rows, a null id stays null, an
    empty table gives an empty ledger; other columns are ignored.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    measured = texts.mapInArrow(_measure, f"doc_id long, {MEASURES}")
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return put(measured.withColumn("fail_bits", bits), "ledger")


def under(policy: Policy) -> Column:
    """The failure bits that count under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask))


def apply_policy(led: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with ``kept``: none of the policy's rules failed; and ``kept_without``,
    the bit of the rule without which a rejected document would be kept, or 0.

    Row by row: repeated rows, null ids and empty ledgers come out as they are.
    """
    own = under(policy)
    return led.withColumns({"kept": own == 0, "kept_without": F.when(F.bit_count(own) == 1, own).otherwise(F.lit(0)).cast("long")})


def patterns(led: DataFrame) -> DataFrame:
    """``fail_bits, n_docs``: how often each set of rules failed together.

    At most 2 ** rules rows; none for an empty ledger.  Repeated rows count each.
    """
    return led.groupBy("fail_bits").agg(F.count("*").alias("n_docs"))


def ablations(led: DataFrame, policy: Policy = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``policy, n_docs, n_kept, rule, n_failed, n_only_this`` for each rule of ``policy``:
    documents that fail it, and those that would be kept without it, i.e. whose
    failure bits under the policy are its alone.  Rules that fail nowhere, or an
    empty ledger, have zeros.  Documents without failure bits (null) count as
    documents only: no rule is known to fail, and they are not kept.
    """
    used = [r for r in rules if r.bit in policy.bits]
    own = under(policy)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_docs")).otherwise(0)), F.lit(0)).cast("long")
    each = [F.struct(F.lit(r.name).alias("rule"), total(own.bitwiseAND(F.lit(1 << r.bit)) != 0).alias("n_failed"), total(own == (1 << r.bit)).alias("n_only_this")) for r in used]
    row = patterns(led).agg(total(F.lit(True)).alias("all_docs"), total(own == 0).alias("n_kept"), F.array(*each).alias("each"))
    return row.select(F.lit(policy.version).alias("policy"), F.col("all_docs").alias("n_docs"), "n_kept", F.explode("each").alias("x")).select("policy", "n_docs", "n_kept", "x.*")


def compare(led: DataFrame, policies: Mapping[str, Policy] = POLICIES) -> DataFrame:
    """``policy, n_docs, n_kept`` of several policies in one pass over the ledger's
    bit patterns; zeros for an empty ledger.  Null failure bits count as documents, not as kept."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_docs")).otherwise(0)), F.lit(0)).cast("long")
    each = [F.struct(F.lit(p.version).alias("policy"), total(F.lit(True)).alias("n_docs"), total(under(p) == 0).alias("n_kept")) for p in policies.values()]
    return patterns(led).agg(F.array(*each).alias("each")).select(F.explode("each").alias("x")).select("x.*")
