"""Quality rules as a bitmask ledger.

``measure`` reads every text once and stores plain measurements; ``judge``
turns them into one bit per failed rule; ``apply_policy`` decides with a
versioned mask; ``ablation`` computes, from the stored bits alone, what each
rule of a policy removes by itself. A new policy never reads a text again.

Defined results: a null or empty text has no words and fails the word count
rule; null ids and repeated rows are kept as they are; columns other than the
id and the text are neither read nor returned, so clashing names do no harm;
an empty table gives an empty ledger (and a ledger without rows gives zero
counts per rule). Work on a text is linear in its length, up to the sort of
its window hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, total

WINDOW = 8

#: Rule name -> SQL condition over the measurements that marks a failure. The
#: position in this list is the bit; append only, never reorder.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("capitals", "100 * n_capitals > 60 * word_chars"),
    ("no_sentence_end", "n_words >= 200 and n_ends = 0"),
    ("many_words", "n_words > 10000000"),
]


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document goes if it fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {p.version: p for p in [
    Policy("base", ("few_words", "repeated_windows")),
    Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words",
                  "digits", "capitals")),
    Policy("strict", tuple(n for n, _ in RULES)),
]}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found at least twice in the array ``words``.

    Windows are compared by 64-bit hash. Only texts with a repeated window pay
    for the sort; covered words are then counted from the sorted starts, each
    start covering what lies before the next one.
    """
    def covered(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
                            | ((j + 1 < F.size(s)) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def spread(p: Column) -> Column:
            return total(F.transform(p, lambda x, j: F.when(
                j + 1 < F.size(p), F.least(F.lit(window), p[F.least(j + 1, F.size(p) - 1)] - x))
                .otherwise(F.lit(window)).cast("bigint")))

        return let(at, lambda s: let(starts(s), spread))

    def of(word_hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(word_hashes) - (window - 1)),
                              lambda i: F.xxhash64(F.slice(word_hashes, i, window)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))
                   .otherwise(F.lit(0).cast("bigint")))

    return (F.when(F.size(words) <= window, F.lit(0).cast("bigint"))
             .otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of)))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measurements per document; one pass, no shuffle."""
    t, c = F.col("_t"), lambda pattern: F.regexp_count(F.col("_t"), F.lit(pattern)).cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split(t, f"[{WHITE}]+"), "")).withColumn("_l", lines)
    return d.select(
        "doc_id", F.size("_w").cast("bigint").alias("n_words"),
        total(F.transform("_w", lambda w: F.length(w).cast("bigint"))).alias("word_chars"),
        c(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"), c(r"[0-9]").alias("n_digits"),
        c(r"[A-Z]").alias("n_capitals"), c(r"[.!?]").alias("n_ends"))


def judge(measured: DataFrame) -> DataFrame:
    """Adds ``fail_bits``: bit i is set if rule i of ``RULES`` fails."""
    bits = [F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (_, sql) in enumerate(RULES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn("fail_bits", mask)


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept``: no rule of the policy fails."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and
    that the policy would remove without it. Documents are first counted per
    bit pattern (at most 2^rules rows), so nothing but counts is shuffled."""
    by_bits = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit"))
                      for i, (n, _) in enumerate(RULES) if n in policy.rules])
    r = by_bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(policy.mask).bitwiseXOR(F.col("bit"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint")
    return r.groupBy("rule").agg(count(hit).alias("failed"), count(hit & (F.col("bits") == F.col("bit"))).alias("failed_alone"),
                                 count(F.col("bits").bitwiseAND(rest) != 0).alias("removed_without"))


def op5(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The contract's columns: measurements, base rule and the policy's verdict."""
    d = apply_policy(judge(measure(docs)), POLICIES[version])
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits",
                    "n_lines", "n_digits", "n_capitals", "n_ends")
