"""PII redaction as native higher-order functions.

For each rule in order: find all matches in the *current* text, (for ``cc``)
keep only Luhn-valid ones, then replace every occurrence of each matched
substring by ``<rule>``. This find-all-then-replace-all fold differs from
``regexp_replace`` (``12 123`` -> ``<phone> <phone>3``), so it is built with
``regexp_extract_all`` + ``aggregate``; no Python UDF is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import col_


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str               # RE2 syntax
    replacement: str | None = None
    severity: str = "medium"
    luhn: bool = False

    @property
    def placeholder(self) -> str:
        return self.replacement if self.replacement is not None else f"<{self.name}>"


def default_rules(profile: str = "code") -> list[Rule]:
    """Rule list; ``profile='intended'`` widens uuid and phone (see README)."""
    out = []
    for name, pat in P.REDACTION_RULES:
        if profile == "intended" and name in P.INTENDED_OVERRIDES:
            pat = P.INTENDED_OVERRIDES[name]
        out.append(Rule(name, pat, luhn=(name == "cc")))
    return out


# What a match of a default rule always holds: a plain test that most texts fail, before the
# rule's own pattern with its boundaries is tried. Tied to the pattern, so another pattern has none.
GUARDS = {(name, pattern): guard for (name, pattern), guard in zip(P.REDACTION_RULES, [
    "-4[0-9a-fA-F]{3}-", "[0-9a-fA-F]:[0-9a-fA-F]", "[0-9][.][0-9]", "@", "[0-9]{4}", "[1-9][0-9]", "://"], strict=True)}

# Found in every text that any guard is found in: most texts fail this one test and have nothing to redact.
ANY_GUARD = "@|[0-9][0-9.]|:[0-9a-fA-F/]|-4"


def validate_rules(rules: list[Rule]) -> None:
    """Refuse patterns that can match the empty string."""
    import re
    for r in rules:
        if re.fullmatch(r.pattern, "") is not None or re.search(r.pattern, "") is not None:
            raise ValueError(f"rule {r.name!r}: pattern matches the empty string")


def luhn_ok(c) -> Column:
    """Strip '-' and whitespace, require 13-19 digits, then the Luhn check."""
    d = F.regexp_replace(col_(c), "[-\\t\\n\\f\\r ]", "")
    return d.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", d)


def let(value: Column, body) -> Column:
    """``let v = value in body(v)``: binds an expression once through a lambda
    variable, so a value used twice is neither duplicated in the plan nor
    evaluated twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def barrier(c: Column) -> Column:
    """Always-true nondeterministic guard around an expensive expression.

    Catalyst pushes filters through projections by substituting aliases; for
    the redaction fold that would copy the whole fold into the filter and run
    it twice per row. A nondeterministic projection is never inlined into
    another operator, so the fold runs exactly once per row."""
    return F.when(F.spark_partition_id() >= 0, c)


def redact(text, rules: list[Rule]) -> Column:
    """R1-R4 as one expression -> struct<text, applied, rules, count>."""
    validate_rules(rules)

    def step(i: int, t: Column, found: list[Column]) -> Column:
        if i == len(rules):
            names = F.array_compact(F.array(*[
                F.when(F.size(m) > 0, F.lit(r.name)) for r, m in zip(rules, found)]))
            total = sum((F.size(m) for m in found), F.lit(0))
            return F.struct(t.alias("text"), (total > 0).alias("applied"), names.alias("rules"),
                            total.cast("int").alias("count"))
        r = rules[i]
        matches = F.regexp_extract_all(t, F.lit(P.to_java(r.pattern)), 0)
        if GUARDS.get((r.name, r.pattern)):
            matches = F.when(t.rlike(GUARDS[(r.name, r.pattern)]), matches).otherwise(F.array().cast("array<string>"))
        if r.luhn:
            matches = F.filter(matches, lambda m: luhn_ok(m))
        ph = r.placeholder
        return let(matches, lambda m: let(
            F.aggregate(m, t, lambda acc, x: F.replace(acc, x, F.lit(ph))),
            lambda t2: step(i + 1, t2, found + [m])))

    if not all((r.name, r.pattern) in GUARDS for r in rules):
        return let(col_(text), lambda t0: step(0, t0, []))
    none = lambda t: F.struct(t.alias("text"), F.lit(False).alias("applied"), F.array().cast("array<string>").alias("rules"),
                              F.lit(0).alias("count"))
    return let(col_(text), lambda t0: F.when(t0.isNull() | t0.rlike(ANY_GUARD), step(0, t0, [])).otherwise(none(t0)))


def redact_steps(df: DataFrame, text_col: str, rules: list[Rule], out_col: str = "message",
                 report_col: str = "redaction") -> DataFrame:
    """Apply the rules and attach ``out_col`` and the report struct
    ``{applied, rules, count}``."""
    df = df.withColumn("__red", barrier(redact(F.col(text_col), rules)))
    df = df.withColumn(report_col, F.struct(F.col("__red.applied").alias("applied"),
                                            F.col("__red.rules").alias("rules"),
                                            F.col("__red.count").alias("count")))
    return df.withColumn(out_col, F.col("__red.text")).drop("__red")
