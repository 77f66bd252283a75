"""License scan: ordered signatures, keyword prefilter, containment suppression.

A text is lower-cased (A-Z), gated by a few substrings, then only signatures
whose keyword it holds are matched. Detections are ordered by (start, longest,
priority, signature) and swept once: a detection goes if an earlier one of the
same or a higher priority contains it. All of it happens inside the row, so
there is no shuffle, and a text costs one pass per signature that applies.

Besides, ``base_phrases`` counts fixed phrases on the text's words.

Defined results: a null or empty text has no words and no detections; ids,
ties and repeated rows stay as they are; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, ascii_lower, let
from .license_rules import gates, signatures

#: Phrase (words) -> label, as the contract lists them.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Score of a detection by the priority of its signature.
CONFIDENCE = {4: 1.0, 3: 0.95, 2: 0.8, 1: 0.4}
CREATIVE = r"cc[\s-]{1,8}by|cc0"


def _rules() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(prio).alias("priority"),
                              F.lit(word).alias("keyword"), F.lit(pattern).alias("pattern"))
                     for i, (label, prio, word, pattern) in enumerate(signatures())])


def spans_of(text: Column, rule: Column) -> Column:
    """All matches of one signature as structs, from the pieces between them."""
    pieces = F.split(text, rule["pattern"], -1)
    matches = F.regexp_extract_all(text, rule["pattern"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), (-end).alias("neg_end"), (-rule["priority"]).alias("neg_priority"),
                        rule["rule"].alias("rule"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    kind = "struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("spans"))
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(both, zero, step)["spans"]).otherwise(F.array().cast(f"array<{kind}>"))


def suppress(spans: Column) -> Column:
    """Drop detections that an earlier one of no lower priority contains."""
    levels = sorted(CONFIDENCE)

    def step(acc: Column, s: Column) -> Column:
        end, prio = -s["neg_end"], -s["neg_priority"]
        reach = F.greatest(*[F.when(F.lit(p) >= prio, acc[f"end{p}"]).otherwise(0) for p in levels])
        kept = F.when(reach >= end, F.lit("0")).otherwise(F.lit("1"))
        return F.struct(*[F.when(prio == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels],
                        F.concat(acc["kept"], kept).alias("kept"))

    zero = F.struct(*[F.lit(0).alias(f"end{p}") for p in levels], F.lit("").alias("kept"))
    return let(F.array_sort(spans), lambda s: let(F.aggregate(s, zero, step)["kept"],
               lambda kept: F.filter(s, lambda _, i: F.substring(kept, i + 1, F.lit(1)) == "1")))


def detections(text: Column) -> Column:
    """Kept detections of a lower-cased text: array of (start, end, priority, rule, label), code points."""
    gate = F.lit(False)
    for g in gates():
        gate = gate | (text.contains(g) if g != "cc" else text.contains(g) & text.rlike(CREATIVE))

    def tried(rules: Column) -> Column:
        return F.filter(rules, lambda r: text.contains(r["keyword"]) & ((r["keyword"] != "cc") | text.rlike(CREATIVE)))

    found = let(_rules(), lambda rules: suppress(F.flatten(F.transform(tried(rules), lambda r: spans_of(text, r)))))
    plain = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["neg_end"]).alias("end"),
                                                  (-s["neg_priority"]).alias("priority"), s["rule"].alias("rule"), s["label"].alias("label")))
    return F.when(gate, plain).otherwise(F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>"))


def base_phrases(text: Column) -> Column:
    """Per phrase of a lower-cased text: array of (label, n, first, last), words from 0."""
    words = lambda c: F.regexp_count(c, F.lit("[^ ]+"))

    def phrase(norm: Column, said: str, label: str) -> Column:
        def of(pieces: Column) -> Column:
            n = F.size(pieces) - 1
            last = words(norm) - words(F.element_at(pieces, -1)) - len(said.split())
            return F.struct(F.lit(label).alias("label"), n.cast("bigint").alias("n"),
                            F.when(n > 0, words(pieces[0])).cast("bigint").alias("first"), F.when(n > 0, last).cast("bigint").alias("last"))
        return let(F.split(norm, f"(?<= ){said}(?= )"), of)

    norm = F.concat(F.lit(" "), F.regexp_replace(text, f"[{WORD_SEPARATORS}]+", " "), F.lit(" "))
    some = (text.contains("license") & (text.contains("gnu") | text.contains("apache") | text.contains("mit"))) | (
        text.contains("cc") & text.rlike(f"cc[{WORD_SEPARATORS}]+by"))
    found = let(norm, lambda x: F.array(*[phrase(x, said, label) for said, label in PHRASES]))
    return F.when(some, F.filter(found, lambda p: p["n"] > 0)).otherwise(
        F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (phrases), detections; one pass, no shuffle."""
    d = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    t = F.col("_t")
    return d.select("doc_id", F.regexp_count(t, F.lit(f"[^{WORD_SEPARATORS}]+")).cast("bigint").alias("n_words"),
                    base_phrases(t).alias("base"), detections(t).alias("detections"))


def op7(docs: DataFrame) -> DataFrame:
    s = scan(docs)
    base = F.array_distinct(F.transform("base", lambda p: p["label"]))
    own = F.transform("detections", lambda x: x["label"])
    scores = F.concat(F.transform("detections", lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in CONFIDENCE.items() for y in kv]), x["priority"])),
                      F.transform("base", lambda _: F.lit(0.5)))
    return s.select(
        "doc_id", "n_words", F.aggregate("base", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"), F.size("detections").cast("bigint").alias("n_detections"),
        F.array_join(F.transform("detections", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
