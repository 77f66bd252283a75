"""Divergence of sources within a language, by a frequent-pattern tree of term rows.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z
lower-cased. A language keeps the terms of at least ``MIN_DOCS`` of its
documents. A group (language, source) and a language give each kept term the
share p = 1 + floor(10^9 (n + 5) / (N + 5 V)): n its occurrences there, N all
occurrences of kept terms there, V the number of kept terms. All of it is in
integers.

The distance of two sources, the sum of |p - q| over all kept terms, is taken
apart, so that no pair of sources is compared term by term:

* as if every term were missing in both: V |z_a - z_b|, z the share of n = 0;
* what a term present in one source adds, as if it were missing in the other.
  It depends on z of the other source only, so sums per source suffice, with
  an exact correction for the few shares below another source's z;
* what presence in both changes. For this every term is a row of its sources
  with their shares, in a fixed order of the sources (fewest occurrences first,
  whose small counts are the most often equal). Equal rows are counted, the rows are
  sorted, and each task reads prefix trees off its sorted rows: a node is a shared
  prefix, its multiplicity the number of terms below it. Each pair of a node
  and an ancestor is evaluated once, times that multiplicity. A node whose rows
  lie in several tasks is there once in each, with a part of its multiplicity;
  the sums are the same.

Defined results: null text, language and source are empty strings; empty texts
have no terms; repeated rows are separate documents; without kept terms all
distances are 0 and there are no term rows; a language with one source has no
pairs; an empty table gives no rows; equal values rank by the item's UTF-8
bytes; other columns are not read. A text is counted in slices of ``SLICE`` bytes,
so its length does not matter. A term's row has an entry per source of the language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import cut_lineage

MIN_DOCS, TOP_TERMS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
SLICE = 1 << 20  # bytes of a text that are split into words at a time
HELD = 200_000  # counted terms that a task holds before it passes them on
#: Letters, lower-cased; all other ASCII becomes a blank.
LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    text = text.translate(LETTERS)
    at = 0
    while len(text) - at > SLICE:
        end = text.find(b" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _slices(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""
    blank = F.lit("")
    d = docs.select(*[F.coalesce(F.col(c), blank).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    return d.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_rows(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, row): a row per kept term with its occurrences per source."""
    g = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    return g.where(F.col("docs") >= min_docs).drop("docs")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (N + 5 V)) in exact arithmetic; null if nothing is kept."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(20, 0))) div "
                  f"nullif(CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0)), 0)")


def groups(docs: DataFrame, rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, v, n_lang, n_source, zero, place): all groups, their totals, the
    share of a missing term and the place in the order of sources."""
    g = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    by_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    by_source = rows.select("lang", F.explode("row").alias("r")).groupBy("lang", F.col("r.source").alias("source")).agg(F.sum("r.n").alias("n_source"))
    g = g.join(by_lang, "lang", "left").join(by_source, ["lang", "source"], "left").fillna(0, ["v", "n_lang", "n_source"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("n_source", "source"))
    return g.withColumn("zero", F.coalesce(share("0", "n_source", "v"), F.lit(0))).withColumn("place", place.cast("long"))


def shares(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, term, source, place, zero, p, q): a row per kept term and source that has it."""
    r = rows.select("lang", "term", "total", F.explode("row").alias("r")).select("lang", "term", "total", "r.source", "r.n")
    r = r.join(model, ["lang", "source"])
    return r.select("lang", "term", "source", "place", "zero", share("n", "n_source", "v").alias("p"), share("total", "n_lang", "v").alias("q"))


def _corrections(place: np.ndarray, p: np.ndarray, zero: np.ndarray, first: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair key, sum) of one prefix tree: rows ``first[i]:first[i + 1]``, sorted, with multiplicities m.

    Row i starts a node at depth d if it differs from row i - 1 in an item up to d."""
    size = np.diff(first)
    new = np.zeros(len(size), dtype=bool)
    new[0] = True
    for d in range(int(size.max(initial=0))):
        both = np.minimum(size[1:], size[:-1]) > d
        a, b = np.minimum(first[1:-1] + d, len(p) - 1), np.minimum(first[:-2] + d, len(p) - 1)
        new[1:] |= ~(both & (place[a] == place[b]) & (p[a] == p[b]))
        starts = np.flatnonzero(new)
        terms = np.add.reduceat(m, starts)
        node = size[starts] > d
        at, terms = first[starts[node]] + d, terms[node]
        keys, sums = [], []
        for up in range(1, d + 1):
            o = at - up
            fix = np.abs(p[at] - p[o]) - np.abs(p[at] - zero[o]) - np.abs(zero[at] - p[o]) + np.abs(zero[at] - zero[o])
            key, where = np.unique(place[o] << 32 | place[at], return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, where, fix * terms)
            keys.append(key)
            sums.append(total)
        if keys:
            yield np.concatenate(keys), np.concatenate(sums)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].to_pylist()
        cuts = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            path = batch["path"].slice(lo, hi - lo)
            items, first = path.flatten(), path.offsets.to_numpy().astype(np.int64)
            cols = [items.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for key, total in _corrections(*cols, first - first[0], batch["m"].slice(lo, hi - lo).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array([langs[lo]] * len(key), pa.string()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF),
                                                  pa.array(total)], ["lang", "a", "b", "fix"])


def tree_corrections(s: DataFrame) -> DataFrame:
    """(lang, a, b, fix): what terms present in both of two sources (by place, a < b) change, over all kept terms."""
    paths = s.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "zero"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m")).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return paths.mapInArrow(_trees, "lang string, a long, b long, fix long").groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix"))


def pair_distances(s: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, source, other, value) for every two sources of a language, in both directions."""
    g = model.select("lang", "source", "place", "zero", "v")
    own = s.groupBy("lang", "place").agg(F.sum("p").alias("sum_p"), F.count(F.lit(1)).alias("n_terms"))
    g = g.join(own, ["lang", "place"], "left").fillna(0, ["sum_p", "n_terms"])
    a = g.select(*[F.col(c).alias(c if c in ("lang", "v") else f"a_{c}") for c in g.columns])
    b = g.select(*[F.col(c).alias(c if c == "lang" else f"b_{c}") for c in g.columns if c != "v"])
    pairs = a.join(b, "lang").where("a_place < b_place")
    # Shares below the other source's share of a missing term: the sums per source take them with the wrong sign.
    most = model.groupBy("lang").agg(F.max("zero").alias("most"))
    low = s.join(most, "lang").where("p < most").groupBy("lang", "place", "p").agg(F.count(F.lit(1)).alias("m"))
    low = low.join(model.select("lang", F.col("place").alias("o"), F.col("zero").alias("o_zero")), "lang").where("place != o AND p < o_zero")
    low = low.groupBy("lang", "place", "o").agg(F.sum(F.expr("m * (o_zero - p)")).alias("low"))
    fixes = (tree_corrections(s).select("lang", "a", "b", "fix")
             .unionByName(low.select("lang", F.least("place", "o").alias("a"), F.greatest("place", "o").alias("b"), (2 * F.col("low")).alias("fix")))
             .groupBy("lang", F.col("a").alias("a_place"), F.col("b").alias("b_place")).agg(F.sum("fix").alias("fix")))
    pairs = pairs.join(fixes, ["lang", "a_place", "b_place"], "left")
    value = F.expr("(v - a_n_terms - b_n_terms) * abs(a_zero - b_zero) + a_sum_p - b_zero * a_n_terms + b_sum_p - a_zero * b_n_terms + coalesce(fix, 0)")
    pairs = pairs.select("lang", "a_source", "b_source", value.alias("value"))
    two = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("other")) for x, y in (("a_source", "b_source"), ("b_source", "a_source"))]))
    return pairs.select("lang", two.alias("x"), "value").select("lang", "x.source", "x.other", "value")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by distance (part
    ``pair``), and the ``top_terms`` terms that a source has more of than its language
    (part ``term``)."""
    rows = cut_lineage(term_rows(term_counts(docs), min_docs), "term_rows")
    model = cut_lineage(groups(docs, rows), "groups")
    s = cut_lineage(shares(rows, model), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value")).withColumn(
            "rank", F.row_number().over(order))

    pairs = ranked(pair_distances(s, model).withColumnRenamed("other", "item"), "pair")
    terms = s.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
    return pairs.unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))


def op11(docs: DataFrame) -> DataFrame:
    return divergence(docs)
