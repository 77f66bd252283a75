"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters becomes one blank, and each
character is predicted from the three before it. Per language the model
interpolates orders 4 to 1 with absolute discounting: the highest order uses
counts, lower orders the number of distinct contexts (Kneser-Ney). Counts come
from *all* texts with a language: tasks count their n-grams, Spark sums them.

The model is kept as sorted arrays of n-gram hashes per language and order.
Hashes have ``bits`` bits, chosen so that all arrays together stay below
``MODEL_BYTES`` whatever the corpus holds; that bound makes the model safe to
collect and broadcast. N-grams of equal hash share their counts.

A text gets the language of the lowest cross-entropy per character (ties:
alphabetical order). Rejection is calibrated: on texts that were held back from
the counts, ``z = (entropy - mean) * sqrt(characters)`` is measured against the
mean entropy of their language; a text is rejected if its z is more than
``MARGIN`` times the 99.9th percentile and its entropy at least ``GAP`` nats a
character above that mean, as mixed but readable texts are not. Texts without
letters are rejected.

Defined results: null, empty and letterless texts get ``und``, score 0 and are
rejected; a null language is not learned from; without any learned language
everything is ``und``; repeated rows count as often as they occur; an empty
table gives no rows; other columns are passed through where asked for, and
result columns of the same name replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.session import cut_lineage, forget

from .common import share, shared
from .words import text_slices

ORDER, MODEL_BYTES, MARGIN, QUANTILE, GAP = 4, 256 << 20, 1.5, 0.999, 1.0
#: Bytes of text handled at once; a text's arrays take some 60 times its size.
SLICE = 1 << 20
RESULT = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("entropy", "double", pa.float64()),
          ("n_letters", "long", pa.int64()), ("rejected", "boolean", pa.bool_())]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): 4-character codes (16 bits a character) of the normalised texts, one per character;
    bounds[i]:bounds[i + 1] belong to text i."""
    lower = [" " + (t or "").lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in lower])])
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letter = regex.compile(r"\p{L}")
    fold = np.full(0x110000, 32, np.uint64)
    for p in np.flatnonzero(seen).tolist():
        if letter.match(chr(p)):
            fold[p] = (p ^ (p >> 16) * 31) & 0xFFFF
    c = fold[points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    keep[bounds[:-1]] = True  # every text begins with its blank
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    c = c[keep]
    at = np.arange(len(c)) - np.repeat(bounds[:-1], np.diff(bounds))
    code = c.copy()
    for back in range(1, ORDER):
        before = np.full(len(c), 32, np.uint64)
        before[back:] = c[:len(c) - back]
        code |= np.where(at >= back, before, np.uint64(32)) << np.uint64(16 * back)
    return code, bounds


def xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one bigint column, for uint64 values."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = (np.uint64(42 + 8) + p5) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial 4-gram counts of a task's texts, per language."""
    for batch in batches:
        held: dict[str, list] = {}
        for part in text_slices(batch, "text", SLICE):
            code, bounds = grams(part.column("text").to_pylist())
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = np.repeat(langs == lang, np.diff(bounds))
                held.setdefault(lang, []).append(np.unique(code[mine], return_counts=True))
        for lang, parts in held.items():
            u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "code", "n"])


@dataclass
class Order:
    """One order of one language: sorted hashes and their values."""

    gram: np.ndarray      # hash of the n-gram -> count
    count: np.ndarray
    context: np.ndarray   # hash of its context -> total count, distinct followers
    total: np.ndarray
    followers: np.ndarray
    discount: float

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class Model:
    bits: int
    languages: dict[str, list[Order]] = field(default_factory=dict)  # orders 1 to ORDER
    alphabet: int = 1
    #: language -> (mean entropy, largest accepted z)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return xxhash64(codes) & np.uint64((1 << self.bits) - 1)

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probabilities of distinct codes, a column per language in alphabetical order."""
        slots = []
        for n in range(1, ORDER + 1):
            g = codes & np.uint64((1 << 16 * n) - 1)
            slots.append((self.slot(g), self.slot(g >> np.uint64(16))))
        out = np.empty((len(codes), len(self.languages)))
        for k, lang in enumerate(sorted(self.languages)):
            p = np.full(len(codes), 1.0 / self.alphabet)
            for o, (g, c) in zip(self.languages[lang], slots, strict=True):
                total = Order.find(o.context, o.total, c)
                some = total > 0
                safe = np.where(some, total, 1.0)
                seen = np.maximum(Order.find(o.gram, o.count, g) - o.discount, 0.0) / safe
                left = np.minimum(o.discount * Order.find(o.context, o.followers, c) / safe, 1.0)
                p = np.where(some, np.minimum(seen + left * p, 1.0), p)
            out[:, k] = np.log(p)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(mean negative log probability per language, characters) of each text."""
        codes, bounds = grams(texts)
        distinct = np.unique(codes)
        logs = self.log_probs(distinct)
        at = np.searchsorted(distinct, codes)
        n = np.diff(bounds)
        out = np.empty((len(texts), len(self.languages)))
        for k in range(out.shape[1]):
            out[:, k] = -np.add.reduceat(logs[:, k][at], bounds[:-1]) / n
        return out, n


def train(docs: DataFrame, lang: Column, text: str = "text") -> Model:
    """Count, reduce to hash arrays in Spark, collect those (bounded by MODEL_BYTES)."""
    d = docs.select(lang.alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("lang is not null")
    counts = cut_lineage(d.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    langs = max(1, counts.select("lang").distinct().count())
    bits = max(8, min(24, int(np.log2(MODEL_BYTES / (langs * ORDER * 2 * 24)))))
    model = Model(bits)
    hashed = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    level = counts
    collected = {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # continuation counts: distinct (n + 1)-grams that end in this n-gram
            level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        gram = level.groupBy("lang", hashed(F.col("code")).alias("h")).agg(F.sum("n").alias("n"))
        context = level.groupBy("lang", hashed(F.shiftrightunsigned("code", 16)).alias("h")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("followers"))
        once = level.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"))
        collected[n] = tuple(x.toPandas() for x in (gram, context, once))
    forget(counts)
    for name in sorted(collected[1][2]["lang"]):
        orders = []
        for n in range(1, ORDER + 1):
            g, c, o = (x[x["lang"] == name] for x in collected[n])
            g, c = g.sort_values("h"), c.sort_values("h")
            n1, n2 = int(o["n1"].iloc[0]), int(o["n2"].iloc[0])
            orders.append(Order(g["h"].to_numpy(np.uint64), g["n"].to_numpy(float), c["h"].to_numpy(np.uint64), c["n"].to_numpy(float),
                                c["followers"].to_numpy(float), n1 / (n1 + 2 * n2) if n1 else 0.5))
        model.languages[name] = orders
    model.alphabet = max(2, len(set(collected[1][0]["h"])) + 1)
    return model


def _identify(sent, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared(sent)
        names = sorted(model.languages)
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                texts = part.column("_text").to_pylist()
                rows = len(texts)
                spoken = np.array([bool(t and letter.search(t)) for t in texts]) & bool(names)
                if names:
                    h, n = model.entropies(texts)
                    best = h.argmin(axis=1)
                    low = h[np.arange(rows), best]
                    share = np.exp((low[:, None] - h) * np.minimum(n, 20)[:, None])
                    score = 1 / share.sum(axis=1)
                    limit = np.array([model.limits.get(x, (0.0, np.inf)) for x in names])
                    above = low - limit[best, 0]
                    rejected = ~spoken | ((above * np.sqrt(n) > limit[best, 1]) & (above > GAP))
                    pred = [names[b] if s else "und" for b, s in zip(best, spoken, strict=True)]
                else:
                    low, n, score, rejected, pred = np.zeros(rows), np.zeros(rows, int), np.zeros(rows), np.ones(rows, bool), ["und"] * rows
                values = [pred, np.where(spoken, score, 0.0), np.where(spoken, low, 0.0), n, rejected]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *[pa.array(v, t) for v, (_, _, t) in zip(values, RESULT, strict=True)]],
                                                 [*columns, *[r[0] for r in RESULT]])
    return run


def identify(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of the documents with lang_pred, score, entropy, n_letters, rejected."""
    columns = [c for c in columns if c not in {r[0] for r in RESULT}]
    sent = share(docs.sparkSession, model)
    d = docs.select(*columns, F.col(text).alias("_text"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]] + [f"{r[0]} {r[1]}" for r in RESULT])
    return d.mapInArrow(_identify(sent, columns), kinds)


def calibrate(model: Model, docs: DataFrame, lang: Column, text: str = "text") -> Model:
    """Set the rejection limits from texts the counts have not seen (see the module)."""
    d = identify(docs.withColumn("_lang", lang).where("_lang is not null"), model, ["_lang"], text)
    d = cut_lineage(d.where("lang_pred = _lang").select("lang_pred", "entropy", "n_letters"), "calibration")
    mean = d.groupBy("lang_pred").agg(F.avg("entropy").alias("mean"))  # a row per language
    z = (F.col("entropy") - F.col("mean")) * F.sqrt("n_letters")
    for r in d.join(F.broadcast(mean), "lang_pred").groupBy("lang_pred").agg(
            F.first("mean").alias("mean"), F.percentile_approx(z, QUANTILE, 10000).alias("z")).collect():
        model.limits[r["lang_pred"]] = (float(r["mean"]), MARGIN * max(float(r["z"]), 1.0))
    forget(d)
    return model


def _part(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def fitted(docs: DataFrame) -> Model:
    """Trained on parts 0 and 1 of the ids, calibrated on part 3; part 2 is held out. Null ids are never learned from."""
    part = docs.withColumn("_part", _part("doc_id"))
    model = train(part.where("_part in (0, 1)"), F.col("lang"))
    return calibrate(model, part.where("_part = 3"), F.col("lang"))


def op9(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", "lang")
    out = identify(d.withColumn("held_out", F.coalesce(_part("doc_id") == 2, F.lit(False))), fitted(d), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", "n_letters", "rejected")


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The documents the models do not reject, with their own columns. The models are fitted as for ``op9``."""
    own = docs.columns
    # Own columns travel under neutral names, so none can clash with a result.
    d = docs.select(F.col("text").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    kept = identify(d, fitted(docs), [f"c{i}" for i in range(len(own))]).where("not rejected")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
