"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are lower-cased runs without punctuation. A text is the sequence of its
five-word shingles, each labelled with how often it occurred before, so every
labelled shingle occurs once. The similarity of two texts is

    aligned / (shingles of both - aligned),

where ``aligned`` is the longest common subsequence of the two sequences: a
Jaccard similarity that counts only what keeps its order. Texts of 0.8 or more
are linked; classes are the connected components of links.

1. Equal texts are one node from the start (grouped by MD5 with partial
   aggregation), so copies cost nothing later.
2. Sketch: labelled shingles are hashed into ``bins``; each bin keeps its
   ``length`` smallest hashes *in text order*. Texts that agree in a bin's
   sample and its order are candidates. Two texts of similarity 0.8 agree in a
   bin with a chance of at least 0.8^3 = 0.51, so 12 bins miss at most one in
   5,000 of such pairs, fewer of the more similar.
3. A bucket (bin, sample) is searched by leaders, so it emits a few times its own
   size a round: every member against leaders drawn at random per bucket and
   round. Members of the leader's class are not tested again. After the first
   round, a bucket of up to ``SMALL`` members tests all members of different
   classes against each other; a larger one has new leaders, for ``ROUNDS`` rounds
   in all. Leaders only save work; what they leave is searched exactly.
   A pair is only made if the texts' lengths and profiles allow the similarity (``_can_be``): a
   profile counts the labelled shingles in hash slots, and similar texts cannot differ in many.
4. The larger buckets that still have several classes: two texts of similarity 0.8
   share 0.8 of their labelled shingles, so with shingles in one order for all texts,
   the rarest first, they share one among the first ``n - ceil(0.8 n) + 1`` of each,
   and from the first one they share on, each has as many left as they must have in
   common. Texts are joined on these shingles; pairs of different classes that also
   share a bucket are looked up in the one table of pairs compared so far, and the new ones
   verified. So every pair that shares a bucket is decided: it is
   in one class already, or it is compared, or it cannot be similar. A key's largest class is not joined
   with itself. The order is by counts in ``SLOTS`` hash slots, the same for all
   texts; collisions cost comparisons only.
5. Verification: since labelled shingles are unique, the alignment is the
   longest increasing subsequence of matched positions; a band discards matches
   too far off the diagonal to be part of a sufficient alignment.

Defined results: a null text counts as empty; a text without words has no shingles and is only near to
equal texts; a text of one to four words has one shingle of all its words; null
ids are allowed (a class of null ids only has a negative class id); repeated rows are
copies; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.components import components
from logsift.session import cut_lineage, forget

from .common import fresh, share, shared
from .words import Words, mix, occurrences, shingles, text_slices

K, SIMILARITY, BINS, LENGTH = 5, 0.8, 12, 3
PROFILE = 64  # slots of a text's profile
#: A bucket of up to this many members tests all of them against each other;
#: a larger one has this many leaders a round after the first, for so many rounds.
SMALL, LEADERS, ROUNDS = 64, 4, 3
#: Shingle counts that order prefixes are kept by the hash's first 20 bits, and summed in chunks.
SLOTS, CHUNK = 1 << 20, 1 << 14


def sketches(texts: pa.Array, k: int = K, bins: int = BINS, length: int = LENGTH) -> tuple[list, list, np.ndarray, list]:
    """Per text: the word hashes (uint32 bytes), the sample per bin (0: empty bin), the number of
    shingles, and its profile: the labelled shingles in each of ``PROFILE`` hash slots."""
    words = Words(texts)
    short = (words.hash >> np.uint64(32)).astype(np.uint32)
    doc, pos, h = shingles(short, words.first, k)
    n = np.bincount(doc, minlength=len(texts))
    v = mix(h + occurrences(doc, h).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    slot = doc.astype(np.int64) * PROFILE + (v & np.uint64(PROFILE - 1)).astype(np.int64)
    profile = np.minimum(np.bincount(slot, minlength=len(texts) * PROFILE), 32767).astype(np.int16).reshape(len(texts), PROFILE)
    # Sorting by (text, hash) sorts by (text, bin, hash), as the bin is the top of the hash.
    order = np.lexsort((v, doc))
    d, s = doc[order], v[order]
    bin_ = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    group = d.astype(np.int64) * bins + bin_.astype(np.int64)
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    rank = np.arange(len(group)) - (begin[np.cumsum(new) - 1] if len(group) else 0)
    least = rank < length
    group, s, p = group[least], s[least], pos[order][least]
    again = np.lexsort((p, group))  # back to text order within each bin
    group, s = group[again], s[again]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    step = (np.arange(len(group)) - (begin[np.cumsum(new) - 1] if len(group) else 0)).astype(np.uint64)
    out = np.zeros(len(texts) * bins, np.uint64)
    if len(group):
        out[group[begin]] = np.add.reduceat(mix(s + step * np.uint64(0xC2B2AE3D27D4EB4F)), begin) | np.uint64(1)
    raw = short.astype("<u4").tobytes()
    cuts = (words.first * 4).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], out.view(np.int64).reshape(len(texts), bins).tolist(), n, profile.tolist()


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            words, sample, n, profile = sketches(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(words, pa.binary()), pa.array(sample, pa.list_(pa.int64())),
                 pa.array(n, pa.int64()), pa.array(profile, pa.list_(pa.int16()))], ["doc_id", "digest", "words", "sample", "n", "profile"])


def _labelled(words: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles in sorted order, and their positions."""
    _, _, h = shingles(words, np.array([0, len(words)]), k)
    v = mix(h + occurrences(np.zeros(len(h), np.int64), h).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(v)
    return v[order], order


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> float:
    """Ordered similarity of two labelled sequences; 0 as soon as it cannot reach ``least``.

    ``least`` needs lcs >= least / (1 + least) * (la + lb), so at most
    la + lb - 2 lcs shingles are unmatched and no matched pair of positions is
    further than that off the diagonal: the band.
    """
    (va, pa_), (vb, pb) = a, b
    both = len(va) + len(vb)
    need = int(np.ceil(least / (1 + least) * both - 1e-9))
    at = np.minimum(np.searchsorted(vb, va), max(len(vb) - 1, 0))
    hit = vb[at] == va if len(vb) else np.zeros(len(va), bool)
    i, j = pa_[hit], pb[at[hit]]
    near = np.abs(i - j) <= both - 2 * need
    i, j = i[near], j[near]
    if both == 0 or len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        lcs = len(j)
    else:
        ends: list[int] = []  # longest increasing subsequence
        for x in j.tolist():
            p = bisect_left(ends, x)
            if p == len(ends):
                ends.append(x)
            else:
                ends[p] = x
        lcs = len(ends)
    score = lcs / (both - lcs)
    return score if score >= least - 1e-12 else 0.0


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[int, tuple] = {}  # the leader of a run of pairs is labelled once
        keep = []
        u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        for r in range(batch.num_rows):
            if u[r] not in known:
                known = {u[r]: _labelled(np.frombuffer(batch.column("words_u")[r].as_py(), "<u4"))}
            if aligned(known[u[r]], _labelled(np.frombuffer(batch.column("words_v")[r].as_py(), "<u4"))) > 0:
                keep.append(r)
        yield pa.RecordBatch.from_arrays([pa.array([u[r] for r in keep], pa.int64()), pa.array([v[r] for r in keep], pa.int64())], ["u", "v"])


def verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (u, v) whose similarity reaches the bound. Both sides grow with the input, so neither is broadcast."""
    p = (pairs.join(words.select(F.col("node").alias("v"), F.col("words").alias("words_v")).hint("merge"), "v")
              .join(words.select(F.col("node").alias("u"), F.col("words").alias("words_u")).hint("merge"), "u"))
    return p.select("u", "v", "words_u", "words_v").mapInArrow(_verify_batches, "u long, v long")


def _by_leader(members: DataFrame, number: int, leaders: int) -> DataFrame:
    """Candidates (u, v): each bucket's members against its leaders of this round.

    Leaders come as an array per bucket, so a member is a row for each leader it is
    to be compared with, not for each leader there is."""
    own = [F.struct(F.xxhash64("bin", "sample", "node", F.lit(number * LEADERS + i)).alias("draw"), "node", "n", "component", "profile") for i in range(leaders)]
    lead = members.groupBy("bin", "sample").agg(*[F.min(o).alias(f"l{i}") for i, o in enumerate(own)])
    lead = lead.select("bin", "sample", F.array(*[f"l{i}" for i in range(leaders)]).alias("leads"))
    b = members.select("bin", "sample", "node", "n", "component", "profile").join(lead, ["bin", "sample"])
    others = F.filter("leads", lambda x: (x["component"] != F.col("component")) & _can_be(
        F.col("n"), x["n"], F.col("profile"), x["profile"]))
    return _ordered(b.select("node", F.explode(F.transform(others, lambda x: x["node"])).alias("node_2")))


def _among(members: DataFrame) -> DataFrame:
    """Candidates (u, v): all members of small buckets against each other, at most SMALL - 1 a row."""
    own = ("node", "n", "component", "profile")
    a = members.where(F.col("size") <= SMALL).select("bin", "sample", *own)
    pairs = a.join(a.select("bin", "sample", *[F.col(c).alias(f"{c}_2") for c in own]), ["bin", "sample"])
    return _ordered(pairs.where((F.col("component") != F.col("component_2")) & _can_be(F.col("n"), F.col("n_2"), F.col("profile"), F.col("profile_2"))))


def _can_be(n: Column, m: Column, a: Column, b: Column) -> Column:
    """Whether texts of n and m labelled shingles with these profiles can be similar enough.

    A similarity s leaves at most (1 - s) / (1 + s) of both texts' shingles unmatched, and
    each of these changes the profiles' difference by one at most; so no similar pair is refused."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9) & (apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (n + m) + 1e-6)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with u < v, each once."""
    return pairs.select(F.least("node", "node_2").alias("u"), F.greatest("node", "node_2").alias("v")).distinct()


def _fitting(pairs: DataFrame) -> DataFrame:
    """Pairs of different classes whose lengths allow the similarity."""
    fits = (F.col("component") != F.col("component_2")) & (F.least("n", "n_2") >= SIMILARITY * F.greatest("n", "n_2") - 1e-9)
    return pairs.where(fits).select(F.least("node", "node_2").alias("u"), F.greatest("node", "node_2").alias("v")).distinct()


def _slots(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(44)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for w in batch.column("words"):
            np.add.at(counts, _slots(_labelled(np.frombuffer(w.as_py(), "<u4"))[0]), 1)
    parts = counts.reshape(-1, CHUNK)
    some = [i for i in range(len(parts)) if parts[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["chunk", "counts"])


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(c.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"])


def _prefix_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: np.ndarray = shared(sent)
        for batch in batches:
            for part in text_slices(batch, "words"):
                keys, places, lengths = [], [], []
                for w in part.column("words"):
                    v = _labelled(np.frombuffer(w.as_py(), "<u4"))[0]
                    often = counts[_slots(v)]
                    first = np.lexsort((v, often))[:len(v) - int(np.ceil(SIMILARITY * len(v) - 1e-9)) + 1]
                    at = np.flatnonzero(often[first] > 1)  # a shingle counted once is in no other text
                    keys.append(v[first[at]])
                    places.append(at)
                    lengths.append(len(at))
                of = np.repeat(np.arange(part.num_rows), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), *[part.column(c).take(pa.array(of)) for c in ("node", "n", "component")],
                     pa.array(np.concatenate(places).astype(np.int64))], ["key", "node", "n", "component", "pos"])
    return run


def _by_prefix(members: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates (u, v): all pairs of different classes that share a bucket and may be similar; see the module's step 4."""
    who = members.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("component").alias("component"),
                                      F.collect_set(F.xxhash64("bin", "sample")).alias("shared"))
    who = cut_lineage(who, "open")
    texts = words.join(who.select("node", "n", "component").hint("merge"), "node").select("node", "n", "component", "words")
    counts = np.zeros((SLOTS // CHUNK, CHUNK), np.int64)
    kinds = "chunk int, counts binary"
    for r in texts.select("words").mapInArrow(_count_batches, kinds).repartition("chunk").mapInArrow(_sum_batches, kinds).collect():
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    rows = texts.mapInArrow(_prefix_batches(share(words.sparkSession, counts.reshape(-1))), "key long, node long, n long, component long, pos long")
    rows = cut_lineage(rows, "prefixes")
    keys = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(
        F.max(F.struct("size", "component"))["component"].alias("big"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    mixed = cut_lineage(rows.join(keys.select("key", "big"), "key"), "mixed")
    forget(rows)
    a = mixed.where("component != big")
    b = mixed.select("key", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "component", "pos")])
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("n_2")) - 1e-9)
    once = (F.col("component_2") == F.col("big")) | (F.col("node") < F.col("node_2"))
    pairs = cut_lineage(_fitting(a.join(b, "key").where(once & (F.least(F.col("n") - F.col("pos"), F.col("n_2") - F.col("pos_2")) >= need))), "pairs")
    forget(mixed)
    of = lambda end: who.select(F.col("node").alias(end), F.col("shared").alias(f"shared_{end}"))
    out = cut_lineage(pairs.join(of("u"), "u").join(of("v"), "v").where(F.arrays_overlap("shared_u", "shared_v")).select("u", "v"), "pairs")
    forget(pairs, who)
    return out


def _mixed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Members, with their class, of the buckets that have several classes."""
    members = buckets.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("bin", "sample").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1")
    return cut_lineage(members.join(mixed.select("bin", "sample"), ["bin", "sample"], "left_semi"), "members")


def linked(buckets: DataFrame, words: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a verified link; see the module's steps 3 to 5.

    ``buckets`` has bin, sample, node, n, size and profile; ``words`` has node, words; both are written tables.
    Without profiles, no pair is refused for them.
    """
    if "profile" not in buckets.columns:
        buckets = buckets.withColumn("profile", F.array().cast("array<smallint>"))
    members = buckets.withColumn("component", F.col("node"))
    pairs = _by_leader(members, 0, 1)
    tested, classes, number = None, None, 0

    def untested(pairs: DataFrame) -> DataFrame:
        """What has not been compared yet: one lookup in one table, however many rounds there were."""
        return pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")

    while True:
        pairs = cut_lineage(untested(pairs), "pairs")
        new = cut_lineage(verify(pairs, words), "links")
        before, tested = tested, pairs if tested is None else cut_lineage(tested.union(pairs), "tested")
        if before is not None:
            forget(before, pairs)
        if number > 0 and new.isEmpty():
            forget(new)
            break
        # Classes so far and what is new; one table instead of all links.
        known = new if classes is None else new.union(classes.select(F.col("node").alias("u"), F.col("component").alias("v")))
        before, classes = classes, cut_lineage(components(known), "classes")
        forget(new, before, members if number else None)
        number += 1
        members = _mixed(buckets, classes)
        if number == ROUNDS:
            break
        pairs = _by_leader(members.where(F.col("size") > SMALL), number, LEADERS)
        if number == 1:
            pairs = pairs.union(_among(members)).distinct()
    left = members.where(F.col("size") > SMALL)
    if not left.isEmpty():
        pairs = _by_prefix(left, words)
        new = verify(untested(pairs), words)
        before, classes = classes, cut_lineage(components(new.union(classes.select(F.col("node").alias("u"), F.col("component").alias("v")))), "classes")
        forget(before, pairs)
    forget(members, tested)
    return classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest (MD5 of the text), class_id (the smallest doc_id of its class)."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(t).alias("digest"), t.alias("text"))
    d = d.mapInArrow(_sketch_batches, "doc_id long, digest string, words binary, sample array<long>, n long, profile array<short>")
    rows = cut_lineage(d.withColumn("row", F.monotonically_increasing_id()), "sketches")
    # One node per distinct text, named by one of its rows; copies combine before the shuffle.
    texts = rows.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.any_value("n").alias("n"),
                                       F.any_value("sample").alias("sample"), F.any_value("profile").alias("profile"))
    texts = cut_lineage(texts, "texts")
    exploded = texts.select("node", "n", "profile", F.posexplode("sample").alias("bin", "sample")).where("sample != 0")
    sizes = exploded.groupBy("bin", "sample").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut_lineage(exploded.join(sizes, ["bin", "sample"]), "buckets")
    ids = cut_lineage(rows.select("doc_id", "digest"), "ids")
    words = cut_lineage(rows.select(F.col("row").alias("node"), "words").join(buckets.select("node").distinct().hint("merge"), "node", "left_semi"), "words")
    forget(rows)
    classes = linked(buckets, words)
    forget(buckets, words)
    of = texts.select("digest", "node", "least_id").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least_id").alias("class_id"))
    named = of.join(least, "component").select("digest", F.coalesce("class_id", -1 - F.col("component")).alias("class_id"))
    return ids.join(named, "digest").select("doc_id", "digest", "class_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: one row of each class stays, the smallest by (id, digest)."""
    at = fresh(docs, "_at")
    # The same key for the join and for repeated rows, so the texts are shuffled once.
    key = lambda i, d: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), d)
    kept = near_duplicates(docs, doc_id, text).groupBy("class_id").agg(F.min(F.struct("doc_id", "digest")).alias("b"))
    kept = kept.select(key(F.col("b.doc_id"), F.col("b.digest")).alias(at))
    d = docs.withColumn(at, key(F.col(doc_id).cast("long"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    # Equal texts of equal ids are told apart by nothing: one of them stays.
    return d.join(kept, at, "left_semi").dropDuplicates([at]).select(docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "digest")
