"""Operators 11 to 13 against plain versions of their definitions, with nulls, ties, skew and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logsift.llm import pivot_search, prefix_trie, source_divergence

CLASH = ["row", "shard", "p", "q", "term", "place", "zero", "value", "item", "rank", "part", "key", "parent", "base", "h", "turns", "kind", "pivot", "dist",
         "score", "query_id", "first", "n", "m", "path", "total"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# ---- 11
DOCS = "doc_id long, text string, lang string, source string"


def plain_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= min_docs)
        count = defaultdict(Counter)
        for _, s, w in own:
            count[s].update(t for t in w if t in set(kept))
        whole = sum(count.values(), Counter())

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            for part, got in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(got)]
    return sorted(out)


def document_rows():
    r = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "straße", "中文", "delta", "x", "rare", "zeta"]
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "one two", "en", "lonely"), (4, "x" * 70_000 + " alpha", "en", None), (5, "1 2 3 !!", "de", "a")]
    for i in range(140):
        source = r.choice(["hot"] * 6 + ["b", "c", "d", ""])
        n = r.choice([1, 3, 30]) if source == "hot" else r.choice([1, 2])
        rows.append((i, " ".join(r.choices(vocabulary, [30, 20, 10, 5, 5, 3, 2, 2, 1, 1], k=n)), r.choice(["en", "en", "fr", None]), source))
    return rows + rows[-7:]


@pytest.mark.parametrize("min_docs,top", [(2, 3), (12, 50), (1000, 50)])
def test_divergence_is_the_plain_one(spark, min_docs, top):
    rows = document_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = source_divergence.divergence(docs, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, min_docs, top)


def test_divergence_of_an_empty_table(spark):
    assert source_divergence.op11(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_counted_in_slices():
    text = ("ab Cd,é1" * 400_000).encode()
    words = [w for part in source_divergence._slices(text) for w in part]
    assert Counter(words) == Counter({b"ab": 1, "éab".encode(): 0}) + Counter(re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.lower())) - Counter({b"ab": 1})
    assert len(list(source_divergence._slices(text))) > 2
    assert list(source_divergence._slices(b"a" * (3 << 20))) == [[b"a" * (3 << 20)]]


# ---- 12
VECS = "vec_id long, embedding array<float>, label int"


def plain_top(rows, k, scale=1024.0):
    """Per query row its best rows, as (query id, [(score, id)])."""
    fine = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in fine]
    out = []
    for a, (q, x) in enumerate(ints):
        if q is not None and q % 100 == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), 2**63 if i is None else i) for b, (i, y) in enumerate(ints) if a != b)[:k]
            out.append((q, [(-s, None if i == 2**63 else i) for s, i in scores]))
    return sorted(out, key=str)


def found(df):
    by = defaultdict(list)
    rows = sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"]))
    for r in rows:
        by[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return by


@pytest.mark.parametrize("shape", ["clusters", "scattered", "copies"])
def test_search_is_the_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(pivot_search, "SMALL_ROWS", 40)
    r = random.Random(shape)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(900):
        c = centres[0 if i % 3 == 0 else i % 12]
        spread = {"clusters": 0.02, "scattered": 1.0, "copies": 0.0}[shape]
        rows.append((i, [x + r.gauss(0, spread) for x in c], 0))
    df = clashing(spark.createDataFrame(rows, VECS).repartition(4))
    rows = [(x["vec_id"], list(x["embedding"]), 0) for x in df.collect()]
    got = found(pivot_search.top_k(df, F.col("vec_id") % 100 == 0, 10))
    want = plain_top(rows, 10)
    assert {q: [(s, i) for _, s, i in v] for q, v in got.items()} == dict(want)
    assert all([n for n, _, _ in v] == list(range(1, 11)) for v in got.values())


def test_bounds_exclude_shards_of_far_clusters(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "SMALL_ROWS", 40)
    r = random.Random(1)
    rows = [(i, [100.0 * (d == i % 16) + r.gauss(0, 0.01) for d in range(16)], 0) for i in range(960)]
    index = pivot_search.Index(pivot_search.cut_lineage(pivot_search.integer_vectors(spark.createDataFrame(rows, VECS), "vec_id", "embedding"), "v"))
    asked = index.table.where("vec_id % 100 = 0")
    near = index.bounds(asked).where("bound < 100 * 1024").select("row", "shard").distinct().count()
    assert index.shards > 8 and near < asked.count() * index.shards / 3


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (100, [1.0], 0), (200, [], 0), (300, None, 0), (400, [1.0, None], 0), (500, [nan, 1.0], 0), (600, [inf], 0),
            (None, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (8, [-1e-9, 0.0], 0), (-100, [0.5, 0.5, 9.0], 0), (100, [1.0], 0)]
    df = spark.createDataFrame(rows, VECS)
    got = sorted((r["query_id"], r["rank"], r["score"], r["vec_id"] or 0) for r in pivot_search.op12(clashing(df)).collect())
    want = sorted((q, n + 1, s, i or 0) for q, v in plain_top(rows, 10) for n, (s, i) in enumerate(v))
    assert got == want and len(want) == 5 * 8
    assert pivot_search.op12(df.limit(0)).count() == 0
    assert pivot_search.op12(df.where("vec_id = 0")).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [2e6, 1.0], 0), (1, [2e6, 1.0], 0), (2, [2e6, 2.0], 0), (3, [-2e6, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r["vec_id"], r["score"]) for r in sorted(pivot_search.op12(df).collect(), key=lambda r: r["rank"])]
    assert got == [(i, s) for s, i in plain_top(rows, 10)[0][1]]


# ---- 13
TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, rebuilt=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            key = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn or 0), key, (r, t)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    if rebuilt:
        cut = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - int(math.fmod(c, 100)), [])[:cut[c]] + v[cut[c]:] for c, v in convs.items()}
    nodes = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = Counter(), Counter()
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] += not kids[n]
        saved[n] += (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in m if convs[c] == list(n)).encode()).hexdigest()) for n, m in nodes.items())


def nodes_of(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def conversation_rows():
    r = random.Random(9)
    rows = [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "b", "tie"), (5, 1, "a", "tie"), (-3, 0, "user", "minus"),
            (5, 2, "user", "x"), (5, 2, "user", "x")]
    for c in range(0, 330):
        if c != 200:
            rows += [(c, i, "user" if i % 2 == 0 else "assistant", r.choice(["hi", "hello \U0001F600", "", "a", "b"])) for i in range(r.randint(1, 7))]
    rows += [(1000 + c, i, "user", "same") for c in range(120) for i in range(8)]  # copies
    rows += [(2000, i, "user", str(i)) for i in range(300)] + [(2001, i, "user", str(i)) for i in range(299)]
    return rows


@pytest.mark.parametrize("shards,batch,fan_in", [(1, 10_000, 64), (8, 3, 2), (5, 1, 3)])
def test_trie_is_the_plain_one(spark, shards, batch, fan_in):
    rows = conversation_rows()
    df = clashing(spark.createDataFrame(rows, TURNS).repartition(3))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(shards),
                "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = nodes_of(prefix_trie.trie(prefix_trie.rebuild(prefix_trie.turns(df)), fan_in))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_trie(rows)


def test_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.op13(empty).count() == 0
    # conversation 100 exists and is short: 101 loses its own first turns to it and may be turnless
    rows = [(c, 0, "user", "only") for c in range(100, 140)] + [(300, None, None, None)]
    assert nodes_of(prefix_trie.op13(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)
