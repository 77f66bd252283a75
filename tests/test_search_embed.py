import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logsift.functions.embed import embed
from logsift.operators.search import knn


def _hu(b):
    return int.from_bytes(hashlib.sha256(b).digest()[:8], "big") / 18446744073709551616.0


def embed_model(text, dim=384):
    """Sequential model of the embedding, written from its specification."""
    t = text.strip().lower()
    q = dim // 4
    words = re.findall(r"(?:[^\W_]|[0-9_-])+", t)
    vec = np.zeros(dim, dtype=np.float32)
    b = t.encode()
    grams = [b[i:i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)]
    for i, g in enumerate(grams[:q]):
        vec[i] = np.float32(_hu(g))
    counts = sorted(Counter(words).values(), reverse=True)
    feats = ([sum(len(w.encode()) for w in words) / len(words) / 20.0] if words else []) + \
        [c / len(words) for c in counts[:10]]
    for i, f in enumerate(feats[:q]):
        vec[q + i] = np.float32(f)
    tf = [c / len(words) for c in counts] + [math.log(len(words) + 1) / 10.0]
    for i, f in enumerate(tf[:q]):
        vec[2 * q + i] = np.float32(f)
    h = _hu(b)
    for i in range(q):
        vec[3 * q + i] = np.float32(h * (i + 1) / q)
    s = 0.0
    for v in vec:
        s += float(np.float32(v * v))
    return (vec * np.float32(1.0 / math.sqrt(s))).astype(np.float32) if s > 0 else vec


def test_embed_bit_exact(spark):
    texts = ["auth login success for user 12345", "database connection timeout", "",
             "  Héllo wörld_1-2 x x x  ", "log message with characters " * 10]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embed(F.col("t")).alias("e"))
    for r in df.collect():
        assert (np.array(r.e, dtype=np.float32) == embed_model(r.t)).all(), r.t


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    V = rng.normal(size=(300, 16))
    Q = rng.normal(size=(5, 16))
    vec = spark.createDataFrame([(str(i), V[i].tolist()) for i in range(len(V))], "id string, embedding array<double>") \
        .repartition(4)
    qs = spark.createDataFrame([(f"q{j}", Q[j].tolist()) for j in range(len(Q))], "query_id string, qvec array<double>")
    got = {(r.query_id, r.rank): r.id for r in knn(qs, vec, 7, "id").collect()}
    Vn = V / np.linalg.norm(V, axis=1, keepdims=True)
    for j in range(len(Q)):
        s = Vn @ (Q[j] / np.linalg.norm(Q[j]))
        order = sorted(range(len(V)), key=lambda i: (-s[i], str(i)))[:7]
        assert [got[(f"q{j}", k + 1)] for k in range(7)] == [str(i) for i in order]
