"""The secret network learns from all findings, shard by shard."""

import numpy as np
import pytest

from logsift.llm import secret_cnn


def texts(n):
    r = np.random.default_rng(3)
    say = lambda k: " ".join("abcdefghij"[i] * 3 for i in r.integers(0, 10, k))
    return [f"{say(4)} {'password = ' + ''.join('aB3xK9'[j] for j in r.integers(0, 6, 24)) if i % 2 else f'item_{say(1)}_number_{i}_part'} {say(3)}" for i in range(n)]


def seen(spark, rows, size, monkeypatch):
    """Findings that training and calibration were given, and the network."""
    made = []
    old = secret_cnn.cut_lineage

    def kept(df, name=None):
        out = old(df, name)
        if name == "items":
            made.append([r for r in out.collect()])
        return out
    monkeypatch.setattr(secret_cnn, "cut_lineage", kept)
    net = secret_cnn.fit(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), size=size)
    return made[0], net


@pytest.mark.parametrize("size", [400, 1 << 14])
def test_every_finding_takes_part(spark, size, monkeypatch):
    monkeypatch.setattr(secret_cnn, "VARIANTS", 20)
    monkeypatch.setattr(secret_cnn, "EPOCHS", 2)
    rows = texts(5000)  # 2,500 of each label, more than the 2,000 that a sample once held
    shards, net = seen(spark, rows, size, monkeypatch)
    given = {t[a:b] for r in shards for t, a, b in zip(r["text"], r["a"], r["b"], strict=True)}
    assert {f[2] for t in rows for f in secret_cnn.findings(t) if f[0] >= 0} <= given
    assert len({r["shard"] for r in shards}) == (13 if size == 400 else 1) and 0 < net.threshold < 1


def test_layout_of_rows_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(secret_cnn, "VARIANTS", 20)
    monkeypatch.setattr(secret_cnn, "EPOCHS", 2)
    d = spark.createDataFrame(list(enumerate(texts(1500))), "doc_id long, text string")
    a, b = (secret_cnn.fit(x, size=400) for x in (d.repartition(2), d.orderBy(d.doc_id.desc()).repartition(7)))
    assert np.array_equal(a.state(), b.state()) and (a.scale, a.shift, a.threshold) == (b.scale, b.shift, b.threshold)
