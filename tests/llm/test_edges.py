"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from logsift.llm import (best_fit, kd_shards, kn_langid, license_scan, order_minhash, position_index, preference_format,
                         rule_ledger, secret_cnn, url_trust)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the small angry cat near the old mill. "
ROWS = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, PROSE * 3, "en", "a", 1), (3, PROSE * 3, "en", "a", 1),
        (4, PROSE * 3, "en", None, 1), (None, "ein kleiner Hund läuft über die Straße " * 5, "de", "b", 1), (5, "\n\n  \t", "en", "b", 4),
        (6, "x" * 300_000, "en", "b", 300_000), (7, PROSE * 4000, "en", "c", 1), (8, "1234 5678 !!", None, "c", 12),
        (9, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" MIT License', "en", "c", 60), (10, "été à Paris \U0001F600 中文", "fr", "d", 20)]
CLASH = ["size", "row", "digest", "bin", "shard", "kept", "lang_pred", "part", "h", "y", "node", "words", "sample", "_at", "_text",
         "rejected", "base", "spans", "items", "cell", "component", "length", "rank", "held_out", "_part", "_id"]

OPS = {"op2": secret_cnn.op2, "op3": order_minhash.op3, "op4": kd_shards.op4, "op5": rule_ledger.op5, "op7": license_scan.op7,
       "op9": kn_langid.op9}


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("name", OPS)
def test_one_row_per_document_and_no_clash(spark, docs, name):
    plain = OPS[name](docs)
    rows = sorted(map(str, plain.collect()))
    assert len(rows) == len(ROWS)
    if name != "op4":  # rows of a group may swap slots
        assert sorted(map(str, OPS[name](clashing(docs)).select(plain.columns).collect())) == rows
    else:
        assert OPS[name](clashing(docs)).count() == len(ROWS)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, docs, name):
    out = OPS[name](docs.limit(0))
    assert out.columns == OPS[name](docs).columns and out.count() == 0


def test_packing_edges(spark, docs):
    out = best_fit.op6(clashing(docs))
    firsts = out.where("piece = 0").count()
    assert firsts == len(ROWS) and out.columns == best_fit.op6(docs.limit(0)).columns
    assert best_fit.op6(docs.limit(0)).count() == 0
    assert out.where("doc_id in (1, 2)").select("length").distinct().collect()[0][0] == 1


def test_contamination_edges(spark, docs):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "mit license"), (4, "angry cat")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_words"]): r for r in position_index.op8(clashing(docs), items.withColumn("digest", F.lit(1))).collect()}
    hit = rows[(3, 63)]
    assert hit["n_hit"] == 63 and hit["n_items"] == 2 and hit["contaminated"]
    assert rows[(9, 4)]["n_hit"] == 2 and rows[(9, 4)]["n_items"] == 0  # an item without an id hits, but is not listed
    assert rows[(1, 0)]["n_hit"] == 0 and not rows[(1, 0)]["contaminated"]
    assert position_index.op8(docs.limit(0), items).count() == 0
    assert position_index.op8(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_filters_keep_the_columns(spark, docs):
    d = clashing(docs)
    items = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    for out in (order_minhash.keep_one(d), position_index.drop_contaminated(d, items), kn_langid.keep_recognised(d),
                secret_cnn.redact(d, secret_cnn.fit(d))):
        assert out.columns == d.columns
        assert out.count() <= len(ROWS)
    assert order_minhash.keep_one(docs).where("doc_id in (3, 4)").count() == 1
    assert order_minhash.keep_one(docs).where("doc_id is null").count() == 1


PAGES = "page_id long, url string, html string"


def test_url_edges(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://", "x"), (4, "HTTP://A.Example.NET?q=/en/", None), (5, "x://net/y", None),
            (5, "x://net/y", None), (None, "http://a.example.net/en/1#f", "<a href='//B.com/x'>")]
    out = url_trust.op1(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("h")).withColumn("verdict", F.lit("v")))
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == [(0, "a.example.net", "/en/1", "example.net/en/", "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"),
                   (3, "", "", None, "allow"), (4, "a.example.net", "", None, "allow"), (5, "net", "/y", "net/", "block"),
                   (5, "net", "/y", "net/", "block")]
    assert url_trust.op1(spark.createDataFrame([], PAGES)).count() == 0


def test_conversation_edges(spark):
    kind = "conv_id long, turn long, role string, text string, prompt string, n_shared int"
    rows = [(1, 0, "user", "hi", "x", 1), (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", None, "x", 1), (2, 0, "user", "hi", "", 1),
            (2, 1, "assistant", "hello", "", 1), (3, None, None, None, None, None), (None, 0, "user", "hi", None, 0),
            (4, 0, "user", "q", "", 0), (4, 1, "assistant", "a", "", 0), (4, 2, "assistant", "b", "", 0)]
    got = {(r["kind"], r["chosen_id"], r["rejected_id"]): r for r in preference_format.op10(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {("sibling", 2, 1), ("stale", 4, 4)}
    r = got[("sibling", 2, 1)]
    assert r["n_shared"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\nhello<|end|>\n"
    assert r["chosen_mask"] == "14:19" and r["rejected"] == "<|assistant|>\n<|end|>\n" and r["rejected_mask"] == "14:14"
    s = got[("stale", 4, 4)]
    assert s["n_shared"] == 2 and s["chosen"] == "<|assistant|>\nb<|end|>\n" and s["rejected"] == "<|assistant|>\na<|end|>\n"
    assert preference_format.op10(spark.createDataFrame([], kind)).count() == 0
