"""Steps that many queries share: same results as their plain form, and made once, of what is read."""

import random
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsift.functions import patterns as P
from logsift.functions.text import UNI_WS, canonical_ws, detect_schema, nfc
from logsift.operators.normalize import unicode_trim


def _texts(n=3000, seed=5):
    r = random.Random(seed)
    some = ["1", "12", "255", "0x1f", "+", "-", ".", " ", "\t", "\n", "\x0b", " ", " ", "=", "a", "F", "_", "é", "é", ":", "\\", "<int>", "{", "}",
            "1234 5678-9012 3456", "12345678-1234-4234-8234-123456789012", "a:b:1:2:3:4:5:6", "10.0.0.1", "key = v"]
    return ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(n)] + ["", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in _texts()], "t string").repartition(4).cache()


def test_fast_patterns_match_the_same_places(texts):
    for re2, java in P.JAVA.items():
        a, b = (F.regexp_extract_all("t", F.lit(p), 0) for p in (P.translated(re2), java))
        x, y = (F.regexp_replace("t", p, "#") for p in (P.translated(re2), java))
        assert texts.where(~a.eqNullSafe(b) | ~x.eqNullSafe(y)).count() == 0, re2
        assert "(?:(?<=\\w)(?!\\w)|" not in java


def test_plain_steps_equal_their_patterns(texts):
    t = F.col("t")
    trimmed = F.regexp_replace(t, f"^{UNI_WS}+|{UNI_WS}+$", "")
    assert texts.where(~unicode_trim(t).eqNullSafe(trimmed)).count() == 0
    assert texts.where(~canonical_ws(t).eqNullSafe(F.trim(F.regexp_replace(t, "[\\t\\n\\f\\r ]+", " ")))).count() == 0
    pair = ~trimmed.startswith("{") & t.rlike(P.translated(P.LOGFMT_PAIR))
    assert texts.where(~F.coalesce(pair, F.lit(False)).eqNullSafe(detect_schema(t) == "LOGFMT")).count() == 0
    for a, b in texts.select("t", nfc(t)).collect():
        assert b == (None if a is None else unicodedata.normalize("NFC", a))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"job {i} has {i % 7} parts\nan error of disk{i % 5} at 10.0.0.{i}\nanother line, key = {i}", "en", "web", 60) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"error of disk{i} at") for i in range(5)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kinds = ["error", "purchase", "signup", "view"]
    events = [(i, datetime(2024, 1, 1) + timedelta(hours=11 * i), i % 9, kinds[i % 4], i / 8, '{"k":%d}' % i) for i in range(80)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString(), df._jdf.queryExecution().optimizedPlan().toString()


def test_embedding_has_no_interpreted_lambdas(spark):
    from logsift.functions.embed import embed
    assert "lambdafunction" not in _plan(spark.range(1).select(embed(F.col("id").cast("string"))))[1]


@pytest.mark.parametrize("name", ["matched_tokens", "recency_rerank", "logql_strings", "logql_forms", "hits_with_counts", "plan_execute"])
def test_catalog_is_made_once(spark, name, tables, monkeypatch):
    from logsift import registry as R
    from logsift.operators import catalog as C
    calls, real = [], C.to_candidates
    for place in (C, R.C):
        monkeypatch.setattr(place, "to_candidates", lambda m: calls.append(1) or real(m))
    R.QUERIES[name](spark, tables)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["template_regex", "template_memory", "enriched_lines", "stream_keys", "active_streams", "suppressed_rollup", "catalog_by_dimension",
                                  "new_templates", "plan_execute", "drain_templates", "drain_docs"])
def test_kept_rows_hold_only_what_is_read(spark, name, tables):
    from logsift import registry as R
    spark.catalog.clearCache()
    df = R.QUERIES[name](spark, tables)
    kept = [p for p in df._jdf.queryExecution().withCachedData().toString().split("\n") if "InMemoryRelation" in p]
    for p in kept:
        assert "payload" not in p and "token_seq" not in p and "group_signature" not in p, p


def test_texts_without_any_guard_have_nothing_to_redact(texts):
    from logsift.functions import redact as RD
    rules = RD.default_rules()
    more = texts.select(F.concat_ws("-4", "t", F.reverse("t")).alias("t")).union(texts).where("t is not null")
    found = RD.redact(F.col("t"), [*rules, RD.Rule("never", "\x00\x01\x02")])  # one rule without a guard: every text goes through the rules
    assert more.where(~RD.redact(F.col("t"), rules).eqNullSafe(found)).count() == 0
    assert "[0-9][0-9.]" in _plan(more.select(RD.redact(F.col("t"), rules)))[1]
