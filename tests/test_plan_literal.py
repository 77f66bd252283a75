"""Plans look for their literal before their regex, and postings are made block by block."""

from pyspark.sql import functions as F

from logsift.functions.embed import embed
from logsift.functions.templates import template_regex
from logsift.operators.catalog import to_candidates
from logsift.plans import logql as L
from logsift.plans.token_index import TokenIndex

TEMPLATES = ["user <int> logged in (ok)", "a+b", "<int> <int>", "x <*> y.z <phone> end", "two\\=three words"]
LINES = ["user 17 logged in (ok)", "user x logged in (ok)", "say a+b now", "aab", "7 8", "x 1 y.z <phone> end", "x 1 yzz <phone> end", "two=three words", None, ""]


def test_literal_loses_no_line(spark):
    t = spark.createDataFrame([(x,) for x in TEMPLATES], "template string").withColumn("regex", template_regex(F.col("template")))
    m = t.withColumn("literal", L.plan_literal(F.col("template"), F.col("regex"))).crossJoin(spark.createDataFrame([(x,) for x in LINES], "message string"))
    fits, rx = L.message_fits(F.col("message"), F.col("literal"), F.col("regex")), F.rlike(F.col("message"), F.col("regex"))
    rows = m.select("template", "message", "literal", F.coalesce(fits, F.lit(False)).alias("a"), F.coalesce(rx, F.lit(False)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["b"] for r in rows) >= 5
    found = {r["template"]: r["literal"] for r in rows}
    assert found["user <int> logged in (ok)"] == " logged in (ok)" and found["two\\=three words"] == ""
    other = spark.range(1).select(L.plan_literal(F.lit("some words"), F.lit("other|some words")).alias("l")).first()
    assert other["l"] == ""


def test_postings_hold_every_row_of_a_token(spark, tmp_path):
    rows = [(i, None if i % 11 == 0 else f"w{i % 7} w{i % 300} w{i % 7} common", "a" if i % 3 else "b") for i in range(2000)]
    logs = spark.createDataFrame(rows, "log_id long, message string, s string").select(
        "log_id", F.expr("timestampadd(HOUR, log_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"), "message", F.create_map(F.lit("service"), "s").alias("labels"))
    index = TokenIndex.build(logs.repartition(3), str(tmp_path / "i"), ["service"])
    group = ["date", "block", "__l_service"]
    words = F.explode(F.transform(F.filter(L.tokens(F.col("message")), lambda t: t != ""), lambda t: F.xxhash64(t)))
    size = {tuple(r[:3]): r["count"] for r in index.lines.groupBy(*group).count().collect()}
    want = {tuple(r[:4]): r["rows"] for r in index.lines.select(*group, "row", words.alias("token")).groupBy(*group, "token").agg(F.sort_array(F.collect_set("row")).alias("rows")).collect()}
    got = {tuple(r[:4]): r["rows"] for r in index.postings.select(*group, "token", "rows").collect()}
    assert got == {k: v if len(v) <= max(1, size[k[:3]] // 16) else None for k, v in want.items()}


def test_latest_record_gives_the_candidate(spark):
    rows = [(1, "a", "old", {"Service": "x", "tenant": "t", "pod": "p"}), (2, "a", "new", {"service": "y", "Service": "z", "tenant": "t"}), (3, "b", "only", None)]
    m = spark.createDataFrame(rows, "log_id long, template_id string, template string, labels map<string,string>").select(
        "*", F.lit("r").alias("regex"), F.lit(False).alias("from_fallback"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"))
    got = {r["template_id"]: (r["tenant"], r["template_text"], r["labels"], r["n"]) for r in to_candidates(m).collect()}
    assert got == {"a": ("t", "new", {"service": "y"}, 2), "b": ("default", "only", None, 1)}


def test_short_and_repeating_texts_embed(spark):
    d = spark.createDataFrame([("",), ("a",), ("abc",), ("b a b b",)], "t string").select("t", embed(F.col("t"), 48).alias("v")).collect()
    v = {r["t"]: r["v"] for r in d}
    assert all(abs(sum(x * x for x in w) - 1) < 1e-5 for w in v.values())
    # 3 of 4 words, then 1 of 4: relative frequencies in the second and third quarter, descending.
    assert abs(v["b a b b"][13] / v["b a b b"][14] - 3) < 1e-5 and abs(v["b a b b"][24] / v["b a b b"][25] - 3) < 1e-5
    assert v[""][:12] == [0.0] * 12 and v["abc"][0] > 0 and v["abc"][2] > 0 and v["abc"][3] == 0
