from pyspark.sql import functions as F

from logsift.functions.templates import group_signature, mask, template_id, template_regex
from logsift.plans.logql import label_selector


def test_template_goldens(spark):
    r = spark.createDataFrame([("login 42 from 10.0.0.1", "User <*> a=<int>", "User 7 at 10.0.0.1 0xff", "User <*>")],
                              "a string, b string, c string, d string").select(
        mask(F.col("a")).alias("mask"), template_regex(F.col("b")).alias("rx"),
        group_signature(F.col("c")).alias("sig"), template_id(F.col("d")).alias("tid")).first()
    assert r.mask == "login <int> from <ipv4>"
    assert r.rx == "User .+? a=\\d+"
    assert r.sig == "w num w ipv4 hex"
    assert r.tid == "37467e51fed2dd55"


def test_selector(spark):
    df = spark.createDataFrame([({"service": "auth", "env": "prod", "pod": "x"},), ({},)], "l map<string,string>")
    got = [r.s for r in df.select(label_selector(F.col("l")).alias("s")).collect()]
    assert got == ['{service="auth", env="prod"}', "{}"]


def test_messages_match_their_full_regex(spark):
    from logsift.operators.templates import with_templates
    df = spark.createDataFrame([(1, "user 12 logged in from 10.0.0.1"), (2, "job 7 took 0x1f ms")],
                               "log_id long, message string")
    m = with_templates(df, regex_profile="full")
    assert m.filter(~F.expr("message RLIKE concat('^', regex, '$')")).count() == 0
