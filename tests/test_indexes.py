"""Inverted lists and the token index: exact where they cover all, complete where they prune."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.operators import search as S
from logsift.operators.vector_index import VectorIndex, centroids
from logsift.plans import logql as L
from logsift.plans.token_index import TokenIndex
from logsift.registry import docs_plans, label_centroids, normalized_docs
from logsift.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def clustered(spark, n=3000, groups=40, dims=16):
    r = np.random.default_rng(4)
    centre = r.normal(size=(groups, dims))
    rows = [(f"{i:05d}", (centre[0 if i % 3 == 0 else i % groups] + r.normal(scale=0.15, size=dims)).tolist(), "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows + [("none", None, "a"), (None, [1.0] * dims, "a"), ("short", [1.0], "a"), ("nan", [float("nan")] * dims, "a")],
                                 "id string, embedding array<double>, tenant string").repartition(6)


def test_all_lists_are_the_exact_search(spark, tmp_path, monkeypatch):
    v = clustered(spark)
    q = v.where("id like '%00'").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"), F.create_map(F.lit("tenant"), F.array("tenant")).alias("f"))
    exact = hits(S.knn(q, v, 10, "id", filter_cols=("tenant",), query_filters="f"))
    index = VectorIndex.build(v, str(tmp_path / "i"))
    assert len(exact) == 300 and 40 <= len(index.centroids) <= 55
    assert hits(index.search(q, 10, len(index.centroids), filter_cols=("tenant",), query_filters="f")) == exact
    monkeypatch.setattr(S, "BLOCK_BYTES", 8 * 16 * 4)  # blocks of four queries
    assert hits(VectorIndex(spark, str(tmp_path / "i")).search(q, 10, None, filter_cols=("tenant",), query_filters="f")) == exact
    assert hits(S.knn(q, v, 10, "id", filter_cols=("tenant",), query_filters="f")) == exact


def recall(found, exact):
    want = {(q, i) for q, _, i, _ in exact}
    return len({(q, i) for q, _, i, _ in found} & want) / len(want)


def test_few_lists_keep_the_recall_and_read_few_partitions(spark, tmp_path):
    v = clustered(spark)
    q = v.where("id like '%00'").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    index = VectorIndex.build(v, str(tmp_path / "i"))
    found, exact = hits(index.search(q, 10, 12)), hits(S.knn(q, v, 10, "id"))
    assert recall(found, exact) >= 0.95
    one = index.search(q.limit(1), 10, 2)
    assert re.search(r"PartitionFilters: \[[^]]*list#\d+ IN \(\d+,\d+\)", one._jdf.queryExecution().toString())


def test_recall_on_scattered_embeddings_grows_to_all(spark, tmp_path):
    e = read_table(spark, SF, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    index = VectorIndex.build(e, str(tmp_path / "i"))
    q = label_centroids(spark, SF)
    exact = hits(S.knn(q, e, 10, "id"))
    few, all_ = (recall(hits(index.search(q, 10, n)), exact) for n in (2, len(index.centroids)))
    assert 0 < few <= all_ == 1.0


def test_centroids_of_few_and_equal_vectors():
    same = S.unit(np.ones((5, 3)))
    assert centroids(same, 4).shape == (1, 3)
    some = S.unit(np.eye(3))
    assert np.allclose(np.sort(centroids(some, 8), axis=0), np.sort(some, axis=0))


def test_index_of_nothing(spark, tmp_path):
    v = clustered(spark).limit(0)
    index = VectorIndex.build(v, str(tmp_path / "i"))
    q = spark.createDataFrame([("q", [1.0] * 16)], "query_id string, qvec array<double>")
    assert index.search(q, 3, 1).count() == 0 and index.search(q, 3).count() == 0


def test_searches_in_a_time_range(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    v = spark.createDataFrame([("a", [1.0, 0.0], t(1), t(3)), ("b", [1.0, 0.1], t(5), t(6)), ("c", [1.0, 0.2], t(2), t(9))],
                              "id string, embedding array<double>, first_seen timestamp_ntz, last_seen timestamp_ntz")
    q = spark.createDataFrame([("in", [1.0, 0.0], t(4), t(5)), ("open", [1.0, 0.0], None, t(1)), ("any", [1.0, 0.0], None, None), ("late", [1.0, 0.0], t(10), None)],
                              "query_id string, qvec array<double>, start timestamp_ntz, end timestamp_ntz")
    got = {}
    for query, _, i, _ in hits(S.knn(q, v, 5, "id")):
        got.setdefault(query, []).append(i)
    assert got == {"in": ["b", "c"], "open": ["a"], "any": ["a", "b", "c"]}


KEYS = ["service", "env"]


def lines(spark):
    r = random.Random(2)
    rows = []
    for i in range(600):
        service = "hot" if i % 3 == 0 else r.choice(["a", "b"])
        words = [r.choice(["error", "user", "took", "ms", "x"]) for _ in range(r.randint(1, 6))] + ([f"rare{i % 37}"] if i % 2 else []) + ["end"]
        rows.append((i, None if i % 50 == 7 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 90), " ".join(words), {"service": service, "env": r.choice(["p", ""])}))
    rows.append((1000, dt.datetime(2024, 1, 2), None, {"service": "a"}))
    rows.append((1001, dt.datetime(2024, 1, 2), "", None))
    return spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, message string, labels map<string,string>").repartition(4)


def plans(spark):
    rows = [("rare", "user rare3 end", r"rare3 end", {"service": "a"}), ("often", "x error end", r"error", {"env": "p"}), ("any", "x took ms y", r"took\ ms", {}),
            ("loose", "<*> end", r".+? end", {"service": "b"}), ("free", "<*>", r"rare1\d end$", {}), ("none", "a nothing b", "nothing", {"service": "a"}),
            ("null", "x user y", "user", None)]
    return spark.createDataFrame(rows, "plan_id string, template_text string, regex string, labels map<string,string>")


@pytest.mark.parametrize("start,end", [(None, None), ("2024-01-02 03:00:00", "2024-01-03 12:00:00"), ("2024-01-03 00:00:00", None), (None, "2023-01-01 00:00:00")])
def test_index_and_scan_find_the_lines_that_a_loop_finds(spark, tmp_path, start, end):
    ln, pl = lines(spark), plans(spark)
    want = []
    for row in ln.collect():
        for p in pl.collect():
            inside = (start is None or (row["ts"] and str(row["ts"]) >= start)) and (end is None or (row["ts"] and str(row["ts"]) <= end))
            fits = all(not (p["labels"] or {}).get(k) or (p["labels"] or {})[k] == ((row["labels"] or {}).get(k) or "") for k in KEYS)
            if inside and fits and row["message"] is not None and re.search(p["regex"], row["message"]):
                want.append((p["plan_id"], row["log_id"]))
    index = TokenIndex.build(ln, str(tmp_path / "i"), KEYS)
    for out in (L.execute_plan(ln, pl, start, end, KEYS), index.execute(pl, start, end)):
        assert sorted((r["plan_id"], r["log_id"]) for r in out.collect()) == sorted(want)
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_index_prunes_days_and_rare_tokens(spark, tmp_path):
    index = TokenIndex.build(lines(spark), str(tmp_path / "i"), KEYS)
    pl = L.prepared_plans(plans(spark).where("plan_id = 'rare'"), KEYS)
    found = index.candidates(pl, "2024-01-02 00:00:00", "2024-01-02 23:00:00")
    assert found.where("row IS NULL").count() == 0 and 0 < found.count() < 20
    assert found.select("date").distinct().count() == 1
    days = {r[0] for r in index.lines.select("date").distinct().collect()}
    index.drop_before("2024-01-03")
    left = {r[0] for r in index.lines.select("date").distinct().collect()}
    assert left == {d for d in days if d is None or d >= dt.date(2024, 1, 3)} and index.postings.where("date < '2024-01-03'").count() == 0


def test_plans_of_the_documents_from_index_and_scan(spark, tmp_path):
    from logsift.operators.templates import materialize
    logs = materialize(normalized_docs(spark, SF))
    pl = docs_plans(spark, SF, logs)
    index = TokenIndex.build(logs, str(tmp_path / "i"))
    a, b = ({(r["plan_id"], r["log_id"]) for r in x.collect()} for x in (L.execute_plan(logs, pl), index.execute(pl)))
    assert a == b and a
