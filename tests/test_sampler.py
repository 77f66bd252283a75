"""Sampler: ladder goldens, EMA closed form, and batch counters vs a
sequential model (property style)."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logsift.operators.sampling import Policy, decide, ema_alpha, with_counters, with_key


def _frame(spark, rows):
    return spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, tenant string, template_id string, "
                                       "service string, env string, severity string")


def test_ladder_goldens(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=i), "t", "tpl", "svc", "prod", "INFO") for i in range(1, 101)]
    d = {r.log_id: r for r in decide(_frame(spark, rows)).collect()}
    assert (d[1].action, d[1].keep_reason, d[1].sample_rate, d[1].note) == ("KEEP", "NOVEL", 1, "first-occurrence")
    for i in (2, 32):
        assert (d[i].action, d[i].keep_reason, d[i].note) == ("KEEP", "WARMUP", f"n={i}/32")
    for i in (33, 63):
        assert (d[i].action, d[i].keep_reason, d[i].sample_rate) == ("SUPPRESS", "STEADYK", 100)
    assert (d[64].action, d[64].keep_reason, d[64].note) == ("KEEP", "LOG2", "n=64")
    assert (d[100].action, d[100].keep_reason, d[100].sample_rate) == ("KEEP", "STEADYK", 100)


def test_budget_and_severity(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i), "t", "tpl", "svc", "prod", "INFO") for i in range(1, 41)]
    rows += [(100 + i, t0 + timedelta(seconds=i), "t", "tpl", "svc", "prod", "ERROR") for i in range(1, 4)]
    d = {r.log_id: r for r in decide(_frame(spark, rows), Policy(budget_10m=10)).collect()}
    assert d[101].keep_reason == "SEVERITY"
    assert (d[33].action, d[33].keep_reason, d[33].note) == ("SUPPRESS", "BUDGET", "budget>10m: 33>10")


def test_ema_closed_form(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i), "t", "tpl", "svc", "prod", "INFO") for i in range(1, 4)]
    c = with_counters(with_key(_frame(spark, rows))).orderBy("log_id").collect()
    assert abs(ema_alpha(10) - 0.06696700846) < 1e-10
    assert [round(r.ema, 7) for r in c] == [0.066967, 0.1964164, 0.384164]


def ladder_py(policy, sev, total, cur, ema, c10):
    """The ladder for one record, written out."""
    k = policy.steady_k.get(sev) or policy.steady_k_other
    if sev in policy.severity_keep:
        return "KEEP", "SEVERITY"
    if policy.novelty and total <= 1:
        return "KEEP", "NOVEL"
    if ema > 0 and cur >= policy.spike_factor * ema and cur >= policy.min_spike:
        return "KEEP", "SPIKE"
    if total <= policy.warmup_n:
        return "KEEP", "WARMUP"
    if policy.log2 and total > 0 and total & (total - 1) == 0:
        return "KEEP", "LOG2"
    over = policy.budget_10m > 0 and c10 > policy.budget_10m and sev in ("DEBUG", "INFO")
    return ("KEEP" if total % k == 0 else "SUPPRESS"), "BUDGET" if over else "STEADYK"


def _sequential(rows, policy):
    alpha = ema_alpha(policy.half_life)
    state = {}
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (r[2], r[3], r[4], r[5], r[6])
        st = state.setdefault(key, {"total": 0, "ema": 0.0, "b": {}})
        m = int(r[1].timestamp()) // 60
        st["b"][m] = st["b"].get(m, 0) + 1
        st["total"] += 1
        cur = st["b"][m]
        st["ema"] = alpha * cur + (1 - alpha) * st["ema"]
        c10 = sum(v for k, v in st["b"].items() if m - 10 <= k <= m)
        c24 = sum(v for k, v in st["b"].items() if m - 1440 <= k <= m)
        out[r[0]] = (st["total"], cur, c10, c24, st["ema"],
                     ladder_py(policy, r[6], st["total"], cur, st["ema"], c10))
    return out


def test_counters_match_sequential_model(spark):
    rnd = random.Random(7)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        rows.append((i, t0 + timedelta(seconds=rnd.randint(0, 3 * 3600)), rnd.choice(["a", "b"]),
                     rnd.choice(["x", "y"]), "svc", "prod", rnd.choice(["INFO", "DEBUG", "WARN"])))
    pol = Policy(spike_factor=1.5, min_spike=2, warmup_n=4, budget_10m=3, steady_k={"DEBUG": 5, "INFO": 7, "WARN": 3})
    want = _sequential(rows, pol)
    got = decide(_frame(spark, rows), pol).collect()
    for r in got:
        w = want[r.log_id]
        assert (r.seq, r.cur_min, r.count_10m, r.count_24h) == w[:4]
        assert abs(r.ema - w[4]) < 1e-9
        assert (r.action, r.keep_reason) == w[5]
