"""URL filter by link-graph propagation.

1. Rules (host suffix, path prefix, verdict) judge the urls they fit; the
   longest wins.
2. Hosts most of whose pages an allow rule fits are trusted seeds, those most
   of whose pages a block rule fits are blocked seeds, weighted by pages.
3. Trust spreads along host links by personalised PageRank from the trusted
   seeds; distrust spreads against them from the blocked seeds, since a host
   that links to a blocked one deserves less trust.
4. A host is blocked if its share of distrust in both scores exceeds a
   threshold. Pages that no rule fits get their host's verdict.

Host links are the absolute and protocol-relative links of the pages, plus a
link in both directions between a host and its parent domain. Pages are reduced
to distinct host pairs by partial aggregation before anything else, so the
iterations work on the host graph; all joins are keyed and split when skewed.

The number of iterations follows from the damping factor d: after n of them the
scores are within d^n of the fixpoint (``tolerance``). Mass at hosts without
links leaves the walk.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule and is allowed; null html has no links; repeated rows are judged alike;
an empty table gives no rows; columns other than page_id, url and html are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.session import cut_lineage

from .common import ascii_lower

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING, TOLERANCE, SEED_SHARE, BLOCK_SHARE = 0.5, 1e-3, 0.5, 0.75


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as 'host/path', verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def parse(pages: DataFrame, rules=RULES) -> DataFrame:
    p = pages.select("page_id", "url", "html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return p.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(parsed: DataFrame) -> DataFrame:
    """Distinct (src, dst, weight) host pairs; weight grows with the log of the linking pages."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\shref\s*=\s*[\"']?((?:https?:)?//[^\s\"'<>]+)"), F.lit(1))
    page = (parsed.where(F.col("html").rlike(r"(?i)href\s*=\s*[\"']?(https?:)?//"))
                  .select("host", F.explode(F.array_distinct(F.transform(
                      links, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))))).alias("dst"))
                  .groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("pages")))
    child = parsed.select("host").union(page.select("dst")).where("host != ''").distinct()
    parent = child.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("up")).where("instr(up, '.') > 0 and up != host")
    tree = parent.select(F.col("host").alias("src"), F.col("up").alias("dst")).union(parent.select("up", "host"))
    e = page.select("src", "dst", (1 + F.log2("pages")).alias("w")).union(tree.select("src", "dst", F.lit(1.0)))
    return e.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def seeds(parsed: DataFrame, seed_share: float = SEED_SHARE) -> DataFrame:
    """(walk, host, weight): hosts by the share of their pages that rules allow or block."""
    n = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0))
    h = parsed.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), n("allow").alias("trust"), n("block").alias("distrust"))
    return (h.select("host", "n", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (walk, pages)"))
             .where(F.col("pages") > F.col("n") * seed_share).select("walk", "host", F.col("pages").cast("double").alias("weight")))


def propagate(edges: DataFrame, seed: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). Both walks run together, distrust on reversed edges."""
    walk = edges.select(F.lit("trust").alias("walk"), "src", "dst", "w").union(edges.select(F.lit("distrust"), "dst", "src", "w"))
    out = walk.groupBy("walk", "src").agg(F.sum("w").alias("out"))
    walk = cut_lineage(walk.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("w") / F.col("out")).alias("p")), "host-edges")
    whole = seed.groupBy("walk").agg(F.sum("weight").alias("whole"))  # two rows
    seed = cut_lineage(seed.join(F.broadcast(whole), "walk").select("walk", "host", (F.col("weight") / F.col("whole")).alias("s")), "host-seeds")
    start = seed.select("walk", "host", (F.col("s") * (1 - damping)).alias("r"))
    rank = start
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping))):
        moved = (rank.join(walk.withColumnRenamed("src", "host"), ["walk", "host"])
                     .select("walk", F.col("dst").alias("host"), (F.col("r") * F.col("p") * damping).alias("r")))
        rank = moved.union(start).groupBy("walk", "host").agg(F.sum("r").alias("r"))
    of = lambda k: F.round(F.sum(F.when(F.col("walk") == k, F.col("r")).otherwise(0.0)), 9).alias(k)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge_hosts(scores: DataFrame, block_share: float = BLOCK_SHARE) -> DataFrame:
    spam = F.coalesce(F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)), F.lit(0.0))
    return scores.select("host", "trust", "distrust", F.when(spam > block_share, "block").otherwise("allow").alias("host_verdict"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    parsed = parse(pages, rules)
    slim = parsed.drop("html", "url")
    hosts = judge_hosts(propagate(host_edges(parsed), seeds(slim)))
    judged = slim.join(hosts, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op1(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)
