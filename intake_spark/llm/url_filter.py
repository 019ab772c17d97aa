"""URL filters: fixed rules, and for the rest a tree of path templates per host.

Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. A null
address or one without ``://`` has both empty. A rule ``host/path`` fits its host and all subdomains where the path starts with the
rule's; the longest fitting rule wins.

The tree is learned from all addresses; those that a rule fits are its labelled examples. Level by level, below each node of a host:

* a segment that holds less than 1/16 of the node's pages, or one page, is variable and becomes ``*``; so a node keeps 16 branches at most
* branches with ``ENOUGH`` examples, sorted by their share of blocked ones, are merged with the next one unless a two-proportion test tells
  them apart (|z| > 1.96); a branch with fewer or no examples stays a template of its own. A merged branch is named ``{a,b}``

Segments from ``DEPTH`` on are one ``**``. A template is judged by its own examples alone: it is rejected when it has any and its smoothed purity,
(blocked + 4 * prior) / (labelled + 4), reaches 0.8; the prior is the share of blocked ones among all examples (0.5 if there are none).
Variable segments are judged together, so examples under a ``*`` speak for all pages under it.

Addresses are counted once per host and path; only these narrow rows move, and a host with a third of all pages is split in the joins.

Defined cases: empty host or path form templates as others do; a null page id stays; repeated rows give repeated rows; a template without labelled
examples has the prior as purity and is not rejected; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake_spark.session import publish

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DEPTH, KEPT_SHARE, SMOOTHING, REJECT, DIFFERENT, ENOUGH = 6, 16, 4.0, 0.8, 1.96, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        at = rule.index("/")
        own = rule[:at]
        out = out.when(((host == own) | host.endswith("." + own)) & path.startswith(rule[at:]), F.lit(rule))
    return out


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, verdict in rules:
        out = out.when(rule == name, F.lit(verdict))
    return out


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """host, prefix and the node's branches as an array of (segment, token)."""
    node = ["host", "prefix"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    child = publish(rows.withColumn("segment", F.get("segments", F.lit(level))).groupBy(*node, "segment").agg(*sums), "url-children")
    total = publish(child.groupBy(*node).agg(F.sum("n").alias("all")), "url-nodes")
    kept = (F.col("n") * KEPT_SHARE >= F.col("all")) & (F.col("n") > 1)
    named = child.join(total, node).withColumn("segment", F.when(kept, F.col("segment")).otherwise("*"))
    branch = named.groupBy(*node, "segment").agg(*sums)
    branch = branch.withColumn("enough", F.col("labelled") >= ENOUGH).withColumn("share", F.when(F.col("enough"), F.col("blocked") / F.col("labelled")))
    row = Window.partitionBy(*node).orderBy("enough", "share", "segment")  # 17 branches at most
    before = lambda c: F.lag(c).over(row)
    pooled = (F.col("blocked") + before("blocked")) / (F.col("labelled") + before("labelled"))
    spread = pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / before("labelled"))
    apart = F.when(F.col("enough") & before("enough"), F.pow(F.col("share") - before("share"), F.lit(2.0)) > DIFFERENT**2 * spread).otherwise(True)
    grouped = branch.withColumn("apart", apart.cast("int"))
    grouped = grouped.withColumn("group", F.sum("apart").over(row))
    merged = grouped.groupBy(*node, "group").agg(F.sort_array(F.collect_list("segment")).alias("names"))
    token = F.when(F.size("names") == 1, F.col("names")[0]).otherwise(F.concat(F.lit("{"), F.array_join("names", ","), F.lit("}")))
    single = merged.select(*node, F.explode("names").alias("segment"), token.alias("token"))
    return publish(single.groupBy(*node).agg(F.collect_list(F.struct("segment", "token")).alias("branches")), "url-branches")


def templates(addresses: DataFrame) -> DataFrame:
    """host, path, template for rows of (host, path, n, labelled, blocked)."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    cut = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)
    open_ = addresses.withColumn("segments", cut).withColumn("prefix", F.lit(""))
    done = None
    for level in range(DEPTH + 2):
        open_ = publish(open_, "url-level")
        ended = open_.where(F.size("segments") <= level).select("host", "path", "n", "labelled", "blocked", F.col("prefix").alias("template"))
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.where(F.size("segments") > level)
        if open_.isEmpty():
            break
        joined = open_.join(_branches(open_, level), ["host", "prefix"])
        own = F.get("segments", F.lit(level))
        token = lambda s: F.get(F.filter("branches", lambda x: x["segment"] == s), F.lit(0))["token"]
        joined = joined.withColumn("prefix", F.concat("prefix", F.lit("/"), F.coalesce(token(own), token(F.lit("*")))))
        open_ = joined.drop("branches")
    return done


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and for rows without a rule the template and its purity."""
    own = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    own = publish(own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "url-pages")
    bad = F.coalesce(verdict_of(F.col("rule"), rules) == "block", F.lit(False))
    addresses = own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("labelled"), F.count_if(bad).alias("blocked"))
    placed = publish(templates(addresses), "url-templates")
    every = own.agg(F.count("rule").alias("labelled"), F.count_if(bad).alias("blocked")).first()
    prior = every.blocked / every.labelled if every.labelled else 0.5
    smoothed = (F.sum("blocked") + F.lit(SMOOTHING * prior)) / (F.sum("labelled") + F.lit(SMOOTHING))
    purity = publish(placed.groupBy("host", "template").agg(smoothed.alias("purity"), (F.sum("labelled") > 0).alias("known")), "url-purity")
    free = placed.where("labelled = 0").select("host", "path", "template").join(purity, ["host", "template"])
    free = publish(free, "url-free")
    found = verdict_of(F.col("rule"), rules)
    ruled = own.where("rule is not null").select("page_id", "host", "path", "rule", found.alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    rest = own.where("rule is null").join(free, ["host", "path"])
    return ruled.unionByName(rest.select("page_id", "host", "path", "rule", F.when(F.col("known") & (F.col("purity") >= REJECT), "block").otherwise("allow").alias("verdict"), "template", "purity"))
