"""URL filter by a path-template tree.

A url is its host and its path's segments. Per host the segments form a tree. Segments that vary by form (numbers,
hexadecimal or mixed identifiers) become wildcards at once; then, level by level from the root, children whose
share of bad labels doesn't differ from their siblings' are merged into one wildcard branch: all without labels, and
those whose likelihood ratio against their siblings, of raw counts, is below that of a z of SIMILAR. As of many siblings
some differ by chance, the bound grows with the number of siblings that have labels. What is left are templates; each has a purity: its labelled share of
bad pages, smoothed towards its host's share, which is smoothed towards the share of all pages. Templates of purity above
BAD are blocked; without any labels all have BAD and are allowed.

The tree works on distinct generalised paths with counts, aggregated map-side, so a host may hold any share of the
pages. There is a round for each level at which two
paths of a host share a branch; finished paths are in no further round. Null urls and urls without :// have an empty host and path and
are judged as one template; repeated pages count each; pages without label count in no share. Urls of any length are
read whole. An empty table gives an empty one. Other columns pass through, of any name, but for those called host, path,
rule, template, purity or verdict, which are replaced.
Rules fit a host and its subdomains when the path starts with the rule's path; the longest wins over the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamga.llm.blocks import Kept, cut, free

SIMILAR = 2.0
WEIGHT = 4.0
BAD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = ("n", "labelled", "bad")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments_of(path: Column) -> Column:
    """All segments, variable parts as wildcards."""
    form = lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]*\d[0-9a-fA-F]{7,}", "{id}"), r"\d+", "{n}")
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), form)


def _unlikeness() -> Column:
    """Twice the log likelihood ratio of a child and its siblings having shares of their own to having one: the square
    of a z. 0 when either has no labels."""
    fit = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(F.lit(0.0))
    both = lambda bad, n: fit(bad, n) + fit(n - bad, n)
    n, bad, all_n, all_bad = (F.col(c).cast("double") for c in ("labelled", "bad", "all_labelled", "all_bad"))
    return 2 * (both(bad, n) + both(all_bad - bad, all_n - n) - both(all_bad, all_n))


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, segments, template, purity) from pages (host, segments, bad int or null)."""
    with Kept(pages.sparkSession) as keep:
        return cut(_grown(pages, keep))


def _grown(pages: DataFrame, keep: Kept) -> DataFrame:
    bad = F.col("bad")
    tree = pages.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("bad"))
    tree = keep(tree.withColumn("template", F.lit("")).withColumn("open", F.lit(True)))
    done, level = [], 0
    while not tree.where("open").isEmpty():  # a level reads the tree four times, so each starts from a kept one
        tree = tree.where("open").withColumn("child", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        sums = [F.sum(c).alias(c) for c in COUNTS]
        kids = tree.groupBy("host", "template", "child").agg(*sums, F.count(F.lit(1)).alias("paths"))
        own = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.count_if(F.col("labelled") > 0).alias("known"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.sum("paths").alias("all_paths"))
        kids = kids.join(own, ["host", "template"])
        merged = (F.col("kids") > 1) & ((F.col("labelled") == 0) | (_unlikeness() < SIMILAR**2 + 2 * F.log(F.greatest(F.col("known") - 1, F.lit(1)))))
        kids = kids.select("host", "template", "child", F.when(F.col("child") == "", "").when(merged, "/*").otherwise(F.concat(F.lit("/"), "child")).alias("step"), (F.col("all_paths") == 1).alias("alone"))
        tree = tree.join(kids, ["host", "template", "child"])
        # a path that shares its branch with no other has no siblings further down
        rest = F.transform(F.filter(F.slice("segments", level + 2, F.greatest(F.size("segments"), F.lit(1))), lambda s: s != ""), lambda s: F.concat(F.lit("/"), s))
        rest = F.when(F.col("alone"), F.array_join(rest, "")).otherwise("")
        tree = keep(tree.select("host", "segments", *COUNTS, F.concat("template", "step", rest).alias("template"), (~F.col("alone") & (F.size("segments") > level)).alias("open")))
        done.append(f"{keep.folder}/{keep.count}")
        level += 1
    tree = (keep.spark.read.schema(tree.schema).parquet(*done) if done else tree).where("not open").drop("open")
    everywhere = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 1.0)).alias("base")).scalar()
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    hosts = hosts.select("host", ((F.col("host_bad") + WEIGHT * everywhere) / (F.col("host_labelled") + WEIGHT)).alias("host_share"))
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(hosts, "host")
    purity = (F.col("bad") + WEIGHT * F.col("host_share")) / (F.col("labelled") + WEIGHT)
    return tree.select("host", "segments", "template").join(templates.select("host", "template", purity.alias("purity")), ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame | None, rules: dict[str, str], url: str = "url", key: str = "page_id") -> DataFrame:
    """pages with host, path, rule, template, purity and verdict. labels: (key, bad) with 1 or 0, repeated keys as
    the worst. rules: rule (host/path) to 'block' or 'allow'."""
    parsed = pages.drop("host", "path", "rule", "template", "purity", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    (segments,) = free(parsed.columns, "_segments")
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn(segments, segments_of(F.col("path")))
    seen = parsed.select(F.col(key).alias("_key"), "host", F.col(segments).alias("segments"))
    if labels is None:
        seen = seen.withColumn("bad", F.lit(None).cast("int"))
    else:
        worst = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("bad").cast("int").alias("bad"))
        seen = seen.join(worst, "_key", "left")
    tree = template_tree(seen).withColumnRenamed("segments", segments)
    out = parsed.join(tree, ["host", segments], "left").drop(segments)
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("purity") > BAD, "block").otherwise("allow")))
