"""URL filtering by a path-template tree, with Spark expressions only.

Rules give some urls a verdict: a rule fits its host and all subdomains if the url's path starts with the rule's path; the longest wins.
For the others the urls that rules decide are the labels. Urls are first counted by host and path. Per host a tree of templates is
grown level by level, as deep as the paths go. At each node a segment stays literal if more than one url has it and it is large (one in ``SHARE`` of
the node's urls, or ``SUPPORT`` of them) or its labels are its own (of at least ``LABELLED`` labelled urls, with a rate of blocked ones
that differs from the rest of the node's by a two-proportion z of ``OWN``); all other segments are generalised into one wildcard. Sibling
branches whose rates of blocked among labelled urls do not differ significantly (z below ``LIKE``) are merged: they share the next
node, so what follows them is counted together. A template's purity is (blocked + ``PRIOR`` x rate) / (labelled + ``PRIOR``), with the rate of
blocked among all labelled urls; a template is rejected if that is over one half and urls of it were blocked.

A node's few branches are joined to its urls by broadcast if there are at most ``SMALL`` in the table, else by a shuffle. Defined
cases: a null url, or one without ``://``, has an empty host and path; an empty path is its own template; equal urls are
judged alike; repeated rows stay; without labels all is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.llm.common import Scratch

SHARE, SUPPORT, LABELLED, OWN, LIKE, PRIOR = 20, 100, 5, 3.0, 1.96, 2.0
#: Rows that a broadcast table may have (each of some hundred bytes).
SMALL = 50_000
# ASCII letters, for lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _z(b1: Column, m1: Column, b2: Column, m2: Column) -> Column:
    """Two-proportion z of b1 of m1 against b2 of m2; null where there is nothing to compare."""
    pooled = (b1 + b2) / F.nullif(m1 + m2, F.lit(0))
    return (b1 / F.nullif(m1, F.lit(0)) - b2 / F.nullif(m2, F.lit(0))) / F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(m1, F.lit(0)) + 1 / F.nullif(m2, F.lit(0)))), F.lit(0.0))


def sized(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def branches(tree: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame]:
    """From rows (host, node, seg, b, a, n): the literal segments (host, node, seg), and each branch (host, node, grown) with its cluster
    and the number of paths in that."""
    sums = lambda *by: (F.sum(c).alias(c) for c in by)
    ones = scratch.save(tree.groupBy("host", "node", "seg").agg(*sums("n", "b", "a"), F.count(F.lit(1)).alias("p")), f"segments-{level}")
    node = ones.groupBy("host", "node").agg(F.sum("n").alias("all"), F.sum("p").alias("all_p"), F.sum("b").alias("all_b"), F.sum(F.col("b") + F.col("a")).alias("all_m"))
    m = F.col("b") + F.col("a")
    own = (m >= LABELLED) & (F.abs(_z(F.col("b"), m, F.col("all_b") - F.col("b"), F.col("all_m") - m)) >= OWN)
    large = (F.col("n") * SHARE >= F.col("all")) | (F.col("n") >= SUPPORT)
    literal = ones.where("n > 1").join(node, ["host", "node"]).where((F.col("n") > 1) & (large | F.coalesce(own, F.lit(False))))
    literal = scratch.save(literal.select("host", "node", "seg", "n", "b", "a", "p"), f"literals-{level}")
    named = literal.select("host", "node", F.concat(F.lit("="), "seg").alias("grown"), "n", "b", "a", "p")
    rest = node.join(named.groupBy("host", "node").agg(*sums("n", "b", "p"), F.sum(F.col("b") + F.col("a")).alias("m")), ["host", "node"], "left")
    left = lambda every, own: F.col(every) - F.coalesce(F.col(own), F.lit(0))
    rest = rest.select("host", "node", F.lit("*").alias("grown"), left("all", "n").alias("n"), left("all_b", "b").alias("b"), (left("all_m", "m") - left("all_b", "b")).alias("a"), left("all_p", "p").alias("p")).where("n > 0")
    every = named.unionByName(rest).withColumn("m", F.col("b") + F.col("a")).withColumn("rate", (F.col("b") + 0.5) / (F.col("m") + 1))
    order = Window.partitionBy("host", "node").orderBy("rate", "grown")
    new = _z(F.col("b"), F.col("m"), F.lag("b").over(order), F.lag("m").over(order)) >= LIKE
    every = every.withColumn("new", F.coalesce(new.cast("int"), F.lit(0))).select("host", "node", "grown", "p", F.sum("new").over(order).cast("string").alias("cluster"))
    every = every.select("host", "node", "grown", "cluster", F.sum("p").over(Window.partitionBy("host", "node", "cluster")).alias("mates"))
    return literal.select("host", "node", "seg", F.lit(True).alias("literal")), scratch.save(every, f"branches-{level}")


def templates(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """From (host, path, b, a, u), counts of blocked, allowed and unlabelled urls: host, path, b, a, ``template``, an array of segments or ``*``,
    and ``node``, which templates of merged branches share."""
    n = F.col("b") + F.col("a") + F.col("u")
    tree = paths.select("host", "path", "b", "a", n.alias("n"), F.split(F.regexp_replace("path", "^/", ""), "/", -1).alias("segments"), F.array().cast("array<string>").alias("template"), F.lit("").alias("node"), F.lit(2).cast("long").alias("mates"))
    level, done, shown = 0, [], ("host", "path", "b", "a", "template", "node")
    while True:
        tree = scratch.save(tree.withColumn("seg", F.get("segments", F.lit(level))), f"level-{level}")
        done.append(tree.where("seg IS NULL").select(*shown))
        # A path that is alone at its node stays so: all its further levels at once.
        rest = F.slice("segments", level + 1, F.size("segments"))
        alone = F.concat("template", F.transform(rest, lambda s: F.when(F.col("n") > 1, F.concat(F.lit("="), s)).otherwise(F.lit("*"))))
        ended = F.concat("node", F.repeat(F.lit("/0"), F.size("segments") - level))
        done.append(tree.where("seg IS NOT NULL AND mates = 1").withColumns({"template": alone, "node": ended}).select(*shown))
        tree = tree.where("seg IS NOT NULL AND mates > 1").drop("mates")
        if tree.isEmpty():
            break
        literal, every = branches(tree, scratch, level)
        tree = tree.join(sized(literal), ["host", "node", "seg"], "left")
        tree = tree.withColumn("grown", F.when(F.col("literal"), F.concat(F.lit("="), "seg")).otherwise(F.lit("*")))
        tree = tree.join(sized(every), ["host", "node", "grown"])
        tree = tree.select("host", "path", "b", "a", "n", "segments", F.concat("template", F.array("grown")).alias("template"), F.concat_ws("/", "node", "cluster").alias("node"), "mates")
        level += 1
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """All columns of ``pages``, and host, path, rule, verdict (allow or block), template (as text) and purity.

    Columns of ``pages`` with those names are replaced.
    """
    made = ["host", "path", "rule", "verdict", "template", "purity"]
    rows = pages.select(*[c for c in pages.columns if c not in made], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.col("_rule.verdict")
    paths = rows.groupBy("host", "path").agg(F.count_if(said == "block").alias("b"), F.count_if(said == "allow").alias("a"), F.count_if(said.isNull()).alias("u"))
    scratch = Scratch(pages.sparkSession, "urls")
    paths = scratch.save(paths, "paths")
    blocked, labelled = paths.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum(F.col("b") + F.col("a")), F.lit(0))).first()
    rate = blocked / labelled if labelled else 0.0
    tree = templates(paths, scratch)
    pure = tree.groupBy("host", "node").agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"))
    pure = scratch.save(pure.select("host", "node", "tb", ((F.col("tb") + PRIOR * rate) / (F.col("tb") + F.col("ta") + PRIOR)).alias("purity")), "pure")
    shown = F.concat(F.lit("/"), F.array_join(F.transform("template", lambda s: F.regexp_replace(s, "^=", "")), "/"))
    judged = tree.join(sized(pure), ["host", "node"]).select(F.col("host").alias("_host"), F.col("path").alias("_path"), shown.alias("template"), "purity", (F.col("tb") > 0).alias("_blocked"))
    out = rows.join(judged, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when((F.col("purity") > 0.5) & F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*rows.columns[:-1], F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
