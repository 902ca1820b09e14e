"""URL filtering by host and path rules, with link-graph propagation for urls that no rule fits.

Hosts with a page that an allow rule decides are trusted seeds; hosts with a page that a block rule decides are
blocked seeds.  Trust flows along host-to-host links as a personalised PageRank that restarts at the trusted
seeds; distrust flows along reversed links and restarts at the blocked seeds: who links to a blocked host is
suspect.  Both walks go on until no host is newly reached and no score changes any more.  A host is blocked when its
distrust, less its trust, is above a threshold.  Everything is DataFrame and SQL functions.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; a null
page has no links; repeated rows are kept, one result each; an empty table gives an empty result; extra columns of
the input are ignored; a very long page is read whole; a rule must fit by its path too, so an empty path fits no rule that names one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import cut

#: (verdict, rule): a rule is a host and a path. (fixed values)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
#: A walk ends when its last round changed every score by this share of it at most; looked at once in so many rounds.
TOLERANCE, ROUNDS_BETWEEN = 1e-11, 4
THRESHOLD = 0.0
#: Parts that the pages of one host are dealt to where they meet its scores.
SALTS = 16


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (struct of rule, verdict) that fits host and path, else null; a tie goes to the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(ordered):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, by_rule (allow, block or null) of every page."""
    cols = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hit = cols.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    return hit.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: how many absolute links lead from one host to another; links within a host do not count."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), 1)
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return links.select("src", _ascii_lower(F.col("dst")).alias("dst")).filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, score: personalised PageRank along src -> dst, restarting at seeds (host, weight; the weights sum to 1).

    Flow pre-aggregates per target before its shuffle, so a host that a third of all pages link to is a sum of
    partial sums.  Hosts that nothing reaches have no row.  Scores only grow, and a host reached for the first time
    counts as a change of its whole score, so a walk reaches all hosts, however long the way.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    step = cut(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")))
    base = seeds.select("host", (F.col("weight") * (1 - damping)).alias("score"), F.lit(0.0).alias("last"))
    score, change = base, 1.0
    while change > tolerance:
        for _ in range(ROUNDS_BETWEEN):
            flow = step.join(score.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"), F.lit(0.0).alias("last"))
            held = score.select("host", F.lit(0.0).alias("score"), F.col("score").alias("last"))
            score = base.unionByName(flow).unionByName(held).groupBy("host").agg(F.sum("score").alias("score"), F.sum("last").alias("last"))
        score = cut(score)
        change = score.filter("score > 0").agg(F.max(F.abs(1 - F.col("last") / F.col("score")))).first()[0] or 0.0  # one row
    return score.select("host", "score")


def host_scores(judged: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust of every host that a seed or a link reaches."""
    decided = judged.filter(F.col("by_rule").isNotNull() & (F.col("host") != "")).groupBy("host", "by_rule").agg(F.count("*").alias("pages"))
    decided = cut(decided)
    totals = decided.groupBy("by_rule").agg(F.sum("pages").alias("all_pages"))
    weighted = decided.join(F.broadcast(totals), "by_rule").select("host", "by_rule", (F.col("pages") / F.col("all_pages")).alias("weight"))
    trusted = weighted.filter("by_rule = 'allow'").select("host", "weight")
    blocked = weighted.filter("by_rule = 'block'").select("host", "weight")
    if edges.isEmpty():  # without links, all that is left is what restarts
        trust, distrust = (s.select("host", (F.col("weight") * (1 - damping)).alias("score")) for s in (trusted, blocked))
    else:
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
        trust, distrust = propagate(edges, trusted, damping, tolerance), propagate(turned, blocked, damping, tolerance)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, by_rule, trust, distrust of every page."""
    judged = judge_by_rules(pages, rules)
    scores = host_scores(judged, cut(host_edges(pages)), damping, tolerance)
    dealt = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    out = dealt.join(scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust - trust > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), F.col("by_rule").isNotNull().alias("ruled"), trust.alias("trust"), distrust.alias("distrust"))
