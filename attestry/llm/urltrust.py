"""Operator 10: URL verdicts by rules and link-graph propagation.

Rules decide where one fits.  For all other pages trust flows from hosts with allowed pages along links, and
distrust from hosts with blocked pages against the links, as two personalised PageRanks over host edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.store import discard, settle

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Rounds before it is first asked whether the ranks have settled.
ROUNDS = 12
#: Ranks have settled when a round changes no host's trust or distrust by more than this share of it; a host just reached changes by all of it.
SETTLED = 1e-7
#: Changes under this are below what doubles can tell.
TINY = 1e-300
#: A host is blocked where its distrust exceeds its trust by more than this share of their sum; less is rounding.
MARGIN = 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    behind = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.locate("/", behind)
    return F.when(slash > 0, F.substr(behind, slash)).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits the host or a parent of it, and the path's beginning."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, where, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(begin)
        rule = F.when(fits, F.lit(where + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted; ``pages`` has host and html."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(found).alias("url"))
    absolute = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    links = links.select("src", host_of(F.regexp_replace(absolute, "&amp;", "&")).alias("dst")).where("dst != '' and src != dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    ``seeds`` has host, trust, distrust (shares that sum to one); ``links`` has src, dst, n.  A host passes on its
    rank in proportion to n, trust along the links and distrust against them; a host without links keeps nothing.
    Rounds follow each other, ``rounds`` at least, until no host's rank moves, however many hops it is from a seed.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    back = links.groupBy("dst").agg(F.sum("n").alias("total"))
    flow = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("forth"), F.lit(0.0).alias("back"))
    flow = flow.unionByName(links.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("forth"), (F.col("n") / F.col("total")).alias("back")))
    flow = settle(flow)
    rank, step = seeds, 0
    if flow.isEmpty():
        return rank
    zero = F.lit(0.0)
    home = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"), zero.alias("trust_before"), zero.alias("distrust_before"))

    def moves(name: str) -> Column:
        return F.abs(F.col(name) - F.col(f"{name}_before")) > F.greatest(F.col(name) * SETTLED, F.lit(TINY))

    while True:
        step, last = step + 1, rank
        sent = flow.join(last, "host").groupBy(F.col("to").alias("host")).agg(
            (F.sum(F.col("trust") * F.col("forth")) * damping).alias("trust"), (F.sum(F.col("distrust") * F.col("back")) * damping).alias("distrust"))
        sent = sent.withColumns({"trust_before": zero, "distrust_before": zero}).unionByName(home)
        sent = sent.unionByName(last.select("host", zero.alias("trust"), zero.alias("distrust"), F.col("trust").alias("trust_before"), F.col("distrust").alias("distrust_before")))
        rank = settle(sent.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "trust_before", "distrust_before")]))
        if step > 1:
            discard(last)
        if step >= rounds and rank.where(moves("trust") | moves("distrust")).isEmpty():
            return rank.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row for each row of ``pages`` (page_id, url, html).

    A null url or one without ``://`` has an empty host and path and is allowed, as is a host that neither trust nor
    distrust reaches; a null html has no links.  Repeated rows count and come back as often as they came; an empty
    table gives an empty result.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("rule", rule).withColumn("said", said)
    count = ruled.where("host != '' and said is not null").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    count = settle(count)
    good, bad = count.agg(F.sum("good"), F.sum("bad")).first()
    seeds = count.select("host", (F.col("good") / F.lit(float(good or 1))).alias("trust"), (F.col("bad") / F.lit(float(bad or 1))).alias("distrust"))
    rank = propagate(seeds, settle(host_links(pages)), rounds, damping)
    out = ruled.drop("html").join(rank, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust - trust > (distrust + trust) * MARGIN, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
