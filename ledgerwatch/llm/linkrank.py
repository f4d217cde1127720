"""URL verdicts by rules and by trust and distrust that spread over links between hosts.

Trust is personalised PageRank from trusted hosts along links; distrust is that from blocked
hosts against them, for a host that links to bad ones is suspect. PageRank thins out with the
number of hosts round a seed, so each is held against the ordinary PageRank on the same graph:
a host's trust or distrust is the share of all score it receives that came from seeds. Only
DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
# Steps end when what a host receives grows by no more than this part of itself, for any host.
CLOSE = 1e-3
# A host is a seed if rules block (or allow) more than half of its pages.
SEED_SHARE = 0.5
# A host is blocked if its distrust is at least this and exceeds its trust.
LEAST_DISTRUST = 0.25


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a
    path that starts with its path. Of rules of equal length the first by text wins. The list
    is a parameter; it is not meant for long tables."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = (F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)
        fits &= F.col(path).startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of one host that link to another, from absolute links."""
    link = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""
    found = F.array_distinct(
        F.transform(
            F.regexp_extract_all("html", F.lit(link), 1), lambda x: host_of(F.concat(F.lit(":"), x))
        )
    )
    # "//host" and "scheme://host" alike: what follows the first "://" of ":" + link.
    links = pages.where("html is not null and host <> ''").select(
        F.col("host").alias("src"), F.explode(found).alias("dst")
    )
    links = links.where("dst <> '' and dst <> src")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, received) by personalised PageRank for every kind of ``seeds(kind, host)``
    over ``links(kind, src, dst, n)``: a host has 1 if it is a seed, plus what it receives,
    DAMPING of what other hosts deal out over their links. Scores are not scaled to a sum, so
    those of a larger seed set are at least as large everywhere; what reaches hosts without
    links ends there.

    Each step adds what walks one link longer bring: one join and one sum, written to the
    shared folder. Only the largest growth comes to the driver. The growth falls by DAMPING a
    step at least, so the steps end.
    """
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    flow = links.join(out, ["kind", "src"]).select(
        "kind", "src", F.col("dst").alias("host"), (DAMPING * F.col("n") / F.col("all")).alias("share")
    )
    flow = written(flow, "flow")
    one, none = F.lit(1.0), F.lit(0.0)
    scores = seeds.distinct().withColumns({"received": none, "new": one})
    scores = written(scores, "seeds")
    while True:
        came = (
            scores.where("new > 0")
            .select("kind", F.col("host").alias("src"), "new")
            .join(flow, ["kind", "src"])
            .groupBy("kind", "host")
            .agg(F.sum(F.col("new") * F.col("share")).alias("came"))
        )
        new, before = F.coalesce("came", none), F.coalesce("received", none)
        after = scores.drop("new").join(came, ["kind", "host"], "full").select(
            "kind", "host", (before + new).alias("received"), new.alias("new")
        )
        scores = written(after, "scores")
        growth = scores.where("new > 0").agg(F.max(F.col("new") / F.col("received"))).first()[0]
        if (growth or 0.0) <= CLOSE:
            return scores.drop("new")


def relative(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, share) for every host that score from seeds of a kind reaches: the part
    of all score the host receives that is theirs, 1 for the seeds themselves.

    Links into seeds are left out of both
    walks: what is known needs no evidence, and a blocked host cannot hide behind the links
    it sets itself.
    """
    onto = seeds.select("kind", F.col("host").alias("dst"))
    links = written(links.join(onto, ["kind", "dst"], "left_anti"), "open_links")
    ends = links.select("kind", F.col("src").alias("host")).union(links.select("kind", "dst"))
    every = ends.union(seeds).select(F.concat("kind", F.lit(" all")).alias("kind"), "host")
    both = links.union(links.withColumn("kind", F.concat("kind", F.lit(" all"))))
    scores = spread(both, seeds.union(every))
    ordinary = scores.where(F.col("kind").endswith(" all")).select(
        F.regexp_replace("kind", " all$", "").alias("kind"),
        "host",
        F.col("received").alias("all"),
    )
    own = scores.where(~F.col("kind").endswith(" all")).join(ordinary, ["kind", "host"])
    known = seeds.distinct().withColumn("seed", F.lit(True))
    share = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("received") / F.col("all"))
    return own.join(known, ["kind", "host"], "left").select(
        "kind", "host", F.least(share, F.lit(1.0)).alias("share")
    )


def judge_pages(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of
    ``pages(page_id, url, html)``.

    The rule's verdict holds where one fits; else the host is blocked if its distrust is
    LEAST_DISTRUST or more and exceeds its trust, both as shares of the score it receives
    (``relative``). A page without host, or of a host that neither has reached, is allowed. Null urls and urls
    without ``://`` have no host and no path. Null and empty html has no links. Repeated rows
    are judged alike; further columns are ignored. An empty table gives an empty result.
    """
    ready(pages.sparkSession)
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = pages.withColumn("found", longest_rule(rules))
    links = written(host_links(ruled), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    known = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("found.verdict") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("found.verdict") == "block", 1)).alias("blocked"),
    )
    known = written(known, "hosts")
    seeds = known.where(F.col("allowed") > SEED_SHARE * F.col("n")).select(
        F.lit("trust").alias("kind"), "host"
    )
    seeds = seeds.union(
        known.where(F.col("blocked") > SEED_SHARE * F.col("n")).select(F.lit("distrust"), "host")
    )
    scores = relative(both, written(seeds, "seeds"))
    hosts = scores.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("share"))), F.lit(0.0)).alias(
            "trust"
        ),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("share"))), F.lit(0.0)).alias(
            "distrust"
        ),
    )
    judged = ruled.select("page_id", "host", "path", "found").join(hosts, "host", "left")
    bad = (F.col("distrust") >= LEAST_DISTRUST) & (F.col("distrust") > F.col("trust"))
    spread_verdict = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), spread_verdict).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
