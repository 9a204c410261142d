"""URL filter: path rules first, then trust and distrust propagated over the graph of links between hosts.

Rules (host, path) fit a host and its subdomains and every path that starts with theirs; the longest rule that fits decides.
Urls that no rule fits are judged by their host. A host is a trusted (blocked) seed if allow (block) rules fit more than half
of its pages. Trust is the personalised PageRank of the trusted seeds along links; distrust is that of the blocked seeds
against them, so that hosts which link to blocked ones get some. A host is blocked if its distrust exceeds both its trust and
``threshold`` times the mean of all hosts; a host that neither reaches is allowed.

Only DataFrame functions are used. Links are counted per pair of hosts before anything iterates; an iteration joins scores with
edges on the host and adds up partial sums, so a host with very many links is split over the tasks that hold its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import ascii_lower
from ebbtide.runtime import materialize

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DAMPING, EPSILON, THRESHOLD = 0.85, 1e-6, 0.5
"""``EPSILON``: rounds go on until none adds more to any host; a seed restarts with 1 - ``DAMPING``, so at most 75 rounds with one seed."""
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        inside = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(inside & path.startswith(f"/{rest}"), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host. Relative links stay on the host and are no edge."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("_to"))
    link = F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), "_to")).otherwise(F.col("_to"))
    pairs = found.select("src", host_of(link).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, links: DataFrame, seed: str, rounds: int | None, damping: float, epsilon: float = EPSILON) -> DataFrame:
    """(host, score): personalised PageRank from the hosts where ``seed`` is true, equal restart weight each.

    Starts from the restart share and sums the rounds until none adds more than ``epsilon`` to any host. ``rounds`` asks for so many
    rounds of power iteration from 1.0 a seed instead. ``links`` is (src, dst, n). Hosts without links out give nothing on: their mass ends there, which scales all scores alike.
    """
    # The share of a source is its links over all its links; the sums are exact whole numbers.
    share = links.join(links.groupBy("src").agg(F.sum("n").alias("_all")), "src").select(
        "src", "dst", (F.col("n") / F.col("_all")).alias("share"))
    share = materialize(share)
    start = materialize(hosts.where(seed).select("host", F.lit(1.0).alias("restart")))
    if rounds is None:
        begun = F.col("restart") * (1 - damping)
        scores = start.select("host", begun.alias("score"), begun.alias("step"))
        while True:
            more = F.col("step") * F.col("share") * damping
            sent = scores.join(share, scores.host == share.src).select(F.col("dst").alias("host"), more.alias("score"), more.alias("step"))
            had = scores.select("host", "score", F.lit(0.0).alias("step"))
            scores = materialize(sent.unionByName(had).groupBy("host").agg(F.sum("score").alias("score"), F.sum("step").alias("step")))
            if (scores.agg(F.max("step")).first()[0] or 0.0) <= epsilon:
                return scores.select("host", "score")
    scores = start.select("host", F.col("restart").alias("score"))
    for _ in range(rounds):
        sent = scores.join(share, scores.host == share.src).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        back = start.select("host", (F.col("restart") * (1 - damping)).alias("score"))
        # Each round is written: the plan stays short, and a lost executor costs one round at most.
        scores = materialize(sent.unionByName(back).groupBy("host").agg(F.sum("score").alias("score")))
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: a row per row of ``pages``, repeated rows included.

    Null urls and urls without ``://`` have an empty host and path; no rule fits them, and they are allowed. Null html has no
    links. Columns of ``pages`` other than page_id, url and html are not read.
    """
    fit = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = fit.withColumn("_fit", rule_for(F.col("host"), F.col("path"), rules))
    hosts = fit.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("_fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("_fit.verdict") == "block").alias("blocked"))
    hosts = materialize(hosts.select("host", (F.col("allowed") * 2 > F.col("pages")).alias("trusted"), (F.col("blocked") * 2 > F.col("pages")).alias("banned")))
    links = materialize(host_links(pages))
    trust = spread(hosts, links, "trusted", rounds, damping).withColumnRenamed("score", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(hosts, back, "banned", rounds, damping).withColumnRenamed("score", "distrust")
    scored = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    mean = scored.agg((F.sum("distrust") / F.count("*")).alias("_mean"))  # one row
    bad = F.col("distrust") > F.greatest(F.col("trust"), F.lit(threshold) * F.coalesce("_mean", F.lit(0.0)))
    scored = materialize(scored.crossJoin(F.broadcast(mean)).select("host", "trust", "distrust", bad.alias("_bad")))
    verdict = F.coalesce("_fit.verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    return fit.join(scored, "host", "left").select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
