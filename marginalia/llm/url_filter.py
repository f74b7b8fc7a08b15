"""URL filtering by rules and by link-graph propagation, in DataFrame functions only.

Rules decide what they cover. Hosts that they mostly allow are trusted seeds, hosts that they
mostly block are blocked seeds. Trust spreads along links by personalised PageRank from the
trusted seeds; distrust spreads against them, from a blocked host to those that link to it,
each by the share of its own links.
A host whose distrust passes a threshold and its trust is blocked where no rule says more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import materialize

#: (verdict, host and path) of the rules that the contract fixes.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.05
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of links that name a host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``; both empty for null or without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        cut = text.index("/")
        own = F.lit(text[:cut])
        fits = ((host == own) | F.endswith(host, F.lit("." + text[:cut]))) & F.startswith(path, F.lit(text[cut:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Seed mass spread over ``edges (a, b, share)`` from ``seeds (host)`` to ``(host, rank)``, each seed's own being ``1 - damping``.

    In every round ``b`` gets ``damping * share`` of what ``a`` has. Ranks come in units of one
    seed, so a threshold means the same for few and many seeds.
    """
    edges = materialize(edges)
    start = seeds.select("host", F.lit(1 - damping).alias("rank"))
    rank = seeds.select("host", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        moved = rank.join(edges, rank.host == edges.a).groupBy(F.col("b").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
        rank = materialize(moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank")))
    return rank


def blocked_hosts(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Hosts that distrust reaches: ``hosts (host, n, allowed, blocked)`` with page counts, ``edges (a, b, w)``.

    Both spread by the share that a link has of all links of the host it stands on. Trust goes
    along it: personalised PageRank from the trusted hosts. Distrust goes against it: a linker
    gets the damped mean of the distrust of all it links to, which is the discounted chance that
    a reader who follows its links meets a blocked host. So what a host is blamed for follows from
    its own links, however many others link to the same blocked host. Trusted hosts take no
    distrust and so pass none on.
    """
    trusted = materialize(hosts.where("2 * allowed > n").select("host"))
    blocked = materialize(hosts.where("2 * blocked > n").select("host"))
    if edges.isEmpty():
        return blocked
    out = edges.groupBy("a").agg(F.sum("w").alias("total"))
    shares = materialize(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("share")))
    trust = propagate(shares, trusted, damping, rounds)
    blamed = shares.join(trusted, shares.a == trusted.host, "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"), "share")
    distrust = propagate(blamed, blocked, damping, rounds)
    both = distrust.join(trust.withColumnRenamed("rank", "trust"), "host", "left")
    return both.where((F.col("rank") >= threshold) & (F.col("rank") > F.coalesce("trust", F.lit(0.0)))).select("host")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS,
               threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per page.

    Links are those of ``html`` that name a host; links within a host do not count and links
    between two hosts are added up before they are shuffled. A page without a rule gets its
    host's verdict, which is ``allow`` where distrust does not reach. Null urls and those without ``://`` have an empty host and path, no rule and are allowed; their links count for
    nobody. Null or empty html has no links. Repeated pages are judged each and count each. An
    empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = seen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    hosts = materialize(judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    links = seen.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    target, _ = host_and_path(F.concat(F.lit("x:"), F.regexp_extract("link", r"(//(?s:.*))", 1)))
    edges = materialize(links.select(F.col("host").alias("a"), target.alias("b")).where("a <> b AND b <> ''")
                        .groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))
    bad = blocked_hosts(hosts, edges, damping, rounds, threshold).select("host", F.lit("block").alias("reached"))
    return judged.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "reached", F.lit("allow")).alias("verdict"))
