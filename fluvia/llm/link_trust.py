"""URL verdicts by path rules and by trust and distrust that travel over links between hosts.

Personalised PageRank starts at the share of a host's pages that rules allow and follows links; distrust starts at the
share that rules block and follows links backwards, as hosts that link to blocked ones earn distrust. PageRank is
linear in its start, so each host's rank from those seeds is divided by its rank from all hosts alike: the share of
its standing that it owes to trusted, or to blocked, hosts. A host without links keeps its own share. Hosts whose
distrust reaches the threshold and exceeds their trust are blocked.

Only DataFrame functions are used. Everything after link extraction is a table of host pairs or of hosts.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Host, path and verdict of each rule.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path together; of equally long ones the first blocking one) that fits, and its
    verdict; both null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    rule = verdict = F.lit(None).cast("string")
    for name, start, what in reversed(order):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct ``(src, dst)`` of different hosts: absolute and scheme-relative links of whole pages."""
    found = pages.select(url_host(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = found.select("src", url_host(target).alias("dst"))
    return pairs.filter("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(
    hosts: DataFrame, links: DataFrame, tables: Tables, damping: float = 0.85, tolerance: float = 1e-4, most_steps: int | None = None
) -> DataFrame:
    """``hosts(host, trust, distrust)`` with start shares and ``links(src, dst)`` -> ``host, trust, distrust`` after
    propagation, as shares of each host's standing.

    A host without a link to follow keeps what reaches it. Steps end when no rank moves by ``tolerance`` times its
    uniform part. A step leaves at most ``damping`` of what still moved, so by default as many steps are allowed as that
    needs; with fewer, given as ``most_steps``, a warning tells that ranks still move. No hosts and no links give no rows.
    """
    most_steps = most_steps or 2 + math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping))
    nodes = hosts.select("host", "trust", "distrust").unionByName(
        links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    )
    nodes = nodes.groupBy("host").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust"))
    seeds = tables.write(
        nodes.select(
            "host",
            F.explode(
                F.array(
                    F.struct(F.lit(True).alias("forward"), F.col("trust").alias("seed")),
                    F.struct(F.lit(False).alias("forward"), F.col("distrust").alias("seed")),
                )
            ).alias("s"),
        ).select("s.forward", "host", "s.seed")
    )
    both = links.select(F.lit(True).alias("forward"), F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(
        links.select(F.lit(False).alias("forward"), F.col("dst").alias("host"), F.col("src").alias("to"))
    )
    degree = both.groupBy("forward", "host").agg(F.count("*").alias("degree"))
    edges = both.join(degree, ["forward", "host"]).select("forward", "host", "to", (1 / F.col("degree")).alias("part"))
    stuck = seeds.join(degree, ["forward", "host"], "left_anti")
    edges = tables.write(
        edges.unionByName(stuck.select("forward", "host", F.col("host").alias("to"), F.lit(1.0).alias("part")))
    )
    now = tables.write(seeds.select("forward", "host", "seed", F.col("seed").alias("rank"), F.lit(1.0).alias("whole")))
    for _ in range(most_steps):
        sent = (
            edges.join(now.select("forward", "host", "rank", "whole"), ["forward", "host"])
            .groupBy("forward", F.col("to").alias("host"))
            .agg(F.sum(F.col("part") * F.col("rank")).alias("rank_in"), F.sum(F.col("part") * F.col("whole")).alias("whole_in"))
        )
        moved = now.join(sent, ["forward", "host"], "left").select(
            "forward",
            "host",
            "seed",
            (F.lit(1 - damping) * F.col("seed") + damping * F.coalesce("rank_in", F.lit(0.0))).alias("rank"),
            (F.lit(1 - damping) + damping * F.coalesce("whole_in", F.lit(0.0))).alias("whole"),
            F.col("rank").alias("rank_was"),
            F.col("whole").alias("whole_was"),
        )
        step = tables.write(moved)
        change = step.agg(F.max(F.greatest(F.abs(F.expr("rank - rank_was")), F.abs(F.expr("whole - whole_was"))) / F.lit(1 - damping))).first()[0]
        tables.drop(now)
        now = step
        if not change or change < tolerance:
            break
    else:
        warnings.warn(f"ranks still move after {most_steps} steps", stacklevel=2)
    share = F.col("rank") / F.col("whole")
    return now.groupBy("host").agg(
        F.max(F.when(F.col("forward"), share)).alias("trust"), F.max(F.when(~F.col("forward"), share)).alias("distrust")
    )


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    block_at: float = 0.4,
    name: str = "link-trust",
) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, trust, distrust``.

    The longest fitting rule decides; elsewhere a page is blocked if its host's distrust is at least ``block_at`` and
    more than its trust. Pages without a host (null url, no ``://``) are allowed. Null html has no links. Repeated
    rows stay rows and count as pages; other columns are not read. An empty table gives no rows. Long pages are read by
    one pattern for links, whole.
    """
    tables = Tables(pages.sparkSession, name)
    host, path = url_host(F.col("_url")), url_path(F.col("_url"))
    own = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = own.select("_id", host.alias("host"), path.alias("path")).select("_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seen = judged.filter("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("by_rule", F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce("by_rule", F.lit("")) == "block").cast("double")).alias("distrust"),
    )
    links = tables.write(host_links(own, "_url", "_html"))
    ranked = tables.write(propagate(tables.write(seen), links, tables))
    found = judged.join(ranked, "host", "left")
    bad = (F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust"))
    own_verdict = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return found.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", own_verdict).alias("verdict"), "trust", "distrust"
    )
