"""URL verdicts from rules, and from propagation over the link graph where no rule applies.

Hosts are nodes. Links between pages of different hosts are edges; hosts that link to the same path of their own
site are joined through that path, the more the fewer hosts link there, as mirrors and sites of one maker do.
Trust starts at hosts whose pages rules allow and flows along edges; distrust starts at hosts whose pages rules block
and flows against them, to those who link there: two personalised PageRanks. Each is put in proportion to the PageRank
that the same walk gives the host from uniform seeds, so a share says which part of a host's standing comes
from trusted (or blocked) seeds, whatever the size of the graph. Built-in functions and joins throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
PATH = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(/[^/"'\s>?#][^"'\s>?#]*)"""
DAMPING = 0.5
TOLERANCE = 1e-9
BLOCK_SHARE = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(source, target, weight)``: how many links lead from pages of one host to another host.

    Relative links stay on their host and carry nothing; edges are summed per task before they move.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(found).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    edges = links.select("source", target.alias("target")).filter("source <> '' and target <> '' and source <> target")
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def path_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(source, target, weight)`` between hosts and the paths (from ``/`` up to ``?`` or ``#``) that two hosts or more link to.

    Both ways, so a walk leads from a host over a path to the hosts that link to the same path; no pairs of hosts are
    made. A link weighs one in the number of hosts that link there. Paths start with a slash, so none is a host.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(PATH), F.lit(1))
    links = pages.select(host_of(F.col(url_col)).alias("host"), F.explode(found).alias("path")).filter("host <> ''")
    links = materialise(links.groupBy("host", "path").agg(F.count(F.lit(1)).alias("links")), "path-links")
    shared = links.groupBy("path").agg(F.count(F.lit(1)).alias("hosts")).filter("hosts > 1")
    weighed = links.join(shared, "path").select("host", "path", (F.col("links") / F.col("hosts")).alias("weight"))
    return weighed.select(F.col("host").alias("source"), F.col("path").alias("target"), "weight").unionByName(
        weighed.select(F.col("path").alias("source"), F.col("host").alias("target"), "weight")
    )


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, fitting)``: the rules of a host and its parent domains, longest first.

    A host meets the rule table once per parent domain, by an equality join. Of rules of one length the
    blocking one comes first.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = hosts.select("host", F.explode(parents).alias("domain"))
    whole = F.concat("rule_host", "rule_path")
    entry = F.struct((-F.length(whole)).alias("order"), (F.col("verdict") != "block").alias("mild"), whole.alias("rule"), "rule_path", "verdict")
    joined = spread.join(rules, spread.domain == rules.rule_host)
    return joined.groupBy("host").agg(F.sort_array(F.collect_set(entry)).alias("fitting"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust)``: the shares of a host's standing that come from either kind of seed.

    ``hosts`` has ``host, base, trusted, blocked``: ``base`` is 1 for a host and 0 for a node that only passes on, the seeds
    are from 0 to 1; every node of ``edges`` is in it. A round is a join of the edges with the ranks and a sum per node,
    forwards and backwards; rounds end when no rank moves by more than ``tolerance`` (all moves together shrink by
    ``damping`` a round). Each round is written to shared storage, the one before it goes.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("target").agg(F.sum("weight").alias("into"))
    shares = edges.join(out, "source").join(into, "target")
    restart = 1 - damping
    names = {"t": "trusted", "tb": "base", "d": "blocked", "db": "base"}
    with scratch() as scope:
        shares = materialise(shares.select("source", "target", (F.col("weight") / F.col("out")).alias("on"), (F.col("weight") / F.col("into")).alias("back")), "edges")
        ranks = materialise(hosts.select("host", "base", "trusted", "blocked", *[(restart * F.col(seed)).alias(n) for n, seed in names.items()]), "ranks")
        while True:
            on = shares.join(ranks, shares.source == ranks.host).groupBy(F.col("target").alias("host"))
            on = on.agg(F.sum(F.col("on") * F.col("t")).alias("t1"), F.sum(F.col("on") * F.col("tb")).alias("tb1"))
            back = shares.join(ranks, shares.target == ranks.host).groupBy(F.col("source").alias("host"))
            back = back.agg(F.sum(F.col("back") * F.col("d")).alias("d1"), F.sum(F.col("back") * F.col("db")).alias("db1"))
            new = {n: restart * F.col(seed) + damping * F.coalesce(f"{n}1", F.lit(0.0)) for n, seed in names.items()}
            moved = F.greatest(*[F.abs(value - F.col(n)) for n, value in new.items()])
            joined = ranks.join(on, "host", "left").join(back, "host", "left")
            step = joined.select("host", "base", "trusted", "blocked", *[value.alias(n) for n, value in new.items()], moved.alias("moved"))
            step = materialise(step, "ranks")
            scope.drop(ranks)
            ranks = step
            if step.filter(F.col("moved") > tolerance).isEmpty():
                break
        shown = ranks.filter("base > 0").select("host", (F.col("t") / F.col("tb")).alias("trust"), (F.col("d") / F.col("db")).alias("distrust"))
        return scope.keep(shown, "standing")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    block_share: float = BLOCK_SHARE,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    shared_paths: bool = True,
) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` per row of ``pages``.

    ``rules`` has ``rule_host, rule_path, verdict`` (``allow`` or ``block``). A rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins, and its verdict stands. Other URLs get their host's: ``block``
    if its distrust is at least ``block_share`` and above its trust, else ``allow``. Seeds are the shares
    of a host's pages that rules allow and block. Without ``shared_paths`` only links between hosts carry. Null URLs have
    an empty host and path and are allowed. Repeated rows count as pages of their own; an empty table gives an empty
    result; of equally long rules a blocking one stands.
    """
    where = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    edges = link_edges(pages, url_col, html_col).withColumn("weight", F.col("weight").cast("double"))
    if shared_paths:
        edges = edges.unionByName(path_edges(pages, url_col, html_col))
    edges = materialise(edges, "links")
    present = where.select("host").distinct()
    fitting = materialise(present.join(host_rules(present, rules), "host", "left"), "host-rules")
    chosen = F.get(F.filter("fitting", lambda r: F.startswith(F.col("path"), r.rule_path)), 0)
    ruled = where.join(fitting, "host").select("id", "host", "path", chosen.alias("chosen"))
    ruled = materialise(ruled.select("id", "host", "path", F.col("chosen.rule").alias("rule"), F.col("chosen.verdict").alias("ruled")), "ruled")
    share = lambda verdict: F.count_if(F.col("ruled") == verdict) / F.count(F.lit(1))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    known = edges.select(F.explode(F.array("source", "target")).alias("host")).distinct().join(seeds, "host", "full")
    base = F.when(F.startswith(F.col("host"), F.lit("/")), 0.0).otherwise(1.0).alias("base")
    known = known.select("host", base, F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked"))
    standing = propagate(known, edges, damping, tolerance)
    own = F.when((F.col("distrust") >= block_share) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    judged = ruled.join(standing, "host")
    return judged.select("id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
