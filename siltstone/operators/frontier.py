"""Frontier: gates, link-graph walk, budget, response routing, redirects, request slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import http as H
from ..functions import urls as U
from ..session import materialise
from .ranks import first_by, ordinals


def in_scope(url: Column | str, config: CrawlConfig) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return U.in_domains(url, config.allowed_domains) & U.matches_scope(
        url, config.include_patterns, config.exclude_patterns
    )


def gate(candidates: DataFrame, config: CrawlConfig) -> DataFrame:
    """Decide every candidate occurrence (``raw_url, depth, ...``): add ``url`` and ``decision``.

    The cheap checks come first and none of them shuffles. ``decision`` is ``candidate`` for
    links that pass; silent rejections are ``not_crawlable``, ``too_deep``, ``out_of_domain``.
    """
    url = F.col("url")
    decision = (
        F.when(url.isNull(), "not_crawlable")
        .when(F.col("depth") > config.max_depth, "too_deep")
        .when(U.is_media(url, config.skip_extensions), "skipped_media")
        .when(~U.in_domains(url, config.allowed_domains), "out_of_domain")
        .when(~U.matches_scope(url, config.include_patterns, config.exclude_patterns), "skipped_scope")
        .otherwise("candidate")
    )
    return candidates.withColumn("url", U.canonical_url("raw_url")).withColumn("decision", decision)


def enqueue(gated: DataFrame, seen: DataFrame | None) -> DataFrame:
    """New frontier rows: one per URL (earliest depth, then origin order), minus those seen."""
    fresh = gated.filter(F.col("decision") == "candidate")
    if seen is not None:
        fresh = fresh.join(seen.select("url"), "url", "left_anti")
    return first_by(fresh, ["url"], ["depth", "seq"], ["lastmod", "is_asset"])


def walk_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Smallest link depth of every node reachable within ``max_depth`` (``src, dst`` edges).

    The distinct edges are written once. One round per depth, each written to shared storage, so
    lineage stays flat: it joins the new level (distinct nodes) with the edges and drops visited nodes.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    level = materialise(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    visited = level
    for depth in range(1, max_depth + 1):
        reached = (
            edges.join(level.select(F.col("node").alias("src")), "src")
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(visited.select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        level = materialise(reached, "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def within_budget(frontier: DataFrame, max_pages: int | None) -> DataFrame:
    """First ``max_pages`` frontier rows by depth, then by a hash order of the URL.

    The hash order spreads a budget over hosts and lets the cut be found from bucket
    counts instead of sorting the frontier into one task.
    """
    if max_pages is None:
        return frontier
    return ordinals(frontier, [], ["depth"], "url").filter(F.col("ordinal") <= max_pages).drop("ordinal")


def route(
    status: Column | str, content_type: Column | str, url: Column | str, is_asset: Column | str, config: CrawlConfig
) -> Column:
    """What happens to a response: redirect, 304, error, asset, unsupported media or HTML."""
    status, content_type, is_asset = (F.col(c) if isinstance(c, str) else c for c in (status, content_type, is_asset))
    as_asset = is_asset | ~U.is_html_type(content_type)
    return (
        F.when(status.isin(H.REDIRECT_STATUS), "redirect_not_followed")
        .when(status == 304, "unchanged_304")
        .when(status >= 400, "http_error")
        .when(as_asset & F.lit(not config.fetch_assets), "asset_ignored")
        .when(as_asset & ~U.is_document_type(content_type, url, config.asset_extensions), "unsupported_media")
        .when(as_asset, "asset")
        .otherwise("html")
    )


def needs_render(url: Column | str, word_count: Column | str, config: CrawlConfig) -> Column:
    if config.render_js == "off":
        return F.lit(False)
    if config.render_js == "always":
        return F.lit(True)
    words = F.col(word_count) if isinstance(word_count, str) else word_count
    return U.in_domains(url, config.render_hosts) | (words < config.render_min_words)


def follow_redirects(
    requests: DataFrame, hops: DataFrame, allowed: Column | None = None, max_redirects: int = 5
) -> DataFrame:
    """Final URL and status of each request over a table of observed responses.

    ``hops`` has one row per URL: ``url, status, location``. A hop is followed while the status
    redirects, the target is valid, differs from the current URL and passes ``allowed`` (a
    condition on column ``target``). The loop unrolls into a fixed number of joins.
    """
    target = U.canonical_url(U.resolve_url("location", "url"))
    known = hops.select(F.col("url").alias("current"), F.col("status").alias("_status"), target.alias("target"))
    # Merged, not sent: every step would hold its own copy of the table in each task.
    known = known.hint("merge")
    follow = F.col("_status").isin(H.REDIRECT_STATUS) & F.col("target").isNotNull() & (F.col("target") != F.col("current"))
    if allowed is not None:
        follow = follow & allowed
    state = requests.select("url", F.col("url").alias("current"), F.lit(None).cast("int").alias("status"),
                            F.lit(0).alias("hops"), F.lit(False).alias("done"))
    for step in range(max_redirects + 1):
        going = F.coalesce(follow, F.lit(False)) & ~F.col("done")
        last = step == max_redirects
        state = state.join(known, "current", "left").select(
            "url",
            F.when(going & F.lit(not last), F.col("target")).otherwise(F.col("current")).alias("current"),
            F.when(F.col("done"), F.col("status")).otherwise(F.col("_status")).alias("status"),
            F.when(going & F.lit(not last), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
            (F.col("done") | ~going).alias("done"),
        )
    return state.select("url", F.col("current").alias("final_url"), "status", F.col("hops").cast("int").alias("hops"))


def request_slots(frontier: DataFrame, delays: DataFrame, default_delay: float) -> DataFrame:
    """Start offset in seconds of every request so that no host is asked too often.

    ``delays`` holds ``host, crawl_delay``; the longer of it and the default applies. Slots make
    the rate limit independent of task placement: a host's requests may run in many tasks.
    """
    hosted = frontier.withColumn("host", U.url_host("url"))
    delay = F.greatest(F.coalesce("crawl_delay", F.lit(0.0)), F.lit(float(default_delay)))
    placed = ordinals(hosted, ["host"], ["depth"], "url", name="slot")
    return (
        placed.join(delays.select("host", "crawl_delay"), "host", "left")
        .withColumn("delay", delay)
        .withColumn("start_at", (F.col("slot") - 1) * F.col("delay"))
        .drop("crawl_delay")
    )
