"""The crawl: one DataFrame round per link depth, with state, documents and a decision log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import html as H
from ..functions import http as X
from ..functions import urls as U
from ..operators import documents as D
from ..operators import frontier as FR
from ..operators import sitemaps as SM
from ..operators import state as S
from ..schemas import STATE
from ..session import materialise
from ..sources import jsonl, tables
from ..sources.fetch import Fetch, is_redirect



@dataclass
class CrawlResult:
    documents: DataFrame | None
    decisions: DataFrame
    state: DataFrame
    stats: DataFrame


def _header(name: str) -> Column:
    """A response header; fetchers give their names in lower case."""
    return F.try_element_at("headers", F.lit(name.lower()))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Crawl:
    """Runs a crawl over any fetcher (HTTP, a table of pages, a test double)."""

    def __init__(
        self, spark: SparkSession, config: CrawlConfig, fetch: Fetch, run_id: str, now: str,
        render: Callable[[Column], Column] | None = None, pdf_text: Callable[[Column], Column] | None = None,
    ) -> None:
        self.spark, self.config, self.fetch = spark, config, fetch
        self.run_id, self.now, self.render, self.pdf_text = run_id, now, render, pdf_text
        self.robots: DataFrame | None = None

    # ---------------------------------------------------------------- fetching

    def _requests(self, urls: DataFrame) -> DataFrame:
        for name, kind in (("etag", "string"), ("last_modified", "string"), ("start_at", "double"), ("delay", "double")):
            if name not in urls.columns:
                blank = {"start_at": 0.0, "delay": self.config.request_delay}.get(name)
                urls = urls.withColumn(name, F.lit(blank).cast(kind))
        return urls.select("url", "etag", "last_modified", "start_at", "delay")

    def _learn_robots(self, urls: DataFrame) -> DataFrame:
        """robots.txt per host (``host, robots_txt, robots_status``), each host fetched once."""
        hosts = urls.groupBy(U.url_host("url").alias("host")).agg(F.min(U.url_origin("url")).alias("origin"))
        if self.robots is not None:
            hosts = hosts.join(self.robots.select("host"), "host", "left_anti")
        wanted = materialise(hosts.withColumn("url", F.concat("origin", F.lit("/robots.txt"))), "hosts")
        replies = self._respond(wanted, rules=False).drop("url").withColumnRenamed("requested_url", "url")
        fresh = wanted.select("host", "url").join(replies, "url", "left").select(
            "host", X.decode_body("content", X.charset_of(_header("Content-Type"), "content")).alias("robots_txt"),
            F.col("status").alias("robots_status"),
        )
        known = fresh if self.robots is None else self.robots.unionByName(fresh)
        self.robots = materialise(known, "robots")
        return self.robots

    def _with_robots(self, rows: DataFrame) -> DataFrame:
        robots = self._learn_robots(rows)
        allowed = X.robots_allows(self.config.user_agent)("robots_txt", "robots_status", "url") if self.config.obey_robots else F.lit(True)
        joined = rows.withColumn("host", U.url_host("url")).join(robots, "host", "left")
        return joined.withColumn("allowed", allowed).drop("host", "robots_txt", "robots_status")

    def _respond(self, rows: DataFrame, rules: bool = True) -> DataFrame:
        """Final response of every request; redirects are followed in rounds of one hop.

        ``rules`` holds hops to the crawl's scope and robots.txt; requests for robots.txt and sitemaps
        themselves follow any redirect. ``redirects_left`` is false where the hops were used up.
        """
        current = materialise(
            self.fetch(self._requests(rows)).withColumn("requested_url", F.col("url")), "responses"
        )
        done = []
        target = F.when(is_redirect(), U.canonical_url(_header("Location"), "url"))
        follow = F.col("target").isNotNull() & (F.col("target") != F.col("url"))
        if rules:
            follow = follow & FR.in_scope("target", self.config)
        for _ in range(self.config.max_redirects):
            hops = current.withColumn("target", target).filter(follow)
            hops = hops.select("requested_url", F.col("url").alias("source"), F.col("target").alias("url"))
            if hops.isEmpty():
                break
            go = materialise(self._with_robots(hops) if rules else hops.withColumn("allowed", F.lit(True)), "hops").filter("allowed")
            replies = self.fetch(self._requests(go.select("url").distinct()))
            moved = materialise(go.select("requested_url", "url").join(replies, "url"), "responses")
            done.append(current.join(go.select("requested_url"), "requested_url", "left_anti").withColumn("redirects_left", F.lit(True)))
            current = moved
        used_up = F.coalesce(follow, F.lit(False)) if self.config.max_redirects > 0 else F.lit(False)
        last = current.withColumn("target", target).withColumn("redirects_left", ~used_up).drop("target")
        return _union([*done, last])

    # ---------------------------------------------------------------- seeding

    def _seed(self) -> DataFrame:
        c, spark = self.config, self.spark
        starts = spark.createDataFrame([(u,) for u in c.seeds or c.sitemaps[:1]], "url string")
        roots = spark.createDataFrame([(u,) for u in c.sitemaps], "url string")
        declared = self._learn_robots(starts).select(F.explode(X.robots_sitemaps("robots_txt")).alias("url"))
        level = materialise(roots.unionByName(declared).distinct(), "sitemap-roots")
        roots, files, seen = level, [], level
        while not level.isEmpty():
            found = self._respond(level, rules=False).filter("status < 300")
            files.append(materialise(found.select(F.col("requested_url").alias("url"), "content"), "sitemap-files"))
            children = SM.parse_sitemaps(files[-1]).filter("kind = 'sitemap'").select("url").distinct()
            level = materialise(children.join(seen, "url", "left_anti"), "sitemap-level")
            seen = seen.unionByName(level)
        entries = [starts.select(F.col("url").alias("raw_url"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("lastmod"))] if c.seeds else []
        if files:
            found = SM.discover(_union(files), roots)
            entries.append(found.select(F.col("url").alias("raw_url"), F.lit(0).alias("seq"), "lastmod"))
        return _union(entries).withColumns({"depth": F.lit(0), "is_asset": F.lit(False)})

    # ---------------------------------------------------------------- levels

    def _level(self, frontier: DataFrame, state: DataFrame, earlier: list[DataFrame]):
        """Fetch and process one frontier: log, documents, state updates, links for the next."""
        c = self.config
        joined = frontier.join(state.select("url", "etag", "last_modified", F.col("content_hash").alias("stored_hash")), "url", "left")
        log = [frontier.filter("NOT allowed").select("url", F.lit("skipped_robots").alias("decision"))]
        delays = self.robots.select(
            "host", X.robots_crawl_delay(c.user_agent)("robots_txt", "robots_status").alias("crawl_delay")
        )
        asked = FR.request_slots(joined.filter("allowed"), delays, c.request_delay)
        replies = self._respond(asked)
        rows = asked.withColumnRenamed("url", "requested_url").join(replies, "requested_url")
        content_type = X.media_type(_header("Content-Type"))
        rows = materialise(
            rows.withColumn("content_type", content_type).withColumn(
                "decision", F.when(F.col("error").isNotNull() | F.col("status").isNull(), "network_error")
                .when(is_redirect() & ~F.col("redirects_left"), "redirect_limit")
                .otherwise(FR.route("status", "content_type", "requested_url", "is_asset", c))
            ).withColumn("decision", F.when((F.col("decision") == "asset") & F.col("truncated"), "truncated_asset").otherwise(F.col("decision"))),
            "routed",
        )
        final = rows.filter(~F.col("decision").isin("html", "asset"))
        log.append(final.select(F.col("requested_url").alias("url"), "decision"))
        log.append(rows.filter("truncated AND decision = 'html'").select(F.col("requested_url").alias("url"), F.lit("truncated").alias("decision")))

        parsed = materialise(self._extract(rows.filter("decision = 'html'")), "extracted")
        broken = parsed.filter("parse_error IS NOT NULL").withColumn("decision", F.lit("processing_error"))
        log.append(broken.select(F.col("requested_url").alias("url"), "decision"))
        final = _union([final.select("requested_url", "status", "decision"), broken.select("requested_url", "status", "decision")])
        pages = parsed.filter("parse_error IS NULL")
        noindex = F.col("noindex") | F.contains(F.lower(F.coalesce(_header("X-Robots-Tag"), F.lit(""))), F.lit("noindex"))
        pages = pages.withColumn("skip", noindex & F.lit(c.obey_noindex)).withColumn("content_hash", S.content_hash("text"))
        pages = materialise(pages, "pages")
        log.append(pages.filter("js_rendered").select(F.col("requested_url").alias("url"), F.lit("rendered").alias("decision")))

        slim = pages.filter("NOT skip").select(F.col("requested_url").alias("url"), "content_hash", "stored_hash")
        # Only rows that actually claim a hash take part: an unchanged page is never a duplicate.
        fresh = slim.filter(~F.col("stored_hash").eqNullSafe(F.col("content_hash")))
        known = _union([state.select("url", "content_hash"), *[u.filter("content_hash IS NOT NULL").select("url", "content_hash") for u in earlier]])
        marked = S.mark_duplicates(fresh.drop("stored_hash"), ["url"], known if c.incremental or earlier else None)
        verdict = marked.select(F.col("url").alias("requested_url"), "is_duplicate")
        judged = pages.join(verdict, "requested_url", "left").withColumn(
            "decision",
            F.when(F.col("skip"), "noindex").when(F.col("is_duplicate").isNull(), "unchanged_hash")
            .when(F.col("is_duplicate"), "duplicate_content").otherwise("indexed"),
        )
        judged = materialise(judged, "judged")
        log.append(judged.select(F.col("requested_url").alias("url"), "decision"))

        text = D.asset_text("content", "content_type", "requested_url", self.pdf_text(F.col("content")) if self.pdf_text else None)
        assets = rows.filter("decision = 'asset'").withColumn("text", text)
        log.append(assets.select(F.col("requested_url").alias("url"), "decision"))
        common = {"sitemap_lastmod": F.col("lastmod"), "http_status": F.col("status"), "crawled_at": F.lit(self.now)}
        saved = f"{c.output_dir}/assets" if c.save_assets else None
        page_docs = D.page_documents(judged.filter("decision = 'indexed'").withColumns(common))
        asset_docs = D.asset_documents(assets.withColumns(common), saved)
        if saved:
            jsonl.save_assets(assets.select(U.asset_file_name("url").alias("name"), "content"), saved)
        docs = materialise(page_docs.unionByName(asset_docs), "documents")

        links = []
        if c.follow_links:
            sources = pages.filter("NOT skip AND NOT nofollow")
            links.append(sources.select(F.explode("links").alias("raw_url"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("is_asset")))
            if c.fetch_assets:
                links.append(sources.select(F.explode("assets").alias("raw_url"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("is_asset")))
        updates = materialise(self._updates(final, judged, docs, rows), "updates")
        found = _union(links).withColumns({"seq": F.lit(2), "lastmod": F.lit(None).cast("string")}) if links else None
        return log, docs, updates, found

    def _extract(self, rows: DataFrame) -> DataFrame:
        """Parse HTML; thin pages go through the renderer and are parsed again."""
        c = self.config
        charset = F.coalesce("encoding", X.charset_of(_header("Content-Type"), "content"))
        base = rows.withColumn("html", X.decode_body("content", charset)).drop("content")

        def parse(df: DataFrame, rendered: bool) -> DataFrame:
            parsed = df.withColumn("_p", H.parsed_page("html"))
            fields = H.page_columns(F.col("_p"), F.col("url"), c.asset_extensions)
            keep = [x for x in df.columns if x not in fields]
            return parsed.select(*keep, *[v.alias(k) for k, v in fields.items()]).withColumn("js_rendered", F.lit(rendered))

        first = parse(base, False)
        if self.render is None or c.render_js == "off":
            return first.drop("html")
        first = materialise(first, "parsed")
        thin = FR.needs_render("url", "word_count", c)
        rendered = first.filter(thin).withColumn("_new", self.render(F.col("url")))
        rendered = materialise(rendered, "rendered")
        again = parse(rendered.filter("_new IS NOT NULL AND _new <> ''").withColumn("html", F.col("_new")), True)
        same = rendered.filter("_new IS NULL OR _new = ''")
        return _union([first.filter(~thin), same.drop("_new"), again.drop("_new")]).drop("html")

    def _updates(self, final: DataFrame, judged: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """State changes, each naming the columns it sets."""
        error = F.when(F.col("decision") == "http_error", F.concat(F.lit("http_"), F.col("status").cast("string"))).when(
            F.col("decision").isin("redirect_limit", "truncated_asset"), F.when(F.col("decision") == "redirect_limit", "redirect_not_followed").otherwise("unsupported_media")
        ).when(
            F.col("decision").isin("redirect_not_followed", "network_error", "processing_error", "unsupported_media", "noindex"), F.col("decision")
        ).when(F.col("decision") == "duplicate_content", "duplicate")
        base = [F.lit("status"), F.lit("last_crawled"), F.lit("error")]
        short = final.filter("decision <> 'asset_ignored'").select(
            F.col("requested_url").alias("url"), F.coalesce("status", F.lit(0)).alias("status"), error.alias("error"),
            F.array(*base).alias("set_columns"),
        )
        seen = judged.filter("decision <> 'indexed'").select(
            F.col("requested_url").alias("url"), "status", error.alias("error"),
            F.when(F.col("decision") == "duplicate_content", F.col("content_hash")).alias("content_hash"),
            F.when(F.col("decision") == "duplicate_content", F.array(*base, F.lit("content_hash"))).otherwise(F.array(*base)).alias("set_columns"),
        )
        wide = ["status", "content_hash", "etag", "last_modified", "last_crawled", "last_changed", "error"]
        stored = docs.select("requested_url", "source_type", "canonical_url", "content_hash", "title").join(
            rows.select("requested_url", "status", _header("ETag").alias("etag"), _header("Last-Modified").alias("last_modified")), "requested_url"
        )
        page = F.col("source_type") == "web_page"
        full = stored.select(
            F.col("requested_url").alias("url"), "status", "content_hash", "etag", "last_modified", "canonical_url", "title",
            F.lit(self.now).alias("last_changed"),
            F.when(page, F.array(*[F.lit(x) for x in [*wide, "canonical_url", "title"]])).otherwise(F.array(*[F.lit(x) for x in wide])).alias("set_columns"),
        )
        out = _union([full, seen, short])
        return out.withColumns({"last_crawled": F.lit(self.now), "seq": F.lit(0)})

    # ---------------------------------------------------------------- run

    def run(self) -> CrawlResult:
        """Crawl level by level; documents and state of a level are stored before the next begins.

        A level's documents are one delta of their own, which a repeat of the run replaces. After a
        crash an incremental run finds the stored levels unchanged and emits only what is missing.
        """
        c, spark = self.config, self.spark
        stored = tables.read_snapshot(spark, c.state_db)
        empty = spark.createDataFrame([], STATE)
        prior = stored if stored is not None else empty
        state = prior if c.incremental else empty
        candidates, seen, left = self._seed(), None, c.max_pages
        logs, documents, updates = [], [], []
        merged = prior
        for level in range(c.max_depth + 1):
            gated = materialise(FR.gate(candidates, c), "gated")
            logs.append(gated.filter(F.col("decision").isin("skipped_media", "skipped_scope")).select("url", "decision"))
            frontier = materialise(FR.enqueue(gated, seen), "frontier")
            if frontier.isEmpty():
                break
            logs.append(frontier.select("url", F.lit("queued").alias("decision")))
            seen = frontier.select("url") if seen is None else seen.unionByName(frontier.select("url"))
            ready = self._with_robots(frontier)
            if left is not None:
                ready = FR.within_budget(ready.filter("allowed"), left).unionByName(ready.filter("NOT allowed"))
            ready = materialise(ready, "ready")
            log, docs, changed, found = self._level(ready, state, updates)
            logs += log
            documents.append(docs)
            updates.append(changed)
            jsonl.write_documents(docs, c.output_dir, f"{self.run_id}-{level}")
            merged = tables.write_snapshot(S.upsert_state(merged, changed), c.state_db)
            seen = materialise(_union([seen, docs.filter("source_type = 'web_page'").select("url")]).distinct(), "seen")
            if left is not None:
                left -= ready.filter("allowed").count()
            if found is None or (left is not None and left <= 0):
                break
            candidates = found
        decisions = materialise(_union(logs), "decisions")
        if not updates:
            merged = tables.write_snapshot(prior, c.state_db)
        return CrawlResult(_union(documents) if documents else None, decisions, merged, S.crawl_stats(decisions))


def warn_if_partial(spark: SparkSession, config: CrawlConfig) -> str | None:
    """A warning when state exists but its documents are gone: a delta run would emit little."""
    state = tables.read_snapshot(spark, config.state_db) if config.incremental else None
    if state is None or state.isEmpty():
        return None
    try:
        if not jsonl.read_documents(spark, config.output_dir).isEmpty():
            return None
    except Exception:  # noqa: BLE001 - no document files at all
        pass
    return f"crawl state has {state.count()} URLs but no documents are left: run with --full or remove the state"
