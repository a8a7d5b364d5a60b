"""Fetching as a DataFrame step: requests in, responses out.

A fetcher is a function from ``url, etag, last_modified, start_at`` to rows of
``url, status, headers, content, encoding, error``. Redirects are followed in Spark, one round
per hop, so scope and robots checks stay column expressions.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions.http import REDIRECT_STATUS, RETRY_STATUS, header_charset
from ..functions.urls import url_host
from ..schemas import schema

Fetch = Callable[[DataFrame], DataFrame]
Transport = Callable[[str, dict, float, int], tuple[int, dict, bytes]]

RAW_RESPONSE = schema("url:string status:int headers:headers content:binary encoding:string error:string truncated:boolean")


def table_fetch(pages: DataFrame) -> Fetch:
    """Answer requests from a table ``url, status, headers, content``; the rest is 404.

    A stored ETag that matches the request gives 304 without a body.
    """
    stored = pages.select("url", "status", "headers", "content")

    def fetch(requests: DataFrame) -> DataFrame:
        rows = requests.select("url", "etag").join(stored, "url", "left")
        same = F.coalesce(F.try_element_at("headers", F.lit("ETag")) == F.col("etag"), F.lit(False))
        return rows.select(
            "url",
            F.when(same, 304).otherwise(F.coalesce("status", F.lit(404))).cast("int").alias("status"),
            F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda name, _: F.lower(name)).alias("headers"),
            F.when(~same, F.col("content")).alias("content"),
            F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("truncated"),
        )

    return fetch


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def urllib_transport(url: str, headers: dict, timeout: float, max_bytes: int) -> tuple[int, dict, bytes]:
    """One HTTP exchange without redirects; of a longer body one byte more than ``max_bytes`` is read."""
    opener = urllib.request.build_opener(_NoRedirect)
    try:
        with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as reply:
            return reply.status, dict(reply.headers), reply.read(max_bytes + 1)
    except urllib.error.HTTPError as reply:
        return reply.code, dict(reply.headers or {}), reply.read(max_bytes + 1)


def _attempts(url, headers, config: CrawlConfig, transport: Transport, sleep) -> dict:
    """Retry busy servers and network failures; the last failure becomes an ``error``."""
    for attempt in range(config.max_retries + 1):
        last = attempt == config.max_retries
        try:
            status, given, body = transport(url, headers, config.request_timeout, config.max_content_bytes)
            got = {str(name).lower(): value for name, value in given.items()}
        except Exception as failure:  # noqa: BLE001 - one bad URL must not fail the task
            if last:
                return {"url": url, "error": f"network_error: {type(failure).__name__}", "truncated": False}
            sleep(2**attempt + random.random())
            continue
        if status in RETRY_STATUS and not last:
            after = str(got.get("retry-after") or "")
            sleep(min(float(after) if after.isdigit() else 2**attempt, 60) + random.random())
            continue
        kept = body[: config.max_content_bytes] if body is not None else None
        return {"url": url, "status": status, "headers": got, "content": kept, "encoding": header_charset(got.get("content-type")),
                "truncated": kept is not None and len(kept) < len(body)}
    return {"url": url, "error": "network_error", "truncated": False}


def http_fetch(config: CrawlConfig, transport: Transport = urllib_transport, sleep=time.sleep) -> Fetch:
    """Fetch over HTTP inside tasks. A host's requests go to one task, in order of their start slots.

    Each waits for its slot, and for the host's delay since the previous attempt if that ended late
    (a slow page, a later batch, a retry), so nothing fires back to back.
    """

    def fetch(requests: DataFrame) -> DataFrame:
        began = time.time()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last: dict[str, float] = {}
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    headers = {"User-Agent": config.user_agent, "Accept-Language": "en-US,en;q=0.9",
                               "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"}
                    if isinstance(r.etag, str) and r.etag:
                        headers["If-None-Match"] = r.etag
                    if isinstance(r.last_modified, str) and r.last_modified:
                        headers["If-Modified-Since"] = r.last_modified
                    earliest = max(began + float(r.start_at), last.get(r.host, 0.0) + float(r.delay))
                    sleep(max(0.0, earliest - time.time()))
                    out.append(_attempts(r.url, headers, config, transport, sleep))
                    last[r.host] = time.time()
                rows = [[reply.get(name) for name in RAW_RESPONSE.names] for reply in out]
                frame = pd.DataFrame(rows, columns=RAW_RESPONSE.names, dtype=object)
                yield frame.assign(status=frame["status"].astype("Int32"))

        if "delay" not in requests.columns:
            requests = requests.withColumn("delay", F.lit(float(config.request_delay)))
        slots = requests.select("url", "etag", "last_modified", "start_at", "delay", url_host("url").alias("host"))
        slots = slots.repartition(config.max_workers, "host").sortWithinPartitions("start_at", "url")
        return slots.mapInPandas(run, RAW_RESPONSE)

    return fetch


def is_redirect(status: str = "status"):
    return F.col(status).isin(REDIRECT_STATUS)
