"""Sitemap parsing and the walk over nested sitemap indexes."""

from __future__ import annotations

import gzip
import zlib
from itertools import count
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..schemas import SITEMAP_ENTRIES
from ..session import materialise
from .ranks import first_by, ordinals

_NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def _entries(url: str | None, body: bytes | None) -> list[dict]:
    raw = bytes(body or b"")
    if raw[:2] == b"\x1f\x8b" or (url or "").endswith(".gz"):
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            pass
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return []
    kind = {"sitemapindex": "sitemap", "urlset": "url"}.get(root.tag.rpartition("}")[2])
    if kind is None:
        return []
    return [
        {"kind": kind, "loc": (n.findtext(f"{_NS}loc") or ""), "lastmod": n.findtext(f"{_NS}lastmod")}
        for n in root.iterfind(f"{_NS}{kind}")
    ]


@F.pandas_udf(SITEMAP_ENTRIES)
def _entries_udf(url: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([_entries(u, b) for u, b in zip(url, body)])


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """Rows ``sitemap_url, pos, kind, url, lastmod`` of sitemap files (``url, content``).

    Broken XML yields no rows. Locations are resolved and canonicalised in Spark.
    """
    rows = files.select(F.col("url").alias("sitemap_url"), _entries_udf("url", "content").alias("entries"))
    return rows.select("sitemap_url", F.posexplode("entries").alias("pos", "e")).select(
        "sitemap_url", "pos", F.col("e.kind").alias("kind"),
        U.canonical_url(F.col("e.loc"), F.col("sitemap_url")).alias("url"), F.col("e.lastmod").alias("lastmod"),
    ).filter(F.col("url").isNotNull())


def discover(files: DataFrame, roots: DataFrame, max_sitemaps: int | None = None) -> DataFrame:
    """All page entries reachable from the root sitemaps: ``url, lastmod``.

    Each sitemap is read once; the first entry of a URL wins (by level, sitemap, position).
    Level-synchronous: one join of the new sitemaps with the parsed entries per level, until a level
    has nothing new.
    ``max_sitemaps`` limits how many sitemaps are opened, nearest levels first.
    """
    parsed = materialise(parse_sitemaps(files), "sitemaps")
    level = materialise(roots.select(F.col("url").alias("sitemap_url")).distinct().withColumn("level", F.lit(0)), "roots")
    opened, budget = level, max_sitemaps
    for depth in count(1):
        children = (
            parsed.filter(F.col("kind") == "sitemap")
            .join(level.select("sitemap_url"), "sitemap_url")
            .select(F.col("url").alias("sitemap_url"))
            .distinct()
            .join(opened.select("sitemap_url"), "sitemap_url", "left_anti")
            .withColumn("level", F.lit(depth))
        )
        level = materialise(children, "sitemap-level")
        if level.isEmpty():
            break
        opened = opened.unionByName(level)
    if budget is not None:
        opened = ordinals(opened, [], ["level"], "sitemap_url").filter(F.col("ordinal") <= budget).drop("ordinal")
    entries = parsed.filter(F.col("kind") == "url").join(opened, "sitemap_url")
    return first_by(entries, ["url"], ["level", "sitemap_url", "pos"], ["lastmod"]).select("url", "lastmod")
