"""Settings of a crawl and of the answer chain, loaded from YAML or keyword arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.urls import ASSET_EXTENSIONS, MEDIA_EXTENSIONS

USER_AGENT = "siltstone/1.0 (+https://example.com/bot)"
RENDER_MODES = ("off", "auto", "always")


def _list():
    return field(default_factory=list)


@dataclass(frozen=True)
class CrawlConfig:
    """What to crawl and how.

    Fixed values: the key names and defaults, so that existing YAML files keep their meaning.
    """

    name: str = "crawl"
    seeds: list[str] = _list()
    sitemaps: list[str] = _list()
    allowed_domains: list[str] = _list()
    include_patterns: list[str] = _list()
    exclude_patterns: list[str] = _list()
    user_agent: str = USER_AGENT
    obey_robots: bool = True
    obey_noindex: bool = True
    request_delay: float = 1.0
    max_workers: int = 4
    request_timeout: float = 30.0
    max_retries: int = 2
    max_pages: int | None = None
    max_depth: int = 5
    follow_links: bool = True
    # Longer bodies are cut and marked; a cut asset is not indexed.
    max_content_bytes: int = 20 << 20
    # Hops followed per request; what still redirects then is logged as redirect_limit.
    max_redirects: int = 5
    fetch_assets: bool = True
    asset_extensions: list[str] = field(default_factory=lambda: list(ASSET_EXTENSIONS))
    save_assets: bool = True
    skip_extensions: list[str] = field(default_factory=lambda: list(MEDIA_EXTENSIONS))
    render_js: str = "auto"
    render_min_words: int = 60
    render_hosts: list[str] = _list()
    render_concurrency: int = 2
    render_timeout: float = 45.0
    output_dir: str = "data/crawl"
    state_db: str = "data/crawl/state"
    incremental: bool = True

    def __post_init__(self) -> None:
        if not self.allowed_domains:
            raise ValueError("allowed_domains is empty: name at least one domain")
        if not (self.seeds or self.sitemaps):
            raise ValueError("nothing to start from: give seeds or sitemaps")
        if self.render_js not in RENDER_MODES:
            raise ValueError(f"render_js is {self.render_js!r}, expected one of {', '.join(RENDER_MODES)}")
        for pattern in [*self.include_patterns, *self.exclude_patterns]:
            re.compile(pattern)


def load_crawl_config(path: str | Path, **overrides: object) -> CrawlConfig:
    """Read a YAML file; keys the configuration does not know are an error."""
    import yaml

    values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    stray = sorted(set(values) - {f.name for f in fields(CrawlConfig)})
    if stray:
        raise ValueError(f"unknown configuration keys: {', '.join(stray)}")
    values.update({k: v for k, v in overrides.items() if v is not None})
    return CrawlConfig(**values)


@dataclass(frozen=True)
class AnswerConfig:
    """Sizes and switches of retrieval and answering."""

    index_name: str = "chunks"
    # Stem the words of texts and questions as English.
    stem: bool = False
    embedding_model: str = "hashed-64"
    reranker_model: str = "lexical-overlap"
    answer_model: str = "extractive"
    retrieval_top_k: int = 20
    rerank_top_k: int = 5
    max_retries: int = 1
    multi_query_variants: int = 3
    semantic_verification: bool = True
    # Whole evidence by default; 1200 reproduces the reference's prompt size.
    evidence_max_chars: int | None = None
    # Word appended to questions of at most two words, usually the product's name.
    product_keyword: str = ""
    rrf_k: int = 60
