"""Command line: ``python -m siltstone crawl|chunk|analyze|ingest|search|ask|evaluate``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_crawl_config
from .operators import chunking, evaluate, profile, state
from .plans.crawl import Crawl, warn_if_partial
from .plans.engine import Engine
from .session import build_session
from .sources import jsonl, tables
from .sources.fetch import http_fetch


def _show(df: DataFrame) -> None:
    """Print a result that is small by construction (a top-k list or one row)."""
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def _run_id() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    config = load_crawl_config(
        a.config, max_pages=a.max_pages, incremental=False if a.full else None,
        follow_links=False if a.no_links else None, render_js="off" if a.no_render else None,
    )
    warning = warn_if_partial(spark, config)
    if warning:
        print(warning, file=sys.stderr)
    run_id = _run_id()
    result = Crawl(spark, config, http_fetch(config), run_id, datetime.now(UTC).isoformat(timespec="seconds")).run()
    log = a.log_file or f"{config.output_dir}/logs/crawl_{run_id}"
    result.decisions.write.mode("error").json(log)
    _show(result.stats)
    print(f"decision log: {log}")
    return 0


def chunk(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = jsonl.read_documents(spark, a.path)
    if docs.isEmpty():
        print(f"no documents in {a.path}")
        return 1
    chunks = chunking.chunk_documents(docs, a.chunk_size, a.overlap)
    folder = a.output or a.path
    jsonl.write_chunks(chunks, folder, _run_id())
    _show(chunking.chunk_report(docs, chunks))
    return 0


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = jsonl.read_documents(spark, a.path)
    if docs.isEmpty():
        print(f"no documents in {a.path}")
        return 1
    pages, assets = docs.filter("source_type = 'web_page'"), docs.filter("source_type = 'linked_document'")
    brief = ["word_count", "title", "url"]
    parts = {
        "summary": profile.corpus_summary(docs),
        "languages": profile.language_counts(pages),
        "sections": profile.with_bars(profile.section_shares(pages, a.top)),
        "freshness": profile.with_bars(profile.freshness(pages)),
        "hosts": profile.host_shares(docs),
        "topics": profile.topic_counts(docs, a.top),
        "terms": profile.term_frequencies(docs, a.top),
        "largest": profile.largest(pages.select(*brief)),
        "samples": profile.samples_per_section(pages.select(*brief)),
        "assets": profile.asset_types(assets),
    }
    stored = tables.read_snapshot(spark, a.state) if a.state else None
    if stored is not None:
        parts["outcomes"] = state.crawl_outcomes(stored)
    for name, df in parts.items():
        print(f"== {name}")
        _show(df)
    torn = jsonl.torn_lines(spark, a.path).first().torn
    if torn:
        print(f"(skipped {torn} incomplete lines)")
    return 0


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    from .functions.vectors import hashed_embedding
    from .operators.search import merge_chunks

    chunks = jsonl.read_chunks(spark, a.path)
    if chunks.isEmpty():
        print(f"no chunks in {a.path}")
        return 1
    tables.merge_into(spark, a.index, chunks.withColumn("embedding", hashed_embedding("content")), merge_chunks)
    return 0


def _engine(spark: SparkSession, path: str) -> Engine:
    try:
        return Engine(spark).open(path)
    except FileNotFoundError as missing:
        raise SystemExit(str(missing)) from None


def _question(spark: SparkSession, text: str) -> DataFrame:
    if not text.strip():
        raise SystemExit("the question is empty")
    return spark.createDataFrame([(0, text)], "query_id int, query string")


def search(spark: SparkSession, a: argparse.Namespace) -> int:
    hits = _engine(spark, a.index).search(_question(spark, a.query), a.top_k)
    _show(hits.orderBy("rank").select("rank", "score", "chunk_id", "url", "title", "section", "content"))
    return 0


def ask(spark: SparkSession, a: argparse.Namespace) -> int:
    engine = _engine(spark, a.index)
    answers = engine.ask(_question(spark, a.query))
    if a.trace:
        _show(engine.trace(answers).orderBy("step"))
    _show(answers)
    return 0


def run_evaluation(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = jsonl.load_golden_cases(spark, a.testset)
    cases = cases.orderBy("query_id").limit(a.limit) if a.limit else cases
    if cases.isEmpty():
        print(f"no cases in {a.testset}")
        return 1
    rows = _engine(spark, a.index).evaluate(cases, a.top_k, not a.skip_ask)
    _show(evaluate.summarize(rows))
    _show(evaluate.report_lines(rows).orderBy("query_id"))
    if a.output:
        jsonl.write_report(rows, a.output)
    return 0


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="siltstone")
    sub = root.add_subparsers(dest="command", required=True)

    def add(name, run, *positional):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for arg in positional:
            p.add_argument(arg)
        return p

    p = add("crawl", crawl)
    p.add_argument("-c", "--config", required=True)
    p.add_argument("--max-pages", type=int)
    for flag in ("--full", "--no-links", "--no-render"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--log-file")
    p = add("chunk", chunk, "path")
    p.add_argument("--chunk-size", type=int, default=chunking.CHUNK_SIZE)
    p.add_argument("--overlap", type=int, default=chunking.OVERLAP)
    p.add_argument("--output")
    p = add("analyze", analyze, "path")
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--state", help="crawl state, for the outcome counts")
    add("ingest", ingest, "path").add_argument("--index", required=True)
    p = add("search", search, "query")
    p.add_argument("--index", required=True)
    p.add_argument("--top-k", type=int, default=10)
    p = add("ask", ask, "query")
    p.add_argument("--index", required=True)
    p.add_argument("--trace", action="store_true")
    p = add("evaluate", run_evaluation)
    p.add_argument("--index", required=True)
    p.add_argument("--testset", required=True)
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--skip-ask", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--output")
    return root


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or build_session(), args)


if __name__ == "__main__":
    raise SystemExit(main())
