import json

import pytest
from pyspark.sql import functions as F
from siltstone.__main__ import main
from siltstone.sources import jsonl, tables
from siltstone.streaming import ingest


def write(path, docs, tail=""):
    path.write_text("".join(json.dumps(d, ensure_ascii=False) + "\n" for d in docs) + tail, encoding="utf-8")


DOCS = [
    {"id": "a", "url": "https://s.com/x/1", "title": "Alpha key", "text": "alpha beta gamma", "word_count": 3, "source_type": "web_page",
     "sections": [{"heading": "H", "level": 1, "text": "alpha beta gamma"}], "modified_at": "Tue, 02 Jan 2024 00:00:00 GMT"},
    {"id": "b", "url": "https://s.com/2.pdf", "title": "Two", "text": "delta", "word_count": 1, "source_type": "linked_document",
     "content_type": "application/pdf", "needs_extraction": False},
]


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "documents_1.jsonl", DOCS[:1])
    write(tmp_path / "documents_2.jsonl", DOCS[1:], '{"id": "torn", "ur')
    return tmp_path


def test_torn_lines_are_skipped_and_counted(spark, folder):
    got = {r.id: r for r in jsonl.read_documents(spark, str(folder)).collect()}
    assert set(got) == {"a", "b"} and got["a"].text == "alpha beta gamma" and got["b"].sections is None
    assert jsonl.torn_lines(spark, str(folder)).first().torn == 1


def test_broken_chunk_files_fail(spark, tmp_path):
    (tmp_path / "chunks_1.jsonl").write_text('{"chunk_id": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_chunks(spark, str(tmp_path)).collect()


def test_commands_end_to_end(spark, folder, capsys):
    assert main(["chunk", str(folder), "--chunk-size", "5", "--overlap", "1"], spark) == 0
    assert '"documents": 2, "structured": 1, "fallback": 1' in capsys.readouterr().out
    assert main(["analyze", str(folder)], spark) == 0
    report = capsys.readouterr().out
    assert '"year": "2024"' in report and "skipped 1 incomplete" in report
    index = str(folder / "index")
    assert main(["ingest", str(folder), "--index", index], spark) == 0
    assert main(["ingest", str(folder), "--index", index], spark) == 0
    assert tables.read_snapshot(spark, index).count() == 2
    assert main(["search", "alpha", "--index", index, "--top-k", "1"], spark) == 0
    assert '"url": "https://s.com/x/1"' in capsys.readouterr().out
    assert main(["ask", "what is alpha beta", "--index", index, "--trace"], spark) == 0
    assert '"node": "check"' in capsys.readouterr().out
    golden = folder / "golden.yaml"
    golden.write_text("- query: alpha beta gamma\n  expected_urls: [https://s.com/x/1]\n- query: nothing\n")
    assert main(["evaluate", "--index", index, "--testset", str(golden), "--skip-ask", "--output", str(folder / "report")], spark) == 0
    assert '"total_queries": 2' in capsys.readouterr().out


def test_snapshots_ignore_incomplete_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_snapshot(spark, path) is None
    tables.write_snapshot(spark.range(3), path)
    (tmp_path / "t" / "v2").mkdir()
    assert tables.read_snapshot(spark, path).count() == 3
    tables.write_snapshot(spark.range(5), path)
    assert tables.read_snapshot(spark, path).count() == 5


def test_document_stream_fills_the_index_once(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "idx")
    source.mkdir()
    write(source / "documents_1.jsonl", DOCS[:1])

    def go():
        ingest.index_stream(ingest.stream_documents(spark, str(source)), index, str(tmp_path / "cp")).awaitTermination()

    go()
    write(source / "documents_2.jsonl", DOCS)
    go()
    got = tables.read_snapshot(spark, index)
    assert sorted(r.chunk_id for r in got.collect()) == ["a_0", "b_0"]


def test_first_seen_urls_streams_each_url_once(spark, tmp_path):
    source = tmp_path / "s"
    spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 00:00:00")], "url string, crawled_at string").select(
        "url", F.col("crawled_at").cast("timestamp")).write.parquet(str(source))
    stream = spark.readStream.schema("url string, crawled_at timestamp").parquet(str(source))
    q = ingest.first_seen_urls(stream).writeStream.format("memory").queryName("first_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("first_seen").collect()) == ["u", "v"]


def test_values_of_other_types_cost_no_record(spark, tmp_path):
    lines = [
        '{"url": "a", "word_count": 3.0, "headings": ["x", "y"]}', '{"url": "b", "http_status": "200", "keywords": "one"}',
        '{"url": "c", "sections": [{"heading": "h", "level": "2", "text": "t"}], "js_rendered": "true"}', '{"url": "d", "depth": 1, "title": 7}',
        '{"url": "torn", ', "[1, 2]", "",
    ]
    (tmp_path / "documents_1.jsonl").write_text("\n".join(lines))
    got = {r.url: r for r in jsonl.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].word_count, got["a"].headings, got["b"].http_status, got["b"].keywords) == (3, ["x", "y"], 200, ["one"])
    assert got["c"].sections[0].level == 2 and got["c"].js_rendered is True and got["d"].title == "7" and got["d"].depth == 1
    assert jsonl.torn_lines(spark, str(tmp_path)).first().torn == 2


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from siltstone.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
