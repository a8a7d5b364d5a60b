import pytest
from pyspark.sql import functions as F
from siltstone.operators import chunking as C
from siltstone.schemas import DOCUMENT


def doc(spark, **fields):
    row = {f.name: None for f in DOCUMENT.fields} | {"id": "d"} | fields
    return spark.createDataFrame([tuple(row[f.name] for f in DOCUMENT.fields)], DOCUMENT)


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def chunks(spark, size, overlap, **fields):
    return C.chunk_documents(doc(spark, **fields), size, overlap).orderBy("chunk_index").collect()


def test_windows_overlap_and_stop_at_the_end(spark):
    got = [c.content for c in chunks(spark, 4, 1, text=words(10), title="T")]
    assert got == [words(4), words(4, 3), words(4, 6)]


def test_text_that_fits_is_kept_as_it_is(spark):
    (c,) = chunks(spark, 10, 2, text=" a\n b ", title="T")
    assert (c.content, c.section, c.source_type, c.breadcrumbs) == (" a\n b ", "T", "web_page", [])


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_blank_text_has_no_chunks(spark, text):
    assert chunks(spark, 10, 2, text=text) == []


def test_small_sections_are_packed_under_the_first_heading(spark):
    (c,) = chunks(spark, 100, 10, sections=[("One", 1, "a b"), ("", 0, "c"), ("Two", 2, "d")])
    assert (c.section, c.content) == ("One", "One\na b\n\nc\n\nTwo\nd")


def test_packing_starts_a_new_chunk_when_the_budget_is_spent(spark):
    got = chunks(spark, 10, 0, sections=[("", 0, words(4)), ("B", 1, words(4)), ("C", 1, words(3))])
    assert [(c.section, c.chunk_index) for c in got] == [("Overview", 0), ("C", 1)]
    assert got[0].chunk_id == "d_0" and got[0].content == f"{words(4)}\n\nB\n{words(4)}"


def test_oversized_section_is_windowed_without_its_heading(spark):
    got = chunks(spark, 10, 2, sections=[("A", 1, "x"), ("Big", 1, words(20)), ("", 1, words(30)), ("Z", 1, "y")])
    assert [c.section for c in got] == ["A", "Big", "Big", "Big", "", "", "", "", "Z"]
    assert got[1].content == words(10) and got[2].content == words(10, 8)


def test_section_counted_as_oversized_may_come_back_whole(spark):
    (c,) = chunks(spark, 10, 2, sections=[("H", 1, words(9))])
    assert (c.section, c.content, c.token_count) == ("H", words(9), 12)


def test_blank_parts_keep_their_index(spark):
    got = chunks(spark, 3, 0, sections=[("", 0, " "), ("B", 1, words(3)), ("", 0, "z")])
    assert [(c.chunk_index, c.content) for c in got] == [(1, words(3)), (2, "z")]


def test_parent_falls_back_to_the_hash(spark):
    (c,) = chunks(spark, 5, 0, id="", content_hash="f" * 64, text="a", url="u", canonical_url="")
    assert c.parent_id == "f" * 32 and c.canonical_url == "u"


def test_injected_tokenizer(spark):
    got = C.chunk_documents(doc(spark, sections=[("", 0, "abc"), ("", 0, "de")]), 4, 0, lambda t: F.length(t)).collect()
    assert [c.content for c in got] == ["abc", "de"] and [c.token_count for c in got] == [3, 2]


def test_chunking_does_not_shuffle(spark):
    plan = C.chunk_documents(doc(spark, text="a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
