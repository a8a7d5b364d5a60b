"""JSON-lines sources and sinks with explicit schemas."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from ..schemas import CHUNK, DOCUMENT, GOLDEN_CASE

_TORN = "_corrupt_record"


def _pattern(path: str, prefix: str) -> str:
    """A single file as it is; a folder means its ``prefix*`` delta files."""
    return path if path.endswith((".jsonl", ".json")) else f"{path.rstrip('/')}/{prefix}*"


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """All non-blank lines, one column per document key, lines that are no JSON object in ``_corrupt_record``.

    Records end at a newline only, so other Unicode line separators stay data. Values of another JSON
    type than expected never cost a record: every field is read as text first and then converted, 3.0
    and "3" to the number 3, a single value to a list of one; what cannot be converted is null.
    """
    lines = spark.read.option("lineSep", "\n").text(_pattern(path, "documents_")).filter(F.trim("value") != "")
    raw = StructType([*[StructField(f.name, StringType()) for f in DOCUMENT.fields], StructField(_TORN, StringType())])
    parsed = lines.select(F.from_json("value", raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _TORN}).alias("r"))
    columns = [_converted(F.col(f"r.{f.name}"), f.dataType).alias(f.name) for f in DOCUMENT.fields]
    return parsed.select(*columns, F.col(f"r.{_TORN}").alias(_TORN))


def _converted(value: Column, kind: DataType) -> Column:
    """A JSON value given as text, in the wanted type; null where that is impossible."""
    if isinstance(kind, IntegerType):
        return value.try_cast("double").try_cast("int")
    if isinstance(kind, BooleanType):
        return value.try_cast("boolean")
    if not isinstance(kind, ArrayType):
        return value
    many = F.startswith(F.trim(value), F.lit("["))
    if isinstance(kind.elementType, StringType):
        return F.when(many, F.from_json(value, ArrayType(StringType()))).when(value.isNotNull(), F.array(value))
    fields = kind.elementType.fields
    items = F.from_json(value, ArrayType(StructType([StructField(f.name, StringType()) for f in fields])))
    return F.transform(items, lambda item: F.struct(*[_converted(item[f.name], f.dataType).alias(f.name) for f in fields]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Complete documents of all delta files; a torn last line is skipped."""
    rows = scan_documents(spark, path)
    return rows.filter(F.col(_TORN).isNull() & (F.col("url").isNotNull() | F.col("id").isNotNull())).drop(_TORN)


def torn_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many non-blank lines are not JSON objects (a crawl may still be writing)."""
    return scan_documents(spark, path).agg(F.count_if(F.col(_TORN).isNotNull()).alias("torn"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files; a broken line fails the job."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").option("lineSep", "\n").json(_pattern(path, "chunks_"))


def write_documents(docs: DataFrame, folder: str, delta: str) -> None:
    """Write the documents of one delta, in place of an earlier attempt; keys a document lacks are left out."""
    docs.write.mode("overwrite").json(f"{folder.rstrip('/')}/documents_{delta}.jsonl")


def write_chunks(chunks: DataFrame, folder: str, run_id: str) -> None:
    chunks.write.mode("error").json(f"{folder.rstrip('/')}/chunks_{run_id}.jsonl")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").json(path)


def save_assets(assets: DataFrame, folder: str) -> None:
    """Write ``name, content`` rows as files of a mounted shared folder.

    Every file is written under a temporary name and renamed, so a repeated task is harmless.
    """

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = PurePosixPath(folder) / row.name
            part = f"{target}.{os.getpid()}.part"
            with open(part, "wb") as out:
                out.write(bytes(row.content or b""))
            os.replace(part, target)

    assets.select("name", "content").foreachPartition(write)


def load_golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from YAML; ``expect_answer`` defaults to having expected URLs."""
    import yaml

    with open(path, encoding="utf-8") as source:
        cases = yaml.safe_load(source) or []
    rows = []
    for number, case in enumerate(cases):
        urls = list(case.get("expected_urls") or [])
        rows.append((number, case["query"], urls, bool(case.get("expect_answer", bool(urls)))))
    return spark.createDataFrame(rows, GOLDEN_CASE)
