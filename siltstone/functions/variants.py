"""JSON of unknown shape as variant columns: parsed once, typed by a schema found by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(body: Column | str) -> Column:
    """The variant of a JSON text; null if it is malformed or null."""
    return F.try_parse_json(F.col(body) if isinstance(body, str) else body)


def malformed(body: Column | str) -> Column:
    """Whether a text is there but is no JSON."""
    text = F.col(body) if isinstance(body, str) else body
    return text.isNotNull() & parsed(text).isNull()


def found_schema(df: DataFrame, body: str) -> str:
    """The type that all well-formed texts of ``body`` fit, as DDL; ``VOID`` if there are none.

    One aggregate with partial merging: what reaches the driver is one type, however many rows there are.
    Fields whose types disagree stay variants.
    """
    schema = df.agg(F.schema_of_variant_agg(parsed(body)).alias("s")).first().s
    return schema.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def shredded(df: DataFrame, body: str, into: str = "value", schema: str | None = None) -> DataFrame:
    """``df`` with ``into`` (typed by ``schema``, by default the found one) and ``malformed``.

    A row whose value does not fit a given schema has a null ``into``; it is not an error.
    """
    schema = schema or found_schema(df, body)
    return df.withColumn(into, F.try_variant_get(parsed(body), "$", schema)).withColumn("malformed", malformed(body))


def field_types(df: DataFrame, body: str, depth: int = 2) -> DataFrame:
    """``path, type, n``: how often each object field down to ``depth`` has which type.

    Fields are opened level by level by a lateral explode, which needs no shuffle; only the counts move. Fields inside
    arrays belong to the array and are not opened. Malformed texts count under path ``$`` with type ``MALFORMED``.
    """
    root = df.select(F.lit("$").alias("path"), parsed(body).alias("v"), malformed(body).alias("bad"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    levels = [root.select("path", F.when(F.col("bad"), "MALFORMED").otherwise(kind).alias("type"))]
    level = root.select("path", "v")
    for _ in range(depth):
        objects = level.filter(F.schema_of_variant("v").startswith("OBJECT"))
        opened = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("item")))
        level = opened.select(F.concat("path", F.lit("."), "key").alias("path"), F.col("item").alias("v"))
        levels.append(level.select("path", kind.alias("type")))
    every = levels[0]
    for part in levels[1:]:
        every = every.unionByName(part)
    return every.filter("type IS NOT NULL").groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))
