"""Row schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

SECTION = T.StructType(
    [T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]
)
_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType()),
    "sections": T.ArrayType(SECTION), "headers": T.MapType(T.StringType(), T.StringType()),
}


def schema(text: str) -> T.StructType:
    """Schema from ``name:type`` words; needs no running session, unlike DDL parsing."""
    pairs = (word.split(":") for word in text.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DOCUMENT = schema(
    "id:string url:string requested_url:string canonical_url:string source_type:string content_type:string "
    "title:string description:string language:string headings:strings breadcrumbs:strings keywords:strings "
    "text:string sections:sections word_count:int published_at:string modified_at:string sitemap_lastmod:string "
    "http_status:int content_hash:string crawled_at:string depth:int js_rendered:boolean local_path:string "
    "needs_extraction:boolean"
)
DOCUMENT_FIELDS = DOCUMENT.fields

CHUNK = schema(
    "chunk_id:string parent_id:string chunk_index:int url:string canonical_url:string title:string section:string "
    "content:string token_count:int source_type:string content_type:string published_at:string modified_at:string "
    "crawled_at:string breadcrumbs:strings"
)

STATE = schema(
    "url:string canonical_url:string status:int content_hash:string etag:string last_modified:string title:string "
    "first_seen:string last_crawled:string last_changed:string error:string"
)

RESPONSE = schema(
    "requested_url:string url:string status:int headers:headers content:binary encoding:string elapsed:double error:string"
)

FRONTIER = schema("url:string depth:int seq:bigint lastmod:string is_asset:boolean")

SITEMAP_ENTRIES = T.ArrayType(schema("kind:string loc:string lastmod:string"))

GOLDEN_CASE = schema("query_id:bigint query:string expected_urls:strings expect_answer:boolean")

PARSED_PAGE = schema(
    "title:string description:string keywords:string published_at:string modified_at:string robots:string "
    "language:string canonical_href:string breadcrumbs:strings hrefs:strings headings:strings raw_sections:sections "
    "raw_text:string error:string"
)
