"""URL functions as native column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Query parameters that only track the visitor (matched whole, any case).
TRACKING_PATTERN = (
    r"(?i)^(utm_[a-z_]+|gclid|gclsrc|dclid|fbclid|msclkid|mc_[a-z]+|_hs[a-z]*|igshid|"
    r"ref|ref_src|source|gtm_latency)$"
)
# Link schemes that never lead to a page.
NON_PAGE_PREFIX = r"^(mailto:|tel:|javascript:|data:|#)"
# File extensions of linked documents, and of media that is never a document.
ASSET_EXTENSIONS = [".pdf", ".docx", ".doc", ".pptx", ".ppt", ".txt", ".csv"]
MEDIA_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".ico", ".tif", ".tiff",
    ".css", ".js", ".json", ".xml", ".rss", ".atom",
    ".mp4", ".webm", ".mov", ".avi", ".mp3", ".wav", ".ogg",
    ".zip", ".gz", ".tar", ".rar", ".7z", ".exe", ".dmg",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
]
# Content types that count as HTML, and prefixes that count as documents.
HTML_TYPES = ["text/html", "application/xhtml+xml", ""]
DOCUMENT_TYPE_PREFIXES = [
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument",
    "application/vnd.ms-",
    "application/rtf",
    "text/",
]

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_AUTHORITY = rf"^(?:{_SCHEME}:)?//([^/?#]*)"
_PATH = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _PATH, 1)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _QUERY, 1)


def url_host(url: Column | str) -> Column:
    """Lower-case host name without user info and port; '' when there is none."""
    authority = F.regexp_extract(_col(url), _AUTHORITY, 1)
    host = F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.lower(F.regexp_replace(host, r"[\[\]]", ""))


def url_origin(url: Column | str) -> Column:
    """``scheme://authority``, the place where robots.txt lives."""
    return F.regexp_extract(_col(url), rf"^({_SCHEME}://[^/?#]*)", 1)


def _fold_dots(path: Column) -> Column:
    def rebuilt(parts: Column) -> Column:
        folded = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda kept, part: F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part))),
        )
        as_folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(folded, "/"), as_folder), r"^//+", "/")

    return let(F.split(F.substring(path, 2, 2_147_483_647), "/", -1), rebuilt)


def _without_dot_segments(path: Column) -> Column:
    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), _fold_dots(p)).otherwise(p))


def _base_parts(base: Column) -> Column:
    path = url_path(base)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return F.struct(
        F.regexp_extract(base, rf"^({_SCHEME}:)", 1).alias("scheme"),
        url_origin(base).alias("origin"),
        path.alias("path"),
        F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")).alias("folder"),
        F.regexp_extract(base, r"^([^#]*)", 1).alias("page"),
    )


def _resolved(ref: Column, base: Column) -> Column:
    """``ref`` against a struct of :func:`_base_parts`."""
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    rooted = F.when(ref.startswith("/"), path).otherwise(F.concat(base["folder"], path))
    return (
        F.when(ref.rlike(rf"^{_SCHEME}:"), ref)
        .when(ref.startswith("//"), F.concat(base["scheme"], ref))
        .when((ref == "") | ref.startswith("#"), base["page"])
        .when(ref.startswith("?"), F.concat(base["origin"], base["path"], ref))
        .otherwise(F.concat(base["origin"], _without_dot_segments(rooted), rest))
    )


def resolve_url(ref: Column | str, base: Column | str) -> Column:
    """Resolve a link against the page it stands on (RFC 3986 reference resolution)."""
    return let(_base_parts(_col(base)), lambda b: let(_col(ref), lambda r: _resolved(r, b)))


def _decoded(part: Column) -> Column:
    """Form-decode one name or value; stray percent signs stay as they are."""
    safe = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def query_pairs(query: Column | str) -> Column:
    """``array<struct<k,v>>`` of the decoded parameters, blanks kept, in text order."""
    parts = F.filter(F.split(_col(query), "&", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            _decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def is_tracking_param(name: Column | str) -> Column:
    return _col(name).rlike(TRACKING_PATTERN)


def _absolute(raw: Column, base: Column | None) -> Column:
    """Trimmed, resolved URL without fragment; NULL for links that lead to no page.

    ``base`` is a struct of :func:`_base_parts` or None for absolute input.
    """

    def checked(text: Column) -> Column:
        target = text if base is None else _resolved(text, base)
        return F.when((text != "") & ~text.rlike(NON_PAGE_PREFIX), F.regexp_extract(target, r"^([^#]*)", 1))

    return let(F.regexp_replace(raw, r"(?U)^\s+|\s+$|[\t\r\n]", ""), checked)


def _split(url: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1)).alias("scheme"),
        F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "").alias("host_port"),
        url_host(url).alias("host"),
        F.regexp_replace(url_path(url), r"/{2,}", "/").alias("path"),
        url_query(url).alias("query"),
    )


def _netloc(p: Column) -> Column:
    """Host with its port unless that is the default; NULL for a port that is no port."""
    default = F.when(p["scheme"] == "http", "80").otherwise("443")
    valid = p["host_port"].rlike(r"^(\[[^\]]*\]|[^:]*)(:\d*)?$")

    def with_port(port: Column) -> Column:
        in_range = F.try_to_number(port, F.lit("9999999999")) <= 65535
        return F.when(valid & (port.isin("") | (port == default)), p["host"]).when(
            valid & in_range, F.concat(p["host"], F.lit(":"), port)
        )

    return let(F.regexp_replace(F.regexp_extract(p["host_port"], r":(\d*)$", 1), r"^0+", ""), with_port)


def _clean_query(query: Column) -> Column:
    """``?a=1&b=2`` of the kept parameters in sorted order, or ''."""
    kept = F.filter(F.array_sort(query_pairs(query)), lambda kv: ~is_tracking_param(kv["k"]))
    pairs = F.array_join(F.transform(kept, lambda kv: F.concat(kv["k"], F.lit("="), kv["v"])), "&")
    return F.when(query == "", "").otherwise(
        let(pairs, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    )


def _assemble(p: Column) -> Column:
    path = F.when(p["path"] == "", "/").otherwise(F.regexp_replace(p["path"], r"/index\.(html|htm|php)$", "/"))
    return F.when(
        p["scheme"].isin("http", "https") & (p["host"] != ""),
        F.concat(p["scheme"], F.lit("://"), _netloc(p), path, _clean_query(p["query"])),
    )


def canonical_url(url: Column | str, base: Column | str | None = None) -> Column:
    """One spelling per page: absolute http(s) URL, or NULL when it cannot be crawled.

    Fragment, default port, user info, doubled slashes, index files and tracking
    parameters go; the host is lower-cased and the other parameters are sorted.
    """
    if base is None:
        target = _absolute(_col(url), None)
    else:
        target = let(_base_parts(_col(base)), lambda b: _absolute(_col(url), b))
    return let(target, lambda t: let(_split(t), _assemble))


def canonical_urls(urls: Column, base: Column) -> Column:
    """Canonical form of a link array against one base, NULLs and repeats dropped."""
    targets = let(_base_parts(base), lambda b: F.transform(urls, lambda u: _absolute(u, b)))
    finished = F.transform(F.transform(targets, _split), _assemble)
    return F.array_distinct(F.filter(finished, lambda u: u.isNotNull()))


def in_domains(url: Column | str, domains: Sequence[str]) -> Column:
    """The host is one of the domains or lies below one."""
    host = url_host(url)
    hit = F.lit(False)
    for domain in domains:
        d = domain.lower()
        hit = hit | (host == d) | host.endswith("." + d)
    return hit


def url_extension(url: Column | str) -> Column:
    return F.regexp_extract(F.lower(url_path(url)), r"(\.[^./]*)$", 1)


def matches_scope(url: Column | str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Passes the include list (when there is one) and hits nothing on the exclude list."""
    url = _col(url)
    included = F.lit(not include)
    for pattern in include:
        included = included | url.rlike(f"(?i){pattern}")
    excluded = F.lit(False)
    for pattern in exclude:
        excluded = excluded | url.rlike(f"(?i){pattern}")
    return included & ~excluded


def url_section(url: Column | str) -> Column:
    """First non-empty path segment, or ``(home)``."""
    first = F.regexp_extract(url_path(url), r"^/*([^/]+)", 1)
    return F.when(first == "", "(home)").otherwise(first)


def eval_url(url: Column | str) -> Column:
    """The form in which the evaluation compares pages: no query, fragment or end slash."""
    return F.regexp_replace(F.regexp_extract(_col(url), r"^([^?#]*)", 1), r"/+$", "")


def is_media(url: Column | str, extensions: Sequence[str] = MEDIA_EXTENSIONS) -> Column:
    return url_extension(url).isin(list(extensions))


def is_asset_link(url: Column | str, extensions: Sequence[str] = ASSET_EXTENSIONS) -> Column:
    """The link, without its query, ends in a document extension."""
    bare = F.lower(F.regexp_extract(_col(url), r"^([^?]*)", 1))
    hit = F.lit(False)
    for extension in extensions:
        hit = hit | bare.endswith(extension)
    return hit


def is_html_type(content_type: Column | str) -> Column:
    return _col(content_type).isin(HTML_TYPES)


def is_document_type(
    content_type: Column | str, url: Column | str, extensions: Sequence[str] = ASSET_EXTENSIONS
) -> Column:
    """A non-HTML response worth keeping: known content type or document extension."""
    content_type = _col(content_type)
    hit = url_extension(url).isin(list(extensions))
    for prefix in DOCUMENT_TYPE_PREFIXES:
        hit = hit | content_type.startswith(prefix)
    return hit


def asset_file_name(url: Column | str) -> Column:
    """Stable name of a stored asset: 16 hex digits of the URL's SHA-1 plus its suffix."""
    url = _col(url)
    name = F.regexp_extract(F.regexp_extract(url, r"^([^?]*)", 1), r"([^/]*)/*$", 1)
    suffix = F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)
    suffix = F.when(suffix == "", ".bin").otherwise(F.substring(suffix, 1, 10))
    return F.concat(F.substring(F.sha1(url), 1, 16), suffix)
