"""Functions on HTTP responses: types, charsets, back-off, robots rules."""

from __future__ import annotations

import re
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

# Status codes that redirect, and those worth another attempt.
REDIRECT_STATUS = [301, 302, 303, 307, 308]
RETRY_STATUS = [429, 500, 502, 503, 504]
_CHARSET = r"""(?i)charset=["']?([\w\-]+)"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def media_type(content_type: Column | str) -> Column:
    """Content type without parameters, trimmed and lower-cased."""
    return F.lower(F.trim(F.split_part(F.coalesce(_col(content_type), F.lit("")), F.lit(";"), F.lit(1))))


def charset_of(content_type: Column | str, body: Column | str) -> Column:
    """Charset from the header, else from the document's head element, else UTF-8 if valid, else cp1252."""
    body = _col(body)
    header = F.regexp_extract(F.coalesce(_col(content_type), F.lit("")), _CHARSET, 1)
    head = F.get(F.split(F.decode(body, "ISO-8859-1"), r"(?i)</head\b|<body\b", 2), 0)
    declared = F.regexp_extract(head, _CHARSET, 1)
    return (
        F.when(header != "", header)
        .when(declared != "", declared)
        .when(F.is_valid_utf8(body.cast("string")), "utf-8")
        .otherwise("cp1252")
    )


@F.pandas_udf(StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Decode bytes with replacement characters; charsets that cannot be used are read as UTF-8."""

    def one(raw: bytes | None, name: str | None) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode(name or "utf-8", errors="replace")
        except (LookupError, UnicodeError):
            return bytes(raw).decode("utf-8", errors="replace")

    return pd.Series([one(b, c) for b, c in zip(body, charset)])


def backoff_seconds(attempt: Column | str, retry_after: Column | str) -> Column:
    """Seconds to wait before the next attempt, without jitter."""
    after = _col(retry_after)
    given = F.when(after.rlike(r"^\d+$"), F.least(after.try_cast("double"), F.lit(60.0)))
    return F.coalesce(given, F.least(F.pow(F.lit(2.0), _col(attempt)), F.lit(60.0)))


def robots_sitemaps(robots_txt: Column | str) -> Column:
    """``Sitemap:`` lines of a robots.txt, comments removed, in file order."""
    text = F.regexp_replace(_col(robots_txt), r"#[^\r\n]*", "")
    return F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))


def _parsed(text: str | None, status: int | None, cache: dict) -> RobotFileParser | None:
    """Rules of one robots.txt; None means no restriction."""
    key = (text, status)
    if key not in cache:
        rules: RobotFileParser | None = RobotFileParser()
        if status in (401, 403):
            rules.disallow_all = True
        elif status is None or pd.isna(status) or status >= 300 or text is None:
            rules = None
        else:
            rules.parse(text.splitlines())
        cache[key] = rules
    return cache[key]


def _can_fetch(rules: RobotFileParser, user_agent: str, url: str) -> bool:
    """A URL that the rules' parser cannot read is not fetched."""
    try:
        return rules.can_fetch(user_agent, url)
    except ValueError:
        return False


def robots_allows(user_agent: str):
    """UDF (robots_txt, status, url) -> boolean under the standard library's rule order.

    Failure to read robots.txt, a redirect that leads nowhere and any 4xx/5xx but 401/403 allow everything.
    """

    @F.pandas_udf(BooleanType())
    def allowed(robots_txt: pd.Series, status: pd.Series, url: pd.Series) -> pd.Series:
        cache: dict = {}
        out = []
        for text, code, target in zip(robots_txt, status, url):
            rules = _parsed(text, code, cache)
            out.append(True if rules is None else _can_fetch(rules, user_agent, target))
        return pd.Series(out, dtype=bool)

    return allowed


def robots_crawl_delay(user_agent: str):
    """UDF (robots_txt, status) -> seconds or NULL."""

    @F.pandas_udf(DoubleType())
    def delay(robots_txt: pd.Series, status: pd.Series) -> pd.Series:
        cache: dict = {}
        out = []
        for text, code in zip(robots_txt, status):
            rules = _parsed(text, code, cache)
            seconds = None if rules is None else rules.crawl_delay(user_agent)
            out.append(None if seconds is None else float(seconds))
        return pd.Series(out, dtype="float64")

    return delay


def header_charset(content_type: str | None) -> str | None:
    """Driver/worker-side twin of the header rule in :func:`charset_of`."""
    found = re.search(_CHARSET, content_type or "")
    return found.group(1) if found else None
