"""Text functions: Unicode trimming and case folding, escapes, timestamps."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Unicode counts as white space at the ends of a text.
_BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip(c: Column) -> Column:
    """A text without Unicode white space at its ends."""
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def is_blank(c: Column) -> Column:
    """Whether a text is null or only white space."""
    return c.isNull() | (strip(c) == "")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def one_line(text: pd.Series) -> pd.Series:
    """A text for one line of output: control characters and line separators as escapes."""
    shown = {i: f"\\u{i:04x}" for i in [*range(32), *range(127, 160), 0x2028, 0x2029]} | {10: "\\n", 13: "\\r", 9: "\\t", 92: "\\\\"}
    return text.map(lambda x: None if x is None else x.translate(shown))


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def markdown_escape(c: Column) -> Column:
    """A text for a cell of a Markdown table."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n|\r|\n", " "), r"([\\`*_{}\[\]<>()#+\-.!|])", r"\\$1")


def workflow_escape(c: Column) -> Column:
    """A text for a line of a continuous-integration workflow command."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def shortened(c: Column, most: int) -> Column:
    """A text of at most so many characters, with an ellipsis where it was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("\u2026"))).otherwise(c)


def is_utc_timestamp(c: Column) -> Column:
    """Whether a text is an RFC 3339 time in UTC, with Z."""
    return c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$") & F.try_to_timestamp(c).isNotNull()


def is_zoned_timestamp(c: Column) -> Column:
    """Whether a text is an ISO 8601 time with a zone."""
    return c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(c).isNotNull()


def is_uuid(c: Column) -> Column:
    return c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def backoff(attempt: Column, first: float, most: float) -> Column:
    """Seconds to wait before an attempt: doubling from first, up to most."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt))


def unescaped(text: str) -> str:
    return html.unescape(text)
