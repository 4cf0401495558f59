"""Links, cells and text of stored HTML as columns (regular expressions, no parser tree)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Entities that occur in link texts.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_BLOCK = r"(?i)</?(?:li|td|th|tr|p|div|ul|ol|table|tbody|section|article|nav|body|h[1-6])\b[^>]*>"


def unescape(col: Column) -> Column:
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def text_of(html: Column) -> Column:
    """Text without tags, each piece trimmed."""
    return unescape(F.array_join(F.transform(F.split(html, "<[^>]*>"), strip), ""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the opening tag; empty without one."""
    head = F.regexp_extract(tag, "(?s)^<[^>]*>", 0)
    value = F.regexp_extract(head, rf"""(?is)[\s"']{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s>"']+))""", 1)
    return unescape(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def anchors(html: Column) -> Column:
    """All <a ...>...</a> fragments in document order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))


def links(html: Column) -> Column:
    """array<struct(href, text, title)> in document order."""
    return F.transform(
        anchors(html),
        lambda a: F.struct(
            attribute(a, "href").alias("href"), text_of(a).alias("text"), attribute(a, "title").alias("title")
        ),
    )


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))


def cells(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>.*?</td>"), F.lit(0)), text_of)


def blocks(html: Column) -> Column:
    """Fragments between block-level tags: the text a link stands in."""
    return F.split(html, _BLOCK)


def absolute(href: Column, base: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)
