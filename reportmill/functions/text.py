"""Text folding, slugs and name normalisation as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode text splitting sees it (wider than Java's \s).
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same characters but the blank.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _accent_table(form: str, keep) -> tuple[str, str]:
    """(from, to) strings for `translate`: code points that decompose to one kept character."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize(form, ch) if keep(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


# NFD then ASCII only: every character whose canonical decomposition has one ASCII character.
_FOLD_FROM, _FOLD_TO = _accent_table("NFD", lambda c: ord(c) < 128)
# NFKD without combining marks, limited to decompositions that leave one character.
_PLAIN_FROM, _PLAIN_TO = _accent_table("NFKD", lambda c: not unicodedata.combining(c))


def _quote(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def const_array(values) -> Column:
    """A constant array, written as one SQL literal."""
    return F.expr(f"array({', '.join(_quote(v) for v in values)})")


def const_map(pairs: dict) -> Column:
    """A constant map, written as one SQL literal."""
    return F.expr(f"map({', '.join(f'{_quote(k)}, {_quote(v)}' for k, v in pairs.items())})")


def const_rows(names, rows) -> Column:
    """A constant array of structs, written as one SQL literal."""
    parts = (
        "named_struct(" + ", ".join(f"'{n}', {_quote(v)}" for n, v in zip(names, row)) + ")" for row in rows
    )
    return F.expr(f"array({', '.join(parts)})")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Predicates that Catalyst moves below a projection repeat whatever they refer to; a
    value bound here is written once however often `body` reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(col, F.lit(_WS_CHARS))


def squeeze(col: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), f"{WS}+", " "))


def ascii_lower(col: Column) -> Column:
    """Drop accents, drop what is still not ASCII, lower-case. Whitespace is untouched."""
    return F.lower(F.regexp_replace(F.translate(col, _FOLD_FROM, _FOLD_TO), r"[^\x00-\x7F]", ""))


def fold(col: Column) -> Column:
    """`ascii_lower` with whitespace squeezed and trimmed."""
    return squeeze(ascii_lower(col))


def slug(col: Column) -> Column:
    """Stable ASCII key of a display name."""
    return F.trim(F.regexp_replace(ascii_lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


def stem_slug(col: Column, default: str = "rapport") -> Column:
    """File name (or folder name) to a safe stem: last path part, no suffix, [a-z0-9_]."""
    base = F.regexp_replace(F.regexp_replace(col, "/+$", ""), "^.*/", "")
    base = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    cleaned = F.trim(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def without_accents(col: Column) -> Column:
    """Compatibility decomposition with combining marks removed (case kept)."""
    return F.regexp_replace(F.translate(col, _PLAIN_FROM, _PLAIN_TO), r"\p{Mn}", "")


# Legal and generic words removed from company names.
LEGAL_WORDS = (
    "sa", "sarl", "sca", "spa", "sas", "snc", "sci", "group", "groupe",
    "holding", "bank", "banque", "maroc", "morocco",
)


def company_key(col: Column) -> Column:
    """Company name for matching: no accents, lower, separators to blanks, no legal words."""
    text = F.regexp_replace(F.lower(without_accents(strip(col))), "[-_.]", " ")
    return squeeze(F.regexp_replace(text, rf"(?U)\b({'|'.join(LEGAL_WORDS)})\b", ""))


def sector_key(col: Column) -> Column:
    return squeeze(F.lower(without_accents(strip(col))))


def safe_folder(col: Column) -> Column:
    """Folder-safe upper-case name."""
    text = F.regexp_replace(without_accents(strip(col)), r"(?U)[^\w\s\-]", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"{WS}+", "_"), "_+", "_")
    return F.upper(F.trim(text, F.lit("_")))


def halved_if_doubled(col: Column, min_half: int = 20) -> Column:
    """Text that is its own first half twice becomes that half."""
    half = F.floor(F.length(col) / 2).cast("int")
    left = F.substring(col, F.lit(1), half)
    return F.when((half >= min_half) & (col == F.concat(left, left)), left).otherwise(col)


YEAR_PATTERN = r"\b(20\d{2}|19\d{2})\b"


def years_in(col: Column) -> Column:
    """Distinct four-digit years of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(YEAR_PATTERN), F.lit(1)))


def contains_any(col: Column, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(col, F.lit(needle))
    return out


def first_match(col: Column, rules, default=None) -> Column:
    """Value of the first (needle, value) rule whose needle occurs in the text."""
    out = None
    for needle, value in rules:
        hit = F.contains(col, F.lit(needle))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))
