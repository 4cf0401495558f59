"""Units and French-formatted numbers as columns.

Each column reads its input once (`let` where a value is needed twice), so plans stay
small when a filter on a parsed value is moved towards the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, const_map, const_rows, let, squeeze, strip

# Unit spelling -> (unit, factor to the base currency).
UNITS: dict[str, tuple[str, float]] = {
    "mad": ("MAD", 1.0),
    "dh": ("MAD", 1.0),
    "dhs": ("MAD", 1.0),
    "dirham": ("MAD", 1.0),
    "dirhams": ("MAD", 1.0),
    "kdh": ("KMAD", 1e3),
    "kmad": ("KMAD", 1e3),
    "k mad": ("KMAD", 1e3),
    "k dh": ("KMAD", 1e3),
    "millier": ("KMAD", 1e3),
    "milliers": ("KMAD", 1e3),
    "milliers de dirhams": ("KMAD", 1e3),
    "milliers de mad": ("KMAD", 1e3),
    "kmdh": ("KMAD", 1e3),
    "k.dh": ("KMAD", 1e3),
    "mdh": ("MMAD", 1e6),
    "mmad": ("MMAD", 1e6),
    "m mad": ("MMAD", 1e6),
    "m dh": ("MMAD", 1e6),
    "m.dh": ("MMAD", 1e6),
    "mmdh": ("MMAD", 1e6),
    "million": ("MMAD", 1e6),
    "millions": ("MMAD", 1e6),
    "millions de dirhams": ("MMAD", 1e6),
    "millions de mad": ("MMAD", 1e6),
    "millions mad": ("MMAD", 1e6),
    "mio": ("MMAD", 1e6),
    "mio dh": ("MMAD", 1e6),
    "bmdh": ("BMMAD", 1e9),
    "milliard": ("BMMAD", 1e9),
    "milliards": ("BMMAD", 1e9),
    "milliards de dirhams": ("BMMAD", 1e9),
    "milliards de mad": ("BMMAD", 1e9),
    "md": ("BMMAD", 1e9),
    "%": ("%", 1.0),
    "pct": ("%", 1.0),
    "pc": ("%", 1.0),
}
# Cell texts that mean "no number".
NO_NUMBER = (
    "n/a", "na", "—", "-", "–", "néant", "nd", "ns", "/", "...", "nc", "non communiqué",
)
# Fixed value: unit words cut from the end of a number.
TRAILING_UNIT = r"milliards?|millions?|milliers?|mdh|mmad|kdh|kmad|mad|dh|%|pct|mio"

FACTOR_OF_UNIT = {"MAD": 1.0, "KMAD": 1e3, "MMAD": 1e6, "BMMAD": 1e9, "%": 1.0}

# Longest spelling first; the stable sort keeps registry order among equals.
UNITS_BY_LENGTH = sorted(UNITS, key=len, reverse=True)


def _quoted(spelling: str) -> str:
    return rf"(?<![a-z0-9]){re.escape(spelling)}(?![a-z0-9])"


def _unit_rows() -> Column:
    rows = [(s, _quoted(s), *UNITS[s]) for s in UNITS_BY_LENGTH]
    return const_rows(("spelling", "pattern", "unit", "factor"), rows)


def unit_of(text: Column, word_boundary: bool = False) -> Column:
    """struct(unit, factor) of the longest unit spelling in a text; (null, 1.0) without one.

    The default is a plain substring test; `word_boundary=True` wants whole words.
    """

    def hit(normalised):
        def test(u):
            if word_boundary:
                return F.regexp_like(normalised, u["pattern"])
            return F.contains(normalised, u["spelling"])

        return let(
            F.get(F.filter(_unit_rows(), test), F.lit(0)),
            lambda u: F.struct(u["unit"].alias("unit"), F.coalesce(u["factor"], F.lit(1.0)).alias("factor")),
        )

    return let(squeeze(F.lower(text)), hit)


# How most numbers are printed: digits in groups with an optional decimal comma, a unit word and a
# closing note; in brackets they are negative. Group 1 is the number, which needs no further care.
_DIGITS = r" *+[0-9][0-9 ]*+(?:,[0-9]++)?+"
_UNIT, _NOTE = rf" *+(?i:{TRAILING_UNIT})?", r" *+(?:\([^)0-9-]++\))?"
_PRINTED = rf"^(-?{_DIGITS}){_UNIT}{_NOTE}$"
_IN_BRACKETS = rf"^\( *+-?({_DIGITS}){_UNIT} *+\){_NOTE}$"
# Marks put into a number while its separators are sorted out.
_MARK = "\x01"


def parse_number(text: Column, nbsp_as_space: bool = False) -> Column:
    """French-formatted number to double; null when there is none.

    "1.245,50" reads comma as decimal mark, "(125)" is negative, a closing note, star or
    unit word is ignored. Non-breaking blanks inside digits fail unless `nbsp_as_space`.
    """
    if nbsp_as_space:
        text = F.translate(text, "\u00a0\u202f", "  ")
    def read(t):
        bracket = F.startswith(t, F.lit("("))
        digits = F.when(bracket, F.regexp_extract(t, _IN_BRACKETS, 1)).otherwise(F.regexp_extract(t, _PRINTED, 1))
        number = lambda d: F.concat(F.when(bracket, "-").otherwise(""), F.translate(d, ", ", ".")).try_cast("double")
        # No rule of `_parse_any` makes a number of a text without digits.
        return let(digits, lambda d: F.when(d != "", number(d)).when(F.regexp_like(t, F.lit("[0-9]")), _parse_any(t)))

    return let(strip(text), read)


def _parse_any(x: Column) -> Column:
    words = "|".join(re.escape(w) for w in NO_NUMBER)
    x = F.regexp_replace(x, rf"(?iu)^({words})$", "")
    x = F.regexp_replace(x, rf"{WS}*\([^)0-9-]+\){WS}*$", "")
    x = strip(F.regexp_replace(x, rf"\*+{WS}*$", ""))
    # Parentheses and a leading minus both mean "negative of the absolute value".
    x = F.regexp_replace(x, rf"(?s)^\({WS}*-?{WS}*(.*)\)$", "-$1")
    x = F.regexp_replace(x, rf"(?i){WS}*({TRAILING_UNIT})?{WS}*$", "")
    x = F.regexp_replace(x, rf"^-{WS}*[+-]?", "-")
    x = F.replace(x, F.lit(" "), F.lit(""))
    # One comma is the decimal mark and makes dots thousands marks; so do two dots alone.
    x = F.regexp_replace(x, r"^([^,]*),([^,]*)$", f"$1{_MARK}$2{_MARK}")
    x = F.regexp_replace(x, rf"^([^,{_MARK}.]*\.[^,{_MARK}.]*\.[^,{_MARK}]*)$", f"$1{_MARK}")
    x = F.regexp_replace(x, rf"\.(?=[^{_MARK}]*{_MARK})", "")
    x = F.regexp_replace(x, rf"\.(?=.*{_MARK})", "")
    x = F.regexp_replace(x, rf"{_MARK}(?=.*{_MARK})", ".")
    x = F.translate(x, f",{_MARK}", "")
    plain = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return F.regexp_extract(x, plain, 0).try_cast("double")


def parse_value(text: Column, context_unit: Column | None = None) -> Column:
    """struct(value, unit, factor, is_negative, is_percentage, confidence) of a cell text.

    The unit is the one inside the cell, else the context unit; a percentage mark wins.
    """
    context = F.lit(None) if context_unit is None else context_unit
    context = F.nullif(context.cast("string"), F.lit(""))
    unit_by_spelling = const_map({s: unit for s, (unit, _) in UNITS.items()})
    factor_by_spelling = const_map({s: factor for s, (_, factor) in UNITS.items()})

    def resolve(s):
        inline = unit_of(s["raw"])
        pct = F.contains(s["raw"], F.lit("%")) | F.regexp_like(s["raw"], F.lit(r"(?iU)\bpct\b|\bpc\b"))
        return let(
            F.struct(
                parse_number(s["raw"]).alias("value"),
                inline.alias("inline"),
                pct.alias("pct"),
                strip(F.lower(s["context"])).alias("spelling"),
                s["context"].alias("context"),
            ),
            finish,
        )

    def finish(p):
        inside = p["inline"]["unit"].isNotNull()
        unit = (
            F.when(p["pct"], F.lit("%"))
            .when(inside, p["inline"]["unit"])
            .otherwise(F.coalesce(F.element_at(unit_by_spelling, p["spelling"]), p["context"]))
        )
        factor = (
            F.when(p["pct"], F.lit(1.0))
            .when(inside, p["inline"]["factor"])
            .otherwise(F.coalesce(F.element_at(factor_by_spelling, p["spelling"]), F.lit(1.0)))
        )
        return F.struct(
            p["value"].alias("value"),
            unit.alias("unit"),
            factor.alias("factor"),
            F.coalesce(p["value"] < 0, F.lit(False)).alias("is_negative"),
            p["pct"].alias("is_percentage"),
            F.when(p["value"].isNull(), 0.0).when(unit.isNull(), 0.7).otherwise(1.0).alias("confidence"),
        )

    return let(F.struct(strip(text).alias("raw"), context.alias("context")), resolve)
