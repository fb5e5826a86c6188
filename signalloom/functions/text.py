"""Scalar functions on names, parties and run names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters whose marks stay.
GERMAN = "äöüÄÖÜß"
#: Party names and the patterns that stand for them; a later rule wins over an earlier one.
PARTY_RULES = [
    ("SPD", r"SPD|SOZIALDEMOKRATISCHE\s+PARTEI\s+DEUTSCHLANDS?"),
    ("CDU", r"CDU|CHRISTLICH[ -]?DEMOKRATISCHE[ -]?UNION"),
    ("CSU", r"CSU|CHRISTLICH[ -]?SOZIALE[ -]?UNION"),
    ("CDU/CSU", r"CDU/CSU|UNION"),
    ("GRÜNE", r"BÜNDNIS\s*90\s*/?\s*DIE\s*GRÜNEN?|BÜ90/GR|GRÜN[E]?|GRUENE|BÜNDNIS`90/DIE GRÜNEN"),
    ("FDP", r"FDP|FREIE[ -]?DEMOKRATISCHE[ -]?PARTEI"),
    ("LINKE", r"DIE\s+LINKE\.?|LINKS?PARTEI(?:\.PDS)?|LINKE"),
    ("AFD", r"AFD|ALTERNATIVE[ -]?FÜR[ -]?DEUTSCHLAND"),
    ("BSW", r"BSW"),
    ("fraktionslos", r"fraktionslose?"),
]
_SHIELDED = re.compile(f"([{GERMAN}]+)")
_MARKS = regex.compile(r"\p{Mn}+")


def _strip(text: str | None) -> str | None:
    """Take the marks off everything between German letters.  A letter that is written as base and mark
    loses the mark, German or not."""
    if text is None or text.isascii():
        return text
    pieces = _SHIELDED.split(text)
    pieces[::2] = [unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", x))) for x in pieces[::2]]
    return "".join(pieces)


def strip_accents(col: Column) -> Column:
    """Remove all accents but the German ones.  Catalyst has no normaliser: an Arrow UDF."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(_strip)

    return run(col)


def canonical_party(col: Column, rules: list[tuple[str, str]] = PARTY_RULES) -> Column:
    """Party name by anchored, case-insensitive rules, the last match first; others unchanged."""
    out = None
    for name, pattern in reversed(rules):
        hit = col.rlike(rf"(?iu)^\s*(?:{pattern})\.?\s*$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(col)


def drop_last_token(col: Column) -> Column:
    return F.regexp_replace(col, " [^ ]*$", "")


def file_date(col: Column) -> Column:
    """Date of a file name that begins with eight digits; else null."""
    return F.try_to_date(F.regexp_extract(col, r"^(\d{8})", 1), "yyyyMMdd")


def numbers_in(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"(\d+)"), 1).cast("array<double>")


def algorithm_name(col: Column) -> Column:
    """Which algorithm a configuration's name stands for."""
    return F.when(col.contains("gaia"), "GAIA").otherwise("VENUS")


def level_of(col: Column, levels: list[str]) -> Column:
    """Place of a value among ordered levels, from 0; null for others."""
    out = F.lit(None).cast("int")
    for i, level in enumerate(levels):
        out = F.when(col == level, i).otherwise(out)
    return out


def mean_and_sd(mean: Column, sd: Column, digits: int = 1) -> Column:
    """``mean p sd`` with separators of thousands; what is left of a missing deviation is ``NA``."""
    pattern = "#,##0." + "#" * digits if digits else "#,##0"
    shown = lambda c: F.call_function("format_number", F.round(c, digits), F.lit(pattern))
    return F.concat(shown(mean), F.lit(" p "), F.coalesce(shown(sd), F.lit("NA")))
