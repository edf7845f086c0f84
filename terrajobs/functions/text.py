"""Columns that normalise place names, addresses and numbers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrajobs.functions import names


@lru_cache(maxsize=1)
def _ascii_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters whose compatibility decomposition has one ASCII character, those characters, and (letter, text) for longer ones."""
    ranges = (range(0x80, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0x2150, 0x2160), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
    one, to, more = [], [], []
    for code in (c for r in ranges for c in r):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(code))
            to.append(plain)
        elif plain:
            more.append((chr(code), plain))
    return "".join(one), "".join(to), tuple(more)


def literal_map(pairs) -> Column:
    """A map of strings, as one expression: cheaper to build than a literal an entry."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(a)}, {quoted(b)}" for a, b in pairs) + ")")


def _with(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _plain(col: Column) -> Column:
    one, to, more = _ascii_table()
    longer = literal_map(more)
    spelled = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(longer, x), x)), "")
    return F.regexp_replace(F.translate(spelled(col), one, to), r"[^\x00-\x7F]", "")


def to_ascii(col: Column) -> Column:
    """Letters without their accents; what is then not ASCII goes. Text that is ASCII already is not looked at."""
    return _with(col, lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), _plain(c)).otherwise(c))


def _spaced(col: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s]", " ")), r"\s+", " ")


def simple_name(col: Column) -> Column:
    """Lower case, punctuation as single spaces, no accents; null stays null."""
    return to_ascii(_spaced(col))


def _swap(col: Column) -> Column:
    pairs = literal_map(names.ACCENT_EXCEPTIONS.items())
    return _with(col, lambda c: F.coalesce(F.try_element_at(pairs, c), c))


def clean_name(col: Column | str) -> Column:
    """The key form of a place name: lower case, punctuation as single spaces, no accents.

    Two comuni that an accent alone tells apart swap names before and after accents go, so they stay apart. Null and empty
    names are null. Characters that vanish with the accents may leave two spaces.
    """
    col = F.col(col) if isinstance(col, str) else col
    return _with(col, lambda c: F.when(c == "", F.lit(None).cast("string")).otherwise(_swap(to_ascii(_swap(_spaced(c))))))


def strip_area_prefix(col: Column, level: str) -> Column:
    """Remove the literal prefixes of province or comune names, wherever they stand."""
    for prefix in names.PROVINCE_PREFIXES if level == "provincia" else names.COMUNE_PREFIXES if level == "comune" else ():
        col = F.replace(col, F.lit(prefix), F.lit(""))
    return col


def english_to_italian(col: Column) -> Column:
    """Whole names in English (or German) as in Italian; others stay."""
    italian = literal_map(names.FOREIGN_NAMES.items())
    return _with(col, lambda c: F.coalesce(F.try_element_at(italian, c), c))


def loose_key(col: Column) -> Column:
    """A second-chance key: small words and saint forms made alike by ordered substitutions."""
    for old, new in names.LOOSE_SUBSTITUTIONS:
        col = F.replace(col, F.lit(old), F.lit(new))
    return F.regexp_replace(col, r"\s+", " ")


def identifier_kind(df: DataFrame, column: str) -> str:
    """``code``, ``sigla`` or ``name``: what over 80 % of the distinct values look like.

    A numeric column is ``code`` without reading it; an empty one is ``name``. One row comes to the driver.
    """
    if isinstance(df.schema[column].dataType, T.NumericType):
        return "code"
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    share = identifier_shares(values).first()
    if (share["numeric"] or 0) > 0.8:
        return "code"
    return "sigla" if (share["letters"] or 0) > 0.8 else "name"


def identifier_shares(values: DataFrame) -> DataFrame:
    """One row: shares of all-digit and of two-letter values of column ``v``."""
    return values.agg(
        F.avg(F.col("v").rlike(r"^[0-9]+$").cast("double")).alias("numeric"), F.avg(F.col("v").rlike(r"^\p{L}{2}$").cast("double")).alias("letters")
    )


def human_format(col: Column) -> Column:
    """Two significant digits with K, M, B or T; zero is 0, null null."""
    size = F.abs(col)
    digits = F.floor(F.log10(F.when(size > 0, size)))
    step = F.pow(F.lit(10.0), digits - 1)
    rounded = F.when(size > 0, F.bround(col / step) * step).otherwise(F.lit(0.0))
    power = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.log10(F.greatest(F.abs(rounded), F.lit(1.0)) * (1 + 1e-12)) / 3))).cast("int")
    scaled = rounded / F.pow(F.lit(1000.0), power)
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", scaled), r"0+$", ""), r"\.$", "")
    return F.when(col.isNotNull(), F.concat(number, F.element_at(F.array(*map(F.lit, ["", "K", "M", "B", "T"])), power + 1)))


def address_parts(col: Column) -> dict[str, Column]:
    """Cleaned parts of "[comune2, ]comune1, provincia, regione[, cap], Italia"; null where the address is otherwise."""
    parts = F.split(col, ", ")
    # A post code of five digits may stand before the country.
    top = F.size(parts) - F.when(F.get(parts, F.size(parts) - 2).rlike("^[0-9]{5}$"), 3).otherwise(2)
    fits = F.element_at(parts, -1).startswith("Italia") & (top >= 2) & ~F.get(parts, top).rlike("[0-9]")
    part = lambda back: F.when(fits, F.get(parts, top - back))
    province = clean_name(F.replace(part(1), F.lit("Roma Capitale"), F.lit("Roma")))
    return {"comune2": clean_name(part(3)), "comune1": clean_name(part(2)), "provincia": province, "regione": clean_name(part(0))}
