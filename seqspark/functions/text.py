"""Scalar helpers used when messages become events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric codes of the three letter types.
SYMBOLS = {0: "a", 1: "b", 2: "c"}


def parse_event_time(col, fmt: str = "yyyy-MM-dd'T'HH:mm:ss", tz: str = "EET") -> Column:
    """Text to instant in zone ``tz``; null when the text does not parse."""
    text = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.concat(text, F.lit(" " + tz)), F.lit(fmt + " VV"))


def capitalise_source(col) -> Column:
    """First letter upper case, the rest unchanged."""
    text = F.col(col) if isinstance(col, str) else col
    return F.concat(F.upper(text.substr(1, 1)), text.substr(F.lit(2), F.length(text)))


def map_symbol(col) -> Column:
    """0/1/2 to a/b/c, anything else to 'unknown'."""
    code = F.col(col) if isinstance(col, str) else col
    out = F.lit("unknown")
    for number, letter in SYMBOLS.items():
        out = F.when(code == number, letter).otherwise(out)
    return out


def unmap_symbol(col) -> Column:
    """a/b/c to 0/1/2; any other symbol is an error."""
    letter = F.col(col) if isinstance(col, str) else col
    out = F.raise_error(F.concat(F.lit("Unknown symbol: "), F.coalesce(letter, F.lit("null")))).cast("int")
    for number, known in SYMBOLS.items():
        out = F.when(letter == known, number).otherwise(out)
    return out


def digits(col) -> Column:
    """The number inside a text such as ``node17``; null when it holds no digit."""
    text = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).cast("int")
