"""Vehicle title parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The title patterns and the defaults used when they do not match.
YEAR_RE = r"^\s*(\d{4})"
MAKE_RE = r"(?i)\d{4}\s+(BMW|Mercedes-Benz|Audi|Lexus|[A-Z][a-z]+)"
MODEL_RE = r"(X\d|[A-Z]\d+|[A-Z][a-z]+\s+[A-Z]\d+)"
DEFAULT_MAKE = "BMW"
DEFAULT_MODEL = "X3"
# First 'BMW' word (any case) with the whitespace after it; anchored with a
# lazy prefix so that a replace-all still removes only the first occurrence.
FIRST_MAKE_WORD_RE = r"(?s)^(.*?)(?i:BMW\s*)"


def strip_ws(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def remove_first_literal(s: Column, piece: Column) -> Column:
    """Remove the first occurrence of ``piece`` taken literally (no pattern)."""
    pos = F.call_function("instr", s, piece)
    head = F.call_function("substr", s, F.lit(1), pos - 1)
    tail = F.call_function("substr", s, pos + F.length(piece))
    return F.when(pos > 0, F.concat(head, tail)).otherwise(s)


def parse_title(title: Column) -> Column:
    """Title -> struct(year int, make, model, trim).

    year: four digits at the start; make: the word after the first four-digit
    run (case-insensitive); model: leftmost code such as X3 / M60 / 'Sport X5'.
    trim: the title minus the leading year, minus the first 'BMW' word (only
    when a make was found), minus the first occurrence of the model text,
    stripped; empty -> NULL.  Defaults: make BMW, model X3, year and trim NULL.
    """
    t = F.coalesce(title, F.lit(""))
    year_txt = F.regexp_extract(t, YEAR_RE, 1)
    year_all = F.regexp_extract(t, r"^\s*\d{4}", 0)
    make_txt = F.regexp_extract(t, MAKE_RE, 1)
    model_txt = F.regexp_extract(t, MODEL_RE, 1)

    s = F.when(year_txt != "", F.call_function("substr", t, F.length(year_all) + 1)).otherwise(t)
    s = F.when(make_txt != "", F.regexp_replace(s, FIRST_MAKE_WORD_RE, "$1")).otherwise(s)
    s = F.when(model_txt != "", remove_first_literal(s, model_txt)).otherwise(s)
    trim = strip_ws(s)
    return F.struct(
        F.when(year_txt != "", year_txt.cast("int")).alias("year"),
        F.when(make_txt != "", make_txt).otherwise(F.lit(DEFAULT_MAKE)).alias("make"),
        F.when(model_txt != "", model_txt).otherwise(F.lit(DEFAULT_MODEL)).alias("model"),
        F.when(trim != "", trim).alias("trim"),
    )
