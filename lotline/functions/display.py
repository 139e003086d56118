"""Report formatting column builders: ISO timestamps, money and number
formats, relative age labels, HTML escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """ISO-8601 text; the fraction is written only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == "000000", whole).otherwise(F.concat(whole, F.lit("."), frac))


def fmt_price(p: Column) -> Column:
    """'$12,345' rounded half away from zero; 0 and NULL -> '-'."""
    return F.when(p.isNull() | (p == 0), F.lit("-")).otherwise(
        F.concat(F.lit("$"), F.format_number(F.round(p, 0), 0)))


def fmt_number(n: Column) -> Column:
    """Grouped integer text; 0 and NULL -> '-'."""
    return F.when(n.isNull() | (n == 0), F.lit("-")).otherwise(F.format_number(n, 0))


def age_label(ts: Column, as_of) -> Column:
    """'Just now' under an hour, 'Nh ago' under a day, 'Nd ago' under a
    week, else the date as M/D/YYYY."""
    as_of = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    diff_us = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    hours = F.floor(diff_us / F.lit(3_600_000_000))
    days = F.floor(hours / 24)
    return (F.when(hours < 1, F.lit("Just now"))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(ts, "M/d/yyyy")))


def escape_html(s: Column) -> Column:
    """Text-node escaping: & < > and no-break space."""
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit("\u00a0"), F.lit("&nbsp;"))


def or_placeholder(s: Column, placeholder: str) -> Column:
    """``value || placeholder``: empty or NULL text gives the placeholder."""
    return F.when(s.isNull() | (s == ""), F.lit(placeholder)).otherwise(s)


def report_columns() -> list[Column]:
    """Columns of the listing report: placeholders for empty values,
    formatted price and miles, HTML-escaped text."""
    c = F.col
    return [
        escape_html(or_placeholder(c("dealer"), "")).alias("dealer"),
        escape_html(or_placeholder(c("title"), "")).alias("title"),
        F.when(c("year").isNull() | (c("year") == 0), F.lit("-")).otherwise(c("year").cast("string")).alias("year"),
        fmt_price(c("price")).alias("price"),
        fmt_number(c("odometer")).alias("miles"),
        escape_html(or_placeholder(c("ext_color"), "-")).alias("ext_color"),
        escape_html(or_placeholder(c("vin"), "")).alias("vin"),
        escape_html(or_placeholder(c("dealer_platform"), "")).alias("platform"),
        escape_html(or_placeholder(c("source_url"), "#")).alias("link"),
    ]
