"""Lengths, lines and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset: line feeds before it count."""
    before = F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("long")


def utc_day(seconds: Column) -> Column:
    """YYYY-MM-DD of epoch seconds, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
