"""Terms: "|" separates synonyms, "&" joins words that must occur together; the first synonym names the term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical(term: Column) -> Column:
    """The first synonym that is not blank, squeezed; empty for null and blank terms."""
    parts = F.filter(F.transform(F.split(term.cast("string"), r"\|"), squeezed), lambda x: x != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def display(term: Column) -> Column:
    """The canonical form with "&" as a space."""
    return squeezed(F.replace(canonical(term), F.lit("&"), F.lit(" ")))


def filename(term: Column, longest: int = 80) -> Column:
    """The canonical form cut to `longest` characters, with "/" as "_"."""
    return F.replace(F.substring(canonical(term), 1, longest), F.lit("/"), F.lit("_"))


def with_suffix(term: Column, suffix: str) -> Column:
    return F.concat(term, F.lit(suffix)) if suffix else term


def short_label(term: Column, default: str) -> Column:
    """The first word of the first synonym."""
    word = F.split_part(F.split_part(term, F.lit("|"), F.lit(1)), F.lit(" "), F.lit(1))
    return F.coalesce(F.nullif(word, F.lit("")), F.lit(default))


def alternatives(term: Column) -> Column:
    """array<array<string>>: any of these lists, all of its words, lower-cased."""
    return F.transform(
        F.filter(F.transform(F.split(F.lower(term), r"\|"), squeezed), lambda x: x != ""),
        lambda x: F.filter(F.transform(F.split(x, "&"), squeezed), lambda y: y != ""),
    )


def model_name(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def result_name(name: Column) -> Column:
    """Characters that result file names do not keep, as "_"."""
    return F.regexp_replace(name, r"[,\[\] ']", "_")
