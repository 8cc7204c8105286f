"""Label and number expressions: keys, tokens, readable names, metric texts."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.fixed import DOWN_WORDS, UP_WORDS


def normalise_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value.cast("string")), r"[^a-z0-9]+", " "))


def label_tokens(value: Column) -> Column:
    return F.filter(F.split(normalise_key(value), " "), lambda t: t != "")


def humanize_label(value: Column) -> Column:
    """Title-cased tokens; a letter after a digit is also a word start."""
    key = normalise_key(value)
    marked = F.regexp_replace(key, r"([0-9])([a-z])", "$1\u0001 $2")
    title = F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
    return F.when(key == "", value.cast("string")).otherwise(title)


def column_key(name: str) -> str:
    """``normalise_key`` for a column name known on the driver."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def column_label(name: str) -> str:
    """``humanize_label`` for a column name known on the driver."""
    return column_key(name).title() or name


def token_overlap(left: Column, right: Column) -> Column:
    """Shared distinct items over the larger distinct set; 0 when a side is empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def percentage_change(start: Column, end: Column) -> Column:
    return F.try_divide(end - start, F.abs(start)) * 100.0


def trend_direction(pct: Column, slope: Column) -> Column:
    return (
        F.when(pct > 3, "rising").when(pct < -3, "falling")
        .when(slope > 0, "rising").when(slope < 0, "falling").otherwise("stable")
    )


def text_direction(sentences: Column) -> Column:
    """Direction named by the sentences: only up words, only down words, else null."""
    found = F.split(normalise_key(F.array_join(sentences, " ")), " ")
    up = F.arrays_overlap(found, F.array(*map(F.lit, UP_WORDS)))
    down = F.arrays_overlap(found, F.array(*map(F.lit, DOWN_WORDS)))
    return F.when(up & ~down, "rising").when(down & ~up, "falling")


def fixed_text(value: Column, decimals: int) -> Column:
    """Plain decimal text without group marks, rounded half to even."""
    return F.replace(F.format_number(value.cast("double"), decimals), F.lit(","), F.lit(""))


def signed_text(value: Column, decimals: int) -> Column:
    text = fixed_text(value, decimals)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def grouped_text(value: Column, decimals: int = 2) -> Column:
    return F.format_number(value.cast("double"), decimals)


def format_metric(value: Column, decimals: int = 1) -> Column:
    number = value.cast("double")
    size = F.abs(number)
    return (
        F.when(number.isNull() | F.isnan(number), "N/A")
        .when(size >= 1_000_000, F.concat(fixed_text(number / 1_000_000, decimals), F.lit("M")))
        .when(size >= 1_000, F.concat(fixed_text(number / 1_000, decimals), F.lit("K")))
        .when(number == F.floor(number), F.format_number(number, 0))
        .otherwise(F.format_number(number, decimals))
    )
