"""Text normalisation and guards as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 2000


def normalize(text: Column) -> Column:
    """Lower case after the Turkish dotless rule for capital I."""
    return F.lower(F.replace(text, F.lit("I"), F.lit("ı")))


def normalize_by_language(text: Column) -> Column:
    """The Turkish rules only where the text has Turkish letters."""
    turkish = F.lower(F.replace(F.replace(text, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))
    return F.when(text.rlike("[çğıöşüÇĞİÖŞÜ]"), turkish).otherwise(F.lower(text))


def guard(text: Column) -> Column:
    """At most MAX_CHARS characters; null where nothing but white space is left."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, MAX_CHARS)
    return F.when(~cut.rlike(r"(?U)^\s*$"), cut)


def joined_title(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))


def token_window(tokens: Column, length: int = 96, pad: object = 0) -> Column:
    """The first `length` tokens, filled up with pad, and a mask of ones for real tokens: an encoder's input of fixed size."""
    kept = F.slice(tokens, 1, length)
    missing = F.lit(length) - F.size(kept)
    return F.struct(F.concat(kept, F.array_repeat(F.lit(pad), missing)).alias("tokens"), F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), missing)).alias("mask"))
