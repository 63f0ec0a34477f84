"""Token functions and set distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the token pattern.
TOKEN = r"\b[a-zA-Z0-9_\-\$]+\b"


def ascii_only(text: Column) -> Column:
    """Other characters become '_', so that all engines see the same word bounds."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "_")


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order; null or empty text: no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |A n B| / |A u B|, 4 decimals; both empty 0, one empty 1."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(F.round(1 - both / either, 4))


def preservation(a: Column, b: Column) -> Column:
    """|A n B| / |A| over distinct tokens, 4 decimals; null if A is empty."""
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)), 4))


def loss(a: Column, b: Column) -> Column:
    return F.round(1 - preservation(a, b), 4)


def stamp(seconds: Column) -> Column:
    """MM:SS, minutes may exceed two digits."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def frame_seconds(name: Column, fallback: Column) -> Column:
    """Seconds in a frame's name: frame_<n>, else the first digits, else the fallback."""
    first = F.nullif(F.regexp_extract(name, r"(?i)frame_(\d+)", 1), F.lit(""))
    any_ = F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit(""))
    return F.coalesce(first, any_, fallback.cast("string")).cast("int")


def block_type(text: Column) -> Column:
    """formula or text, by what the characters are; null is text.

    A character counts as the first of: mathematical symbol or Greek, letter,
    digit.  Rules in order: an equals sign; more digits and mathematical
    characters than letters; some of the latter with under five letters; at
    most six characters with a digit and at most two letters.
    """
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(""))
    count = lambda cls: F.length(clean) - F.length(F.regexp_replace(clean, cls, ""))
    math, letters, digits = count(r"[\p{Sm}\x{0370}-\x{03FF}]"), count(r"[\p{L}&&[^\x{0370}-\x{03FF}]]"), count(r"[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]")
    formula = F.contains(clean, F.lit("=")) | (digits + math > letters) | ((math > 0) & (letters < 5)) | ((F.length(clean) <= 6) & (digits > 0) & (letters <= 2))
    return F.when((clean != "") & formula, "formula").otherwise("text")
