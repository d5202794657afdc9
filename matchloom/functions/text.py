"""Text expressions of the normaliser: all of them stay in Catalyst, but for full Unicode folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letters that folding rewrites before it strips marks, and accented letters with their bases.
LIGATURES = {"œ": "oe", "æ": "ae", "ø": "o", "ß": "ss", "đ": "d", "ł": "l", "&": " and ", "’": "", "'": ""}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Spelling variants merged by the squash, in this order.
SQUASH = (("ph", "f"), ("ck", "k"), ("sh", "s"), ("th", "t"), ("bh", "b"), ("dh", "d"), ("kh", "k"), ("gh", "g"), ("w", "v"), ("z", "s"), ("q", "k"), ("c", "k"), ("y", "i"), ("x", "ks"))
NON_LATIN = r"[Ͱ-῿Ⰰ-￿]"


def bucket(value: Column, salt: str, buckets: int) -> Column:
    """A number below buckets from the first 32 bits of the MD5 of value and salt; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(value.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long") % buckets


@F.pandas_udf(StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    """NFKD without marks; Catalyst has no such expression."""
    return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M"))


def _spelled(char: str) -> str:
    """A Latin spelling of one character by its Unicode name: the last word of "... LETTER X" names."""
    if char.isascii():
        return char
    base = unicodedata.normalize("NFKD", char)
    if base.isascii():
        return base
    if char.isdigit():
        return str(unicodedata.digit(char))
    name = unicodedata.name(char, "")
    if unicodedata.category(char)[0] == "M":
        sign = name.rpartition("VOWEL SIGN ")[2] if "VOWEL SIGN" in name else ""
        return sign.split(" ")[-1].lower()
    for mark in ("LETTER ", "SYLLABLE "):
        if mark in name:
            return name.rpartition(mark)[2].split(" WITH ")[0].split(" ")[-1].lower()
    return char if char.isalnum() else " "


def _vowel_ends(text: str) -> str:
    """Indic consonants carry an inherent A, which a vowel sign or virama after them replaces."""
    out: list[str] = []
    for char in text:
        spelled, name = _spelled(char), unicodedata.name(char, "")
        if ("VOWEL SIGN" in name or "VIRAMA" in name) and out and out[-1].endswith("a") and len(out[-1]) > 1:
            out[-1] = out[-1][:-1]
        out.append(spelled)
    return "".join(out)


@F.pandas_udf(StringType())
def spell_latin(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else _vowel_ends(x))


def transliterate(value: Column) -> Column:
    """Only rows with letters beyond Latin scripts are respelled."""
    return F.when(value.rlike(NON_LATIN), spell_latin(value)).otherwise(value)


def fold(value: Column, unicode: bool = False) -> Column:
    """Lower case, ligatures written out, accents dropped; unicode: all marks, by an Arrow function."""
    out = F.lower(value)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip_marks(out) if unicode else F.translate(out, ACCENTED, PLAIN)


def tokens(value: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "), lambda t: t != "")


def squash(value: Column) -> Column:
    """Merges common spelling variants, then repeated letters."""
    for a, b in SQUASH:
        value = F.replace(value, F.lit(a), F.lit(b))
    return F.regexp_replace(value, r"([a-z])\1+", "$1")


def grams(value: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own n-gram, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) - n + 1)), lambda i: F.substring(value, i, F.lit(n)))
    return F.when(F.length(value) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Null if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared words by those of the smaller set; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))
