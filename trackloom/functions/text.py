"""Text functions as column expressions; Python is used only for compatibility forms of non-ASCII values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"
# Bracketed noise, words without weight, and hints of a series.
BRACKETS = r"\(.*?\)(?!bp single track).*?|\[.*?\]|\{.*?\}"
JUNK = "ep remix mix version edit original single album live feat featuring vs vol pt part deluxe remastered remaster bonus instrumental mono stereo".split()
SERIES = ("adult only", "new path", "fafep010", "signatune core", "nuances de nuit")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: Column | str) -> Column:
    """Lower case, every run of blanks one space, none at the ends; null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), BLANKS, " "))


def strip(c: Column | str) -> Column:
    """Without Unicode blanks at the ends."""
    return F.regexp_replace(col(c), rf"^{BLANKS}|{BLANKS}$", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column | str) -> Column:
    """Compatibility form; ASCII values never leave the JVM's batch as text."""
    odd = F.when(col(c).rlike(r"[^\x00-\x7F]"), col(c))
    return F.coalesce(_nfkc(odd), col(c))


def canon(c: Column | str, ascii_only: bool = False) -> Column:
    """Title form for scoring: letters a-z, digits and apostrophes, bracketed noise gone; null gives the empty string."""
    s = F.lower(F.coalesce(col(c) if ascii_only else nfkc(c), F.lit("")))
    s = F.regexp_replace(s, r"[&+]", " and ")
    s = F.translate(s, "|`", " '")
    s = F.regexp_replace(s, BRACKETS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9' ]+", " "), " +", " "))


def words(c: Column | str) -> Column:
    """Words between single spaces, none of an empty text."""
    return F.filter(F.split(col(c), " "), lambda w: w != "")


def core(c: Column | str) -> Column:
    """Words of a canonical text that carry weight."""
    return F.filter(words(c), lambda w: ~w.isin(*JUNK))


def junk(c: Column | str) -> Column:
    return F.filter(words(c), lambda w: w.isin(*JUNK))


def index_words(c: Column | str) -> Column:
    """Distinct blank-separated words of more than two characters, as the index has them."""
    return F.array_distinct(F.filter(F.split(col(c), BLANKS), lambda w: F.length(w) > 2))


def query_words(c: Column | str) -> Column:
    """Distinct runs of a-z and 0-9 of more than two characters, as queries are cut."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)")), lambda w: F.length(w) > 2))
