"""Several values packed in one field: one row a value with its position.

The dialect of a field (which separators split it, and whether pieces are quoted) is the one
with the shortest description: each piece costs the code length of its value in a code book of
values that occur alone, log2(N / n), each separator kind and each cut cost bits, and the field
left whole costs its characters. Code lengths come from a distributed count by a join; the
cheapest parse of a field is found by dynamic programming over its separators.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from trackloom.operators.widen import KEYS

SEPARATOR = re.compile(r"\\\\|[;|/,·\n\r\x00&+•、]|(?<=\s)(?:feat\.?|ft\.?|featuring|vs\.?|x|×|and|with|und|et)(?=\s)", re.IGNORECASE)
HINT = r"(?i)\\\\|[;|/,·\n\r\x00&+•、]|\s(feat\.?|ft\.?|featuring|vs\.?|x|×|and|with|und|et)\s"
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’"}
#: Values of up to so many separators are looked up from the fields' pieces, longer ones from the code book; bits for a separator kind, a cut, a quoted piece and a character.
INNER, KIND, CUT, QUOTED, CHAR = 8, 3.0, 1.0, 1.0, 5.0
PIECES = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("value", T.StringType())]))
#: Usual names of the tags that may pack values; those of artist and genre are the wide table's.
MULTI_KEYS = tuple(dict.fromkeys(f"{KEYS['artist']} artists {KEYS['genre']} genres composer composers composername tcom wrt performer performers performername mood moods tmoo language languages languagename lang tlan".split()))


def bare(piece: str) -> tuple[str, bool]:
    """A piece without surrounding blanks and one pair of quotes; whether it was quoted."""
    p = piece.strip()
    if len(p) > 1 and QUOTES.get(p[0]) == p[-1]:
        return p[1:-1].strip(), True
    return p, False


def cuts(text: str) -> list[tuple[int, int]]:
    return [(0, 0), *(m.span() for m in SEPARATOR.finditer(text)), (len(text), len(text))]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            at = cuts(text)
            for i in range(len(at) - 1):
                for j in range(i + 1, min(len(at), i + INNER + 2)):
                    if j - i < len(at) - 1 and (p := bare(text[at[i][1] : at[j][0]])[0]):
                        rows.append((text, i, j, p))
        yield pd.DataFrame(rows, columns=["text", "i", "j", "piece"])


def head(text: str, at: list[tuple[int, int]], i: int) -> str:
    """Start of what follows cut i, over ``INNER + 1`` pieces, by which longer values are found."""
    return text[at[i][1] : at[i + INNER + 1][0]].strip().lstrip("".join(QUOTES)).strip().lower()


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starts of possible long values at each cut of a text."""
    for pdf in batches:
        rows = [(t, i, head(t, at, i)) for t in pdf["text"] for at in [cuts(t)] for i in range(len(at) - INNER - 1)]
        yield pd.DataFrame(rows, columns=["text", "i", "head"])


def _long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of the code book with more than ``INNER`` separators, by their start."""
    for pdf in batches:
        rows = [(head(k, at, 0), k, n) for k, n in zip(pdf["key"], pdf["n"]) for at in [cuts(k)] if len(at) > INNER + 2]
        yield pd.DataFrame(rows, columns=["head", "key", "n"])


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, i, j, n) where a long value stands between two cuts of a text."""
    for pdf in batches:
        rows = []
        for text, i, key, n in zip(pdf["text"], pdf["i"], pdf["key"], pdf["n"]):
            at = cuts(text)
            for j in range(i + INNER + 2, len(at)):
                if j - i < len(at) - 1 and bare(text[at[i][1] : at[j][0]])[0].strip().lower() == key:
                    rows.append((text, i, j, n))
        yield pd.DataFrame(rows, columns=["text", "i", "j", "n"])


def shortest(text: str, known: dict[tuple[int, int], float]) -> list[str]:
    """Pieces of the cheapest parse with at least two values; empty if the field left whole is cheaper.

    ``known`` has the code length of the piece between two separators. State: separator kinds used so far.
    """
    at = cuts(text)
    best: list[dict[frozenset, tuple[float, int, tuple]]] = [{} for _ in at]
    best[0][frozenset()] = (0.0, 0, ())
    far: dict[int, list[int]] = {}
    for i, j in known:
        if j - i > INNER + 1:
            far.setdefault(j, []).append(i)
    for j in range(1, len(at)):
        for i in (*sorted(far.get(j, ())), *range(max(0, j - INNER - 1), j)):
            p, quoted = bare(text[at[i][1] : at[j][0]])
            if p and (i, j) not in known or not p and j - i > 1 or i == 0 and j == len(at) - 1:
                continue
            kind = text[slice(*at[j])].lower()
            for kinds, (cost, n, own) in best[i].items():
                after = kinds | {kind} if kind else kinds
                c = cost + (known[i, j] + QUOTED * quoted if p else 0.0) + CUT + KIND * (len(after) - len(kinds))
                if after not in best[j] or c < best[j][after][0]:
                    best[j][after] = (c, n + bool(p), (*own, p) if p else own)
    whole = CHAR * len(text)
    parse = min((v for v in best[-1].values() if v[1] >= 2), key=lambda v: (v[0], v[2]), default=None)
    return list(parse[2]) if parse and parse[0] < whole else []


@F.pandas_udf(PIECES)
def _parse(texts: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, known):
        values = shortest(text, {(k["i"], k["j"]): math.log2(max(2.0, k["total"] / k["n"])) for k in own})
        out.append([{"pos": n, "value": v} for n, v in enumerate(values, 1)])
    return pd.Series(out)


def code_book(alone: DataFrame, fields: DataFrame) -> DataFrame:
    """(key, n): values that occur alone, lower case, with the number of whole fields that hold them."""
    key = F.lower(F.trim("text")).alias("key")
    n = fields.select(key).groupBy("key").agg(F.count("*").alias("n"))
    return alone.select(key).distinct().join(n, "key", "left").select("key", F.coalesce("n", F.lit(1)).alias("n"))


def parses(texts: DataFrame, book: DataFrame) -> DataFrame:
    """(text, pieces) of each distinct text that packs at least two values of the code book."""
    odd = texts.where(F.col("text").rlike(HINT)).select("text").distinct()
    total = book.agg(F.sum("n")).scalar()
    found = odd.mapInPandas(_pieces, "text string, i int, j int, piece string").withColumn("key", F.lower(F.trim("piece"))).join(book, "key")
    heads = odd.mapInPandas(_heads, "text string, i int, head string")
    long = heads.join(book.mapInPandas(_long, "head string, key string, n long"), "head").select("text", "i", "key", "n").mapInPandas(_met, "text string, i int, j int, n long")
    found = found.select("text", "i", "j", "n").unionByName(long)
    own = found.withColumn("total", total).groupBy("text").agg(F.collect_list(F.struct("i", "j", "n", "total")).alias("known"))
    return own.where(F.size("known") > 1).select("text", _parse("text", "known").alias("pieces")).where(F.size("pieces") > 1)


def packed_fields(flacs: DataFrame, tags: DataFrame) -> DataFrame:
    """(src, rec_id, text) of the fields that may pack values."""
    bare_key = F.regexp_replace(F.lower("tag_key"), r"[^\p{L}\p{N}]", "")
    a = flacs.select(F.lit("flacs").alias("src"), F.col("flac_id").alias("rec_id"), F.col("artist").cast("string").alias("text"))
    b = tags.where(bare_key.isin(*MULTI_KEYS)).select(F.lit("flac_tags").alias("src"), F.col("tag_id").alias("rec_id"), F.col("tag_value").cast("string").alias("text"))
    return a.unionByName(b).where("text is not null")


def unpack(flacs: DataFrame, tags: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, rec_id, pos, value): one row a value of every field that packs at least two.

    Repeated values count each time, empty items do not; a piece is a value only if it occurs alone
    as an artist or is a term; letter case and surrounding blanks do not matter. Null, empty and
    single-valued fields give no rows. Equal parses: the smaller list of pieces. Texts are parsed
    once per distinct value, whole, whatever their length.
    """
    fields = packed_fields(flacs, tags)
    alone = flacs.select(F.col("artist").cast("string").alias("text")).unionByName(terms.select(F.col("term").alias("text"))).where("text is not null")
    done = parses(fields, code_book(alone, fields))
    return fields.join(done, "text").select("src", "rec_id", F.explode("pieces").alias("p")).select("src", "rec_id", "p.pos", "p.value")
