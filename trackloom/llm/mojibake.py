"""Text decoded with the wrong character encoding: detection and repair.

Noisy channel. Each non-ASCII token of a text is put into a byte lattice: for every pair of a
wrong and a right encoding (nested up to three deep) the bytes behind the characters are read
again, lost bytes being wildcards. The words on the arcs get their costs from word frequencies
of the whole corpus by a join; a word with wildcards stands for the cheapest of all corpus words
that fit what is left of it, and a Viterbi search over the tokens of a text picks the cheapest reading.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from trackloom.session import cut, in_parts, spread

# Wrong decoders of UTF-8 bytes, and wrong/right pairs of one-byte encodings.
UTF8_READ_AS = ("cp1252", "cp437", "cp1251", "mac_roman", "cp850", "cp866", "koi8_r", "cp1250")
BYTE_PAIRS = (
    ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"),
    ("cp1251", "cp866"), ("cp1252", "cp1253"), ("cp1252", "cp1250"), ("cp437", "cp1252"), ("cp437", "cp1251"),
)
LOST = "�"
GARBLE, LOSS, SEQUENCE, SWITCH, UNKNOWN, PER_CHAR, CASE = 3.0, 6.0, 5.0, 2.0, 10.0, 1.5, 1.0
#: Corpus words of one key that meet the damaged words of that key in one task.
PAIRS = 20_000
TOKEN = re.compile(r"[^ ;|/,()\[\]\"\n\\&+]+")
FIELDS = ("artist", "album", "title")
ARC = "token string, chain string, word string, base double, key string, kept string"

RESTORED = T.StructType([T.StructField("restored", T.StringType()), T.StructField("garbled", T.BooleanType()),
                         T.StructField("chain", T.StringType()), T.StructField("cost", T.DoubleType())])


@lru_cache(None)
def encoder(name: str) -> dict[str, int]:
    """Character to byte; undefined bytes of cp1252 stand for themselves, as lenient decoders have it."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name == "cp1252":
        out |= {chr(b): b for b in range(0x80, 0xA0)}
    return out


@lru_cache(100_000)
def script(ch: str) -> str:
    if ch.isascii():
        return "L" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "?").split(" ", 1)[0]
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name, "O" if name not in ("FEMININE", "MASCULINE", "MICRO", "MODIFIER") else "")


def mixed(word: str) -> bool:
    return len({s for s in map(script, word) if s}) > 1


def shape_cost(word: str, dense: bool = True) -> float:
    """Penalty of a token for what proper words rarely have: symbols inside, mixed scripts, odd case, dense accents."""
    cost, prev, accents, letters = 0.0, "", 0, 0
    scripts = [s for s in map(script, word) if s]
    cost += 6.0 * sum(a != b for a, b in zip(scripts, scripts[1:]))
    for ch in word:
        if ch != LOST and not ch.isascii() and ch not in "’‘²³¹" and unicodedata.category(ch)[0] in "SCPNZ" or unicodedata.category(ch) in ("Lm", "Cc"):
            cost += 6.0 if ch not in " ­​　" else 0.0
        if ch.isalpha():
            letters += 1
            accents += script(ch) == "L" and not ch.isascii()
            if ch.isupper() and prev.islower():
                cost += 5.0
            prev = ch
    if dense and letters > 2 and accents * 2 >= letters:
        cost += 1.5 * accents
    return cost


def utf8_readings(data: list[int | None]) -> tuple[str, int, int] | None:
    """Cheapest path through the byte lattice as UTF-8, None being a wildcard: text with U+FFFD for what is lost, sequences read, characters lost.

    Arcs lead over an ASCII byte, a whole sequence, a sequence with wildcards in it or cut short (one
    character lost), and a stray byte or wildcard (one lost). Ties go to the shorter arc.
    """
    n = len(data)
    best: list[tuple[float, int, str, int, int] | None] = [None] * (n + 1)  # cost, arcs, text, sequences, lost
    best[0] = (0.0, 0, "", 0, 0)

    def arc(i: int, j: int, text: str, seqs: int, lost: int) -> None:
        cost, arcs, before, s, l = best[i]
        new = (cost + LOSS * lost - SEQUENCE * seqs, arcs + 1, before + text, s + seqs, l + lost)
        if best[j] is None or new[:2] < best[j][:2]:
            best[j] = new

    for i, b in enumerate(data):
        if best[i] is None:
            continue
        if b is not None and b < 0x80:
            arc(i, i + 1, chr(b), 0, 0)
            continue
        arc(i, i + 1, LOST, 0, 1)
        if b is None or not 0xC2 <= b <= 0xF4:
            continue
        need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        tail: list[int | None] = []
        for x in data[i + 1 : i + 1 + need]:
            if x is not None and not 0x80 <= x < 0xC0:
                break
            tail.append(x)
            whole = len(tail) == need and None not in tail
            try:
                text = bytes([b, *tail]).decode() if whole else LOST
            except UnicodeDecodeError:
                text, whole = LOST, False
            arc(i, i + 1 + len(tail), text, int(whole), int(not whole))
    _, _, text, seqs, lost = best[n]
    return (text, seqs, lost) if seqs or lost else None


@lru_cache(40_000)
def readings(token: str, depth: int = 3) -> tuple[tuple[str, str, float], ...]:
    """All readings of a token: (chain of encodings, word, cost of the channel); the empty chain is the token itself, "lost" if it lost characters."""
    found: dict[str, tuple[str, float]] = {}
    plain = not token.isascii()

    def add(word: str, chain: str, cost: float, left: int, closed: bool = False) -> None:
        if word in found and found[word][1] <= cost or word == token or mixed(word):
            return
        if any(unicodedata.category(ch)[0] in "MCS" and ch not in (LOST, "\xad") for ch in word if not ch.isascii()) and not any(encoder(w).keys() >= set(word) for w in UTF8_READ_AS):
            return
        found[word] = (chain, cost)
        if left and not word.isascii() and not closed:
            layer(word, chain, cost, left)

    def layer(word: str, chain: str, cost: float, left: int) -> None:
        for name in UTF8_READ_AS:
            table = encoder(name)
            data = [None if ch == LOST else table.get(ch, -1) for ch in word]
            if -1 in data or not any(b is not None and b >= 0x80 for b in data):
                continue
            r = utf8_readings(data)
            if r and r[1] and r[2] <= r[1] and not any(unicodedata.category(ch)[0] == "M" for ch in r[0]):
                add(r[0], f"{chain}>{name}:utf8" if chain else f"{name}:utf8", cost + GARBLE + LOSS * r[2] - SEQUENCE * min(r[1], 8), left - 1)
        if LOST in word:
            return
        for wrong, right in BYTE_PAIRS:
            table = encoder(wrong)
            try:
                t = bytes(table[ch] for ch in word).decode(right)
            except (KeyError, UnicodeDecodeError):
                continue
            if all(ch.isascii() or ch.isalpha() for ch in t):
                add(t, f"{chain}>{wrong}:{right}" if chain else f"{wrong}:{right}", cost + GARBLE, 0, True)
        if any("\x80" <= ch <= "\x9f" for ch in word):
            t = "".join(bytes([ord(ch)]).decode("cp1252", "replace") if "\x80" <= ch <= "\x9f" else ch for ch in word)
            add(t, f"{chain}>latin1:cp1252" if chain else "latin1:cp1252", cost + GARBLE, 0, True)

    if plain:
        layer(token, "", 0.0, depth)
    return (("lost" if LOST in token else "", token, 0.0), *((c, w, k) for w, (c, k) in found.items()))


def repair_alone(text: str) -> str:
    """A text with each token in its cheapest reading by channel and shape alone, without a corpus."""
    if text.isascii():
        return text
    return TOKEN.sub(lambda m: min(readings(m.group()), key=lambda r: (r[2] + shape_cost(r[1]) + PER_CHAR * len(r[1]), r[0]))[1], text)


def key_of(word: str) -> str:
    """Key of a word in the frequency table; a word with wildcards has its skeleton as key."""
    w = word.lower()
    return "".join(LOST if not ch.isascii() else ch for ch in w) if LOST in w else w


def fields_of(df: DataFrame, id_col: str = "flac_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, text) of each non-null field."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))
    return df.select(F.col(id_col), F.explode(pairs).alias("p")).select(id_col, "p.field", "p.text").where("text is not null")


def kept(word: str) -> list[str]:
    """Place and character of each non-ASCII one that is left of a word in lower case."""
    return [f"{i}{ch}" for i, ch in enumerate(word.lower()) if ch != LOST and not ch.isascii()]


def _arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for token in pdf["token"]:
            for chain, word, cost in readings(token):
                rows.append((token, chain, word, cost + (shape_cost(word)), key_of(word), next(iter(kept(word)), "")))
        yield pd.DataFrame(rows, columns=["token", "chain", "word", "base", "key", "kept"])


def _fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cheapest of the corpus words that fit a damaged word, within the batch; ties go to the smaller word."""
    for pdf in batches:
        best: dict[str, tuple[float, str, int, float]] = {}
        for word, lower, fill, n, total in zip(pdf["word"], pdf["lower"], pdf["fill"], pdf["n"], pdf["total"]):
            if any(a != b for a, b in zip(word.lower(), lower) if a != LOST) or (w := like(fill, word)) == word:
                continue
            slip = CASE * (w != fill)
            new = (frequency_cost(w, n, total) + slip, w, n, slip)
            if word not in best or new < best[word]:
                best[word] = new
        yield pd.DataFrame([(k, *v) for k, v in best.items()], columns=["word", "cost", "fill", "n", "slip"])


def frequency_cost(word: str, n: int | None, total: int) -> float:
    """Cost of a word by its count in the corpus, at most that of an unknown one."""
    lm = UNKNOWN + PER_CHAR * len(word) + 4.0 * word.count(LOST)
    return min(lm, max(0.0, math.log(total / n))) if n else lm


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of proper shape with their counts, pre-aggregated within the batch."""
    for pdf in batches:
        n: dict[str, int] = {}
        for text, k in zip(pdf["text"], pdf["n"]):
            for t in TOKEN.findall(text):
                if LOST not in t:
                    n[t] = n.get(t, 0) + k
        keep = {t: k for t, k in n.items() if t.isascii() or not shape_cost(t, False)}
        yield pd.DataFrame({"word": list(keep), "key": [t.lower() for t in keep], "n": list(keep.values())})


def _skeleton() -> F.Column:
    return F.regexp_replace("key", r"[^\x00-\x7F]", LOST)


def _kept() -> F.Column:
    """As ``kept`` has it of the column lower, and the empty text."""
    chars = F.split("lower", "")
    at = F.filter(F.transform(chars, lambda ch, i: F.when(ch.rlike(r"^[^\x00-\x7F]$"), F.concat(i.cast("string"), ch))), lambda x: x.isNotNull())
    return F.concat(F.array(F.lit("")), at)


@F.pandas_udf(RESTORED)
def _viterbi(texts: pd.Series, arcs: pd.Series) -> pd.DataFrame:
    out = []
    for text, own in zip(texts, arcs):
        by: dict[int, dict[str, tuple[float, str]]] = {}
        for tok, a in ((place["tok"], a) for place in own for a in place["arcs"]):
            best = by.setdefault(tok, {})
            bare = 4.0 if LOST in a["word"] and a["chain"] == "lost" else 0.0
            for word, n, slip in spelled(a):
                cost = frequency_cost(word, n, a["total"]) + a["base"] + bare + slip
                if a["chain"] not in best or (cost, word) < best[a["chain"]]:
                    best[a["chain"]] = (cost, word)
        paths: dict[str, tuple[float, dict[int, str], str]] = {"": (0.0, {}, "")}
        for tok in sorted(by):
            nxt: dict[str, tuple[float, dict[int, str], str]] = {}
            for chain, (cost, word) in by[tok].items():
                p, c = min(((p, v[0] + (SWITCH if p != chain and v[1] and {p, chain} != {"", "lost"} else 0.0)) for p, v in paths.items()), key=lambda x: (x[1], x[0]))
                nxt[chain] = (c + cost, paths[p][1] | {tok: word}, paths[p][2] or chain)
            paths = nxt
        cost, words, chain = min(paths.values(), key=lambda x: (x[0], x[2]))
        i = -1

        def sub(m: re.Match) -> str:
            nonlocal i
            i += 1
            return words.get(i, m.group())

        restored = TOKEN.sub(sub, text)
        out.append((restored, bool(chain), chain, cost))
    return pd.DataFrame(out, columns=["restored", "garbled", "chain", "cost"])


def spelled(arc) -> list[tuple[str, int | None, float]]:
    """(word, count, cost of another letter case) an arc may stand for: the word, and where characters are lost the cheapest corpus word that fits what is left."""
    word, fit = arc["word"], arc["fit"]
    if LOST not in word:
        return [(word, arc["n"], 0.0)]
    return [(word, None, 0.0), *([(fit["fill"], fit["n"], fit["slip"])] if fit is not None else [])]


def like(fill: str, word: str) -> str:
    """The corpus word ``fill`` in place of the damaged ``word``, in the letter case of what is left of it."""
    if len(fill) != len(word):
        return word
    left = [ch for ch in word if ch.isalpha()]
    if len(left) > 1 and all(ch.isupper() for ch in left) and len(fill.upper()) == len(fill):
        return fill.upper()
    if left and all(ch.islower() for ch in left) and word[0] != LOST:
        fill = fill.lower() if len(fill.lower()) == len(fill) else fill
    return "".join(f if w == LOST else w for f, w in zip(fill, word))


def decode_texts(texts: DataFrame) -> DataFrame:
    """(text, n) -> (text, restored, garbled, chain, cost) of each distinct text with a non-ASCII character.

    ``n`` is the number of rows that hold the text. An all-ASCII, empty or null text is never
    garbled and has no row. Ties between readings go to the smaller chain name.
    """
    odd = texts.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("text")
    places = odd.select("text", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN.pattern), F.lit(0))).alias("tok", "token")).where(F.col("token").rlike(r"[^\x00-\x7F]"))
    arcs = cut(spread(places.select("token").distinct(), by_rows=True).mapInPandas(_arcs, ARC))
    forms = texts.mapInPandas(_tokens, "word string, key string, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
    words = forms.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("fill"), F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).scalar()
    damaged = arcs.where(F.contains("word", F.lit(LOST))).select("key", "kept", "word").distinct()
    # a corpus word meets damaged ones by each of its non-ASCII characters, and those of which none is left
    fitting = words.where(F.col("key").rlike(r"[^\x00-\x7F]")).select(_skeleton().alias("key"), F.col("key").alias("lower"), "fill", "n").join(damaged.select("key").distinct(), "key", "left_semi")
    fitting = fitting.withColumn("kept", F.explode(_kept()))
    fits = in_parts(damaged, fitting, ["key", "kept"], PAIRS).withColumn("total", total).mapInPandas(_fits, "word string, cost double, fill string, n long, slip double")
    cheapest = fits.groupBy("word").agg(F.min(F.struct("cost", "fill", "n", "slip")).alias("fit"))
    known = arcs.join(words.select("key", "n"), "key", "left").join(cheapest, "word", "left").withColumn("total", total)
    arc = F.struct("chain", "word", "base", "n", "fit", "total")
    read = known.groupBy("token").agg(F.sort_array(F.collect_list(arc)).alias("arcs"))
    return (
        places.join(read, "token").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("tok", "arcs"))).alias("arcs"))
        .select("text", _viterbi("text", "arcs").alias("r")).select("text", "r.*")
    )


def repair_fields(df: DataFrame, id_col: str = "flac_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, text, restored, garbled, chain) of every field that holds a non-ASCII character.

    Texts are decoded once per distinct value. ``restored`` still holds U+FFFD where a lost byte
    could not be filled. Null and empty fields and an empty table give no rows.
    """
    own = fields_of(df, id_col, fields)
    texts = own.groupBy("text").agg(F.count("*").alias("n"))
    return own.where(F.col("text").rlike(r"[^\x00-\x7F]")).join(decode_texts(texts), "text").select(id_col, "field", "text", "restored", "garbled", "chain")


def garbled_fields(df: DataFrame, id_col: str = "flac_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field) of every garbled field, restorable or not."""
    return repair_fields(df, id_col, fields).where("garbled").select(id_col, "field")
