"""Visually identical text made of other characters, brought to one plain composed form.

A mapping is compiled once, from rules over the Unicode tables and a fixed list of look-alike
letters, into a longest-match transducer over grapheme clusters: compatibility forms, separate
accents in any order, invisible characters, unusual spaces and hyphens, and letters of another
script. The compiler checks the mapping for conflicts (two outputs for one input, outputs that are
inputs); no normalisation is left to the run, which is one pass over the characters. Letters of
another script depend on the script of their word, so there is one table a script, applied to the
word's clusters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from trackloom.llm.mojibake import FIELDS, fields_of, repair_fields

# Look-alike letters, as (Latin, Cyrillic, Greek, other) columns; "_" where a script has none.
ALIKE = """
a а α ɑ|c с ϲ _|d _ _ ԁ|e е _ _|g _ _ ɡ|h _ _ һ|h _ _ հ|i і ι _|j ј ϳ յ|l _ _ ӏ|n _ _ ո|o о ο օ|p р ρ _|q _ _ ԛ
s ѕ _ _|u _ υ ս|v _ ν ѵ|w _ ω ԝ|x х χ _|y у γ ү|A А Α _|B В Β _|C С Ϲ _|E Е Ε _|F _ _ Ϝ|H Н Η _|I І Ι Ӏ|J Ј _ Ϳ
K К Κ _|M М Μ _|N _ Ν _|O О Ο Օ|P Р Ρ _|Q _ _ Ԛ|S Ѕ _ Տ|T Т Τ _|U _ _ Ս|V _ _ Ѵ|W _ _ Ԝ|X Х Χ _|Y У Υ Ү|Z _ Ζ _
ë ё _ _|ï ї _ _|Ë Ё _ _|Ï Ї _ _
"""
HYPHENS = "‐‑‒⁃−﹘﹣－"
TAGS = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
DIFFERENT = "№℡℻㏇"  # their compatibility forms look different
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎﻿" + "".join(map(chr, (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10))))
SCRIPTS = "LCG"


@lru_cache(None)
def plain_table() -> dict[str, str]:
    """Clusters of one character to their plain form, whatever the script; raises if the rules conflict."""
    table: dict[str, str] = {ch: "" for ch in INVISIBLE}
    letters_alike = {ch for ch in ALIKE if not ch.isascii()}

    def put(a: str, b: str) -> None:
        if table.setdefault(a, b) != b:
            raise ValueError(f"conflicting mappings of U+{ord(a):04X}")

    for cp in [*range(0xA0, 0xD800), *range(0xE000, 0x20000)]:
        ch = chr(cp)
        if ch in table or ch in DIFFERENT or ch in letters_alike:
            continue
        if ch in HYPHENS:
            put(ch, "-")
        elif unicodedata.category(ch) == "Zs":
            put(ch, " ")
        elif (d := unicodedata.decomposition(ch)).startswith(TAGS):
            to = unicodedata.normalize("NFKC", ch)
            if to.startswith(" "):
                continue
            put(ch, "-" if to in HYPHENS else to)
        elif (to := unicodedata.normalize("NFC", ch)) != ch:
            put(ch, to)
    for _ in range(3):  # outputs that are inputs are followed to the end
        again = {a: "".join(table.get(x, x) for x in b) for a, b in table.items()}
        if again == table:
            return table
        table = again
    raise ValueError("the mapping does not come to rest")


@lru_cache(None)
def script_tables() -> tuple[dict[str, dict[str, str]], dict[str, set[str]]]:
    """For each target script its letter mapping, and for each script its letters that have a look-alike."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    alike: dict[str, set[str]] = {s: set() for s in "LCGO"}
    for entry in ALIKE.replace("\n", "|").split("|"):
        forms = dict(zip("LCGO", entry.split()))
        forms = {s: ch for s, ch in forms.items() if ch != "_"}
        for s, ch in forms.items():
            if len([x for x in forms if x in SCRIPTS]) > 1 or s == "O":
                alike[s if s in SCRIPTS else script_of(ch) or "O"].add(ch)
            for target in SCRIPTS if s in SCRIPTS else "L":
                if s != target and target in forms and to[target].setdefault(ch, forms[target]) != forms[target]:
                    raise ValueError(f"conflicting look-alikes of {ch}")
    for cp in range(0x4D0, 0x500):  # rare accented letters are their base letter's look-alike with the accent
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in to["L"]:
            alike["C"].add(chr(cp))
            to["L"].setdefault(chr(cp), unicodedata.normalize("NFC", to["L"][parts[0]] + parts[1:]))
    return to, alike


@lru_cache(20_000)
def script_of(ch: str) -> str:
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "O"}.get(name, "")


class Transducer:
    """The compiled mapping: outputs of characters, and arcs that lengthen the match of a cluster by a mark or a letter part.

    A match starts at a letter and goes on while an arc leads from what it has become over the next
    mark, so that "e", a dot below and a circumflex in any order are one match with one output.
    Compiling fails if two rules disagree, or if an output could be matched again.
    """

    def __init__(self) -> None:
        self.out = plain_table()
        self.rank = {chr(c): n for c in range(0x300, 0x20000) if (n := unicodedata.combining(chr(c)))}
        self.arcs: dict[tuple[str, str], str] = {}
        self.parts: dict[str, tuple[str, list[str]]] = {}  # letters that already hold marks, which further marks may come before
        for cp in [*range(0xA0, 0xD800), *range(0xE000, 0x20000)]:
            ch = chr(cp)
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) < 2 or unicodedata.normalize("NFC", ch) != ch or unicodedata.decomposition(ch).startswith("<"):
                continue
            if all(m in self.rank for m in parts[1:]):
                self.parts[ch] = parts[0], list(parts[1:])
            first = unicodedata.normalize("NFC", parts[:-1])
            if len(first) == 1 and self.arcs.setdefault((first, parts[-1]), ch) != ch:
                raise ValueError(f"two clusters end in U+{cp:04X}")
        for composed in self.arcs.values():
            if self.out.get(composed, composed) != composed:
                raise ValueError(f"the output U+{ord(composed):04X} is an input")

    def compose(self, letter: str, marks: list[str]) -> tuple[str, list[str]]:
        """The longest match of a letter and its marks: what it becomes, and the marks no arc takes."""
        if not marks:
            return letter, marks
        letter, own = self.parts.get(letter, (letter, []))
        rest: list[str] = []
        for m in sorted((*own, *marks), key=self.rank.__getitem__):
            to = self.arcs.get((letter, m)) if not rest or self.rank[rest[-1]] < self.rank[m] else None
            if to is None:
                rest.append(m)
            else:
                letter = to
        return letter, rest

    def clusters(self, text: str) -> list[tuple[str, list[str]]]:
        """Outputs of the clusters of a text, each a letter or sign with the marks that stay apart, in one pass."""
        found: list[tuple[str, list[str]]] = []
        letter, marks = "", []
        for ch in text:
            for o in self.out.get(ch, ch):
                if o in self.rank:
                    marks.append(o)
                elif letter and not marks and (to := self.arcs.get((letter, o))):
                    letter = to
                else:
                    if letter or marks:
                        found.append(self.compose(letter, marks))
                    letter, marks = o, []
        if letter or marks:
            found.append(self.compose(letter, marks))
        return found


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def letters(word: list[tuple[str, list[str]]]) -> tuple[dict[str, int], dict[str, int]]:
    """Letters of each script in the word's clusters: those without a look-alike, and all."""
    _, alike = script_tables()
    own: dict[str, int] = {}
    every: dict[str, int] = {}
    for ch, _ in word:
        if s := script_of(ch):
            every[s] = every.get(s, 0) + 1
            if ch not in alike[s]:
                own[s] = own.get(s, 0) + 1
    return own, every


def target_of(own: dict[str, int], every: dict[str, int], sure: dict[str, int]) -> str | None:
    """Script that a word's look-alike letters stand for; None where they stand for themselves. ``sure``: the text's letters without a look-alike."""
    if not every or len(every) == 1 and own:
        return None
    own = {s: n for s, n in own.items() if s in SCRIPTS}
    if own:
        return max(own, key=lambda s: (own[s], every[s], s == "L"))
    if len(every) > 1:
        return max(SCRIPTS, key=lambda s: (sure.get(s, 0), s in every, s == "L", every.get(s, 0)))
    (s,) = every
    return None if s in sure or not sure else max(sure, key=lambda x: (sure[x], x == "L"))


def plain(text: str | None) -> str | None:
    """The plain composed form of a text; null stays null, proper text in any script is unchanged.

    One pass gives the clusters' outputs; the look-alike letters of each word are then resolved by the
    scripts of its other letters, or else of the text's.
    """
    if text is None or text.isascii():
        return text
    machine = transducer()
    found = machine.clusters(text)
    if all(len(c) == 1 and c.isascii() and not m for c, m in found):
        return "".join(c for c, _ in found)
    to, _ = script_tables()
    words, start = [], None
    for i, (ch, marks) in enumerate((*found, ("", []))):
        within = bool(ch and (ch.isalpha() or unicodedata.category(ch)[0] in "LM") or marks)
        if within and start is None:
            start = i
        elif not within and start is not None:
            words.append((start, i))
            start = None
    for _ in range(len(words) + 1):  # a word resolved may decide the script of another
        settled = True
        sure: dict[str, int] = {}
        told = [letters(found[a:b]) for a, b in words]
        for own, _ in told:
            for s, n in own.items():
                sure[s] = sure.get(s, 0) + n
        for (a, b), (own, every) in zip(words, told):
            if all(ch.isascii() for ch, _ in found[a:b]):
                continue
            table = to.get(target_of(own, every, sure) or "", {})
            for i in range(a, b):
                ch, marks = found[i]
                if ch in table:
                    found[i] = machine.compose(table[ch], marks)
                    settled = settled and found[i] == (ch, marks)
        if settled:
            break
    return "".join(c + "".join(m) for c, m in found)


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    done: dict[str, str] = {}
    return texts.map(lambda t: t if t is None else done[t] if t in done else done.setdefault(t, plain(t)))


def plain_form(col: Column | str) -> Column:
    """Plain composed form of a string column. ASCII values are passed by in the JVM."""
    c = F.col(col) if isinstance(col, str) else col
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_plain(odd), c)


def plain_fields(df: DataFrame, id_col: str = "flac_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, text, plain) of every non-null field; an empty text is its own plain form."""
    return fields_of(df, id_col, fields).withColumn("plain", plain_form("text"))


def disguised_fields(df: DataFrame, id_col: str = "flac_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field) of every field that is not in its plain form and is not garbled by wrong decoding."""
    own = repair_fields(df, id_col, fields).where("not garbled")
    return own.withColumn("plain", plain_form("text")).where("plain <> text").select(id_col, "field")
