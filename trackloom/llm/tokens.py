"""Encoding of a corpus with a byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled in order, each as one gadget on a deterministic automaton whose states
are the tokens last read. The gadget of ``a b -> c`` takes the arc ``b`` from state ``a``, adds an
arc ``c`` wherever an arc ``a`` leads, and makes state ``c`` with the arcs of state ``b`` as they
then are. The automaton accepts, for each string, exactly the token sequence of BPE, so a
pre-split word is encoded left to right over table-driven transitions (a trie of token bytes and
the arcs of the states), and decoded by emitting the labels of its arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from trackloom.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed value: the vocabulary's pre-split
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
UNLIKE = re.compile(r"[\x1c-\x1f]")  # white space to one regex library and not to the other
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 stands for itself, the rest is moved past 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        out[chr(256 + n)] = b
    return out


class Automaton:
    """Deterministic automaton of the merges over token arcs, with a trie over bytes for its transitions."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: t for t, i in vocab.items()}
        self.birth = {i: -1 for t, i in vocab.items() if len(t) == 1}  # bytes are there before the first gadget
        self.halves: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}  # arc taken from a state, and by which gadget
        self.arcs: dict[tuple[int, int], bool] = {}
        self.trie: dict = {}
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}
        for b, i in vocab.items():
            if len(b) == 1:
                self._accept(b, i)
        for when, (a, b) in enumerate(merges):
            self._gadget(when, vocab[a], vocab[b], vocab[a + b])

    def _gadget(self, when: int, a: int, b: int, c: int) -> None:
        """Apply merge a b -> c to the automaton."""
        reachable = self._arc(a, b, when)
        self.cut[a, b] = when
        if c not in self.birth:
            self.birth[c], self.halves[c] = when, (a, b)
            if reachable:
                self._accept(self.label[c], c)

    def _accept(self, data: bytes, token: int) -> None:
        node = self.trie
        for x in data:
            node = node.setdefault(x, {})
        node[-1] = token

    def _arc(self, state: int, token: int, when: int) -> bool:
        """Whether the state has the arc once the gadgets before ``when`` are in place."""
        while True:
            if self.cut.get((state, token), when) < when:
                return False
            s, t = self.birth[state], self.birth[token]
            if s < 0 and t < 0:
                return True
            if s > t:  # the state was made later and took over its right half's arcs
                state, when = self.halves[state][1], s
            else:  # the arc was added wherever its left half led; the same pair further left goes first
                token, when = self.halves[token][0], t + 1

    def arc(self, state: int, token: int) -> bool:
        known = self.arcs.get((state, token))
        if known is None:
            if len(self.arcs) > 4 * CACHE:
                self.arcs.clear()
            known = self.arcs[state, token] = self._arc(state, token, len(self.cut) + 1)
        return known

    def word(self, word: str) -> list[int]:
        """Token ids of a pre-split word."""
        ids = self.words.get(word)
        if ids is not None:
            return ids
        data = word.encode("utf-8", "surrogatepass")
        n, last, at = len(data), {0: -1}, {0: 0}
        for i in range(n):
            if (state := last.get(i)) is None:
                continue
            node = self.trie
            for j in range(i, n):
                node = node.get(data[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and j + 1 not in last and (state < 0 or self.arc(state, token)):
                    last[j + 1], at[j + 1] = token, i
        ids, i = [], n
        while i > 0:
            ids.append(last[i])
            i = at[i]
        ids.reverse()
        if len(self.words) > CACHE:
            self.words.clear()
        if n <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text without special tokens; a null or empty text has none."""
        if not text:
            return []
        out: list[int] = []
        if UNLIKE.search(text):
            for w in SPLIT.findall(text):
                out += self.word(w)
            return out
        for c in CHUNK.findall(text):
            ids = self.chunks.get(c)
            if ids is None:
                ids = []
                for w in SPLIT.findall(c):
                    ids += self.word(w)
                if len(self.chunks) > CACHE:
                    self.chunks.clear()
                if len(c) <= 64:
                    self.chunks[c] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def automaton(path: str = VOCABULARY) -> Automaton:
    """Compile the vocabulary file at ``path`` once a process."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda s: bytes(letters[ch] for ch in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t for t in model["vocab"] if not all(ch in letters for ch in t) or t.startswith("<|")}
    return Automaton({raw(t): i for t, i in model["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in pairs])


def encoder(path: str = VOCABULARY):
    """Arrow function of batches (doc_id, text) giving (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                flat += a.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return run


def encode_corpus(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; empty and null texts have the empty list.

    No shuffle but for a table in fewer partitions than cores; rows with equal ids stay as they are; further columns are ignored; texts of any length
    are encoded whole.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(own).mapInArrow(encoder(path), "doc_id long, ids array<int>")


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text column; 0 for null and empty."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        a = automaton(path)
        return texts.map(lambda t: len(a.encode(t)))

    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(count(text))


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by emitting arc labels; the empty list gives the empty text, null gives null."""

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        a = automaton(path)
        return ids.map(lambda x: None if x is None else a.decode([int(i) for i in x]))

    return encoded.select("doc_id", text("ids").alias("text"))
