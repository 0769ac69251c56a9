"""Similarity of texts and the two track scores.

The scores are column expressions over described tracks (``describe``). The edit ratio exists as a
column expression, and vectorised over many texts for scans of a query set against a library.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from trackloom.functions.text import JUNK, SERIES, canon, col, core, index_words, junk, squash, words

# ---- edit ratio: 200 * longest common subsequence / both lengths


def lcs(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence, by rows of the dynamic programme."""
    a, b = col(a), col(b)
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, ch: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.substring(b, j, F.lit(1)) == ch, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(acc, j - 1)))))
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

    table = F.aggregate(F.filter(F.split(a, ""), lambda x: x != ""), start, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(table, -1))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Edit ratio 0..100 of two texts; two empty texts are equal."""
    n = F.length(col(a)) + F.length(col(b))
    return F.when(n == 0, F.lit(100.0)).otherwise(200.0 * lcs(a, b) / n)


def length_ratio(a: Column | str, b: Column | str) -> Column:
    """Stand-in by lengths alone: 100 if equal, else the whole percentage of the shorter."""
    a, b = col(a), col(b)
    most = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, F.lit(100)).otherwise(F.floor(100 * (1 - F.abs(F.length(a) - F.length(b)) / most)).cast("int"))


def lcs_number(a: str, b: str) -> int:
    """Longest common subsequence by a bit row of any width."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio_number(a: str, b: str) -> float:
    return 200.0 * lcs_number(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edit ratio in Arrow batches, for many or long texts; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio_number(x, y) for x, y in zip(a, b)], dtype="float64")


#: Bits of a query that one machine word holds, with room for the carry.
LIMB = 62
FULL, SHIFT = (1 << LIMB) - 1, np.uint64(LIMB)
#: Kinds that characters are counted by, for bounds, and what stands for no character, of kind 0.
KINDS, NONE = 32, 0x110000
#: Texts that are compared in full at once.
BATCH = 256


class TextBlock:
    """Texts of a library block, laid out so that one query is compared with all of them at once."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        width = int(self.lengths.max(initial=0))
        codes = np.full((len(texts), width), NONE, dtype=np.uint32)
        codes[np.arange(width) < self.lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        there = np.zeros(NONE + 1, dtype=bool)
        there[codes], there[NONE] = True, True
        self.chars = np.flatnonzero(there).astype(np.uint32)  # the last stands for none
        number = np.zeros(NONE + 1, dtype=np.int32)
        number[self.chars] = np.arange(len(self.chars), dtype=np.int32)
        self.at = np.ascontiguousarray(number[codes.T])
        self.numbers = {c: i for i, c in enumerate(self.chars.tolist())}

    @cached_property
    def counts(self) -> np.ndarray:
        """Number of each text's characters by kind."""
        kinds = (self.chars % KINDS)[self.at]  # kind 0 of no character is taken off again
        counts = np.stack([(kinds == k).sum(axis=0) for k in range(KINDS)]).astype(np.int32)
        counts[0] -= len(self.at) - self.lengths
        return counts

    def bounds(self, query: str) -> np.ndarray:
        """What the ratios are at most: characters that both have, by kind."""
        both = np.zeros(len(self.texts), dtype=np.int32)
        kinds, n = np.unique(np.frombuffer(query.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % KINDS, return_counts=True)
        for kind, most in zip(kinds, n):
            both += np.minimum(self.counts[kind], np.int32(most))
        return 200.0 * both / np.maximum(len(query) + self.lengths, 1) if query else self.ratios(query)

    @cached_property
    def by_length(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The texts from the longest on, and the numbers of the characters at each place of those that are so long."""
        order = np.argsort(-self.lengths, kind="stable")
        longer = np.searchsorted(-self.lengths[order], -np.arange(len(self.at)), side="left")  # texts with more characters
        return order, [row[order[:n]].astype(np.intp) for row, n in zip(self.at, longer)]

    def ratios(self, query: str, which: np.ndarray | None = None) -> np.ndarray:
        """Edit ratio of each text, or of those numbered in ``which``."""
        lengths = self.lengths if which is None else self.lengths[which]
        n = len(lengths)
        if not query:
            return np.where(lengths == 0, 100.0, 0.0)
        limbs = -(-len(query) // LIMB)
        bits: dict[str, int] = {}
        for i, ch in enumerate(query):
            bits[ch] = bits.get(ch, 0) | 1 << i
        masks = np.zeros((limbs, len(self.chars)), dtype=np.uint64)
        for ch, m in bits.items():
            if (i := self.numbers.get(ord(ch))) is not None:
                masks[:, i] = [m >> LIMB * w & FULL for w in range(limbs)]
        whole = (1 << len(query)) - 1
        full = [np.uint64(whole >> LIMB * w & FULL) for w in range(limbs)]
        if which is None:
            order, columns = self.by_length
        else:
            order = np.argsort(-lengths, kind="stable")
            some, ends = which[order], np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
            columns = (row[some[:k]].astype(np.intp) for row, k in zip(self.at, ends))
        v = np.repeat(np.array(full, dtype=np.uint64)[:, None], n, axis=1)
        u_, m_, carry_ = (np.empty(n, dtype=np.uint64) for _ in range(3))
        for row in columns:  # of the texts that are not yet at their end
            k = len(row)
            u, m, carry = u_[:k], m_[:k], carry_[:k]
            for w in range(limbs):  # v := (v + u) | (v - u), the sum carried from limb to limb
                own = v[w, :k]
                np.take(masks[w], row, out=m, mode="clip")
                np.bitwise_and(own, m, out=u)
                np.bitwise_xor(own, u, out=m)
                np.add(own, u, out=u)
                if w:
                    np.add(u, carry, out=u)
                if w + 1 < limbs:
                    np.right_shift(u, SHIFT, out=carry)
                np.bitwise_or(u, m, out=own)
                if limbs > 1:  # else what is carried over the end does no harm
                    np.bitwise_and(own, full[w], out=own)
        if limbs == 1:
            v &= full[0]
        found = np.empty(n, dtype=np.int64)
        found[order] = len(query) - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
        return 200.0 * found / (len(query) + lengths)

    def windows(self, query: str, which: np.ndarray) -> np.ndarray:
        """Best edit ratio of the shorter of the query and each text numbered in ``which`` with any window of the longer, as ``window_number`` gives it."""
        out, lengths = np.zeros(len(which)), self.lengths[which]
        if not query:
            return out
        over_text = lengths >= len(query)
        wide = np.minimum(lengths, len(query)) > LIMB
        out[wide] = [window_number(query, self.texts[i]) for i in which[wide]]
        for own, run in ((over_text & ~wide, self._windows_of_texts), (~over_text & ~wide & (lengths > 0), self._windows_of_query)):
            if own.any():
                out[own] = run(query, which[own], lengths[own])
        return out

    def _bits(self, query: str) -> dict[int, int]:
        """The places in the query of each of its characters that any text has, by the character's number."""
        bits: dict[int, int] = {}
        for i, ch in enumerate(query):
            if (at := self.numbers.get(ord(ch))) is not None:
                bits[at] = bits.get(at, 0) | 1 << i
        return bits

    def _windows_of_texts(self, query: str, which: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All windows of the texts at once: a row of bits for each start."""
        n, starts = len(query), int(lengths.max())
        chars = np.full((starts + n, len(which)), len(self.chars) - 1, dtype=np.int32)
        chars[:starts] = self.at[:starts, which]
        masks = np.zeros(len(self.chars), dtype=np.uint64)
        for at, m in self._bits(query).items():
            masks[at] = m
        full = np.uint64((1 << n) - 1)
        v = np.full((starts, len(which)), full)
        for j in range(n):
            v = _next(v, masks[chars[j : j + starts]], full)
        left = lengths - np.arange(starts)[:, None]
        ratios = 200.0 * (n - np.bitwise_count(v).astype(np.int64)) / (n + np.clip(left, 1, n))
        return np.where(left > 0, ratios, 0.0).max(axis=0)

    def _windows_of_query(self, query: str, which: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All windows of the query at once: a row of bits, the query's from there, for each start. A text's window are the lowest bits, as many as it has characters."""
        n = len(query)
        masks = np.zeros((n, len(self.chars)), dtype=np.uint64)
        for at, m in self._bits(query).items():
            masks[:, at] = [m >> i & FULL for i in range(n)]
        full = np.uint64(FULL)
        v = np.full((n, len(which)), full)
        for row in self.at[: int(lengths.max()), which]:
            v = _next(v, np.take(masks, row, axis=1), full)
        shifts = lengths.astype(np.uint64)
        found = lengths - np.bitwise_count(v & ((np.uint64(1) << shifts) - np.uint64(1))).astype(np.int64)
        return (200.0 * found / (lengths + np.minimum(lengths, n - np.arange(n)[:, None]))).max(axis=0)


    def windows_at_most(self, query: str, which: np.ndarray, common: np.ndarray) -> np.ndarray:
        """What ``windows`` gives at most, by the longest common subsequences: windows cut off by the end are exact, of the others at most the whole is common."""
        lengths, n = self.lengths[which], len(query)
        least = np.minimum(lengths, n)
        out = 100.0 * common / np.maximum(least, 1)
        out[least > LIMB] = 100.0
        over_text = lengths >= n
        for own in (over_text & (least <= LIMB), ~over_text & (least <= LIMB) & (lengths > 0)):
            if not own.any():
                continue
            some, last = which[own], lengths[own]
            steps = int(last.max()) if not over_text[own][0] else n - 1
            part = query[::-1][:LIMB]
            masks = np.zeros(len(self.chars), dtype=np.uint64)
            for at, m in self._bits(part).items():
                masks[at] = m
            full = np.uint64((1 << len(part)) - 1)
            v, best = np.full(len(some), full), out[own]
            for j in range(steps):  # from the end
                row = np.where(j < last, self.at[np.maximum(last - 1 - j, 0), some], len(self.chars) - 1)
                v = _next(v, masks[row], full)
                if over_text[own][0]:
                    best = np.maximum(best, 200.0 * (n - np.bitwise_count(v).astype(np.int64)) / (n + j + 1))
            if not over_text[own][0]:
                for w in range(1, steps):
                    found = w - np.bitwise_count(v & np.uint64((1 << w) - 1)).astype(np.int64)
                    best = np.maximum(best, np.where(w < last, 200.0 * found / (last + w), 0.0))
            out[own] = best
        return out + 1e-6


def _next(v: np.ndarray, masks: np.ndarray, full: np.uint64) -> np.ndarray:
    """The bit rows after one more character."""
    u = v & masks
    return (v + u | v ^ u) & full


# ---- described tracks and the score by phrases and words


def describe(artist: Column | str, title: Column | str, album: Column | str, path: Column | str, year: Column | str, duration: Column | str | None = None, ascii_only: bool = False) -> Column:
    """Struct of what the score needs of a track, worked out once a track."""
    a, t, al = (canon(x, ascii_only) for x in (artist, title, album))
    both = F.trim(F.concat_ws(" ", F.coalesce(col(album), F.lit("")), F.coalesce(col(title), F.lit(""))))
    series = F.when(both != "", canon(both, ascii_only)).otherwise(canon(path, ascii_only))
    return F.struct(
        a.alias("artist"), t.alias("title"), al.alias("album"), series.alias("series"), col(year).cast("int").alias("year"),
        (F.lit(None) if duration is None else col(duration)).cast("double").alias("duration"),
    )


def phrase(a: Column, b: Column) -> Column:
    """Score of ordered words of two canonical texts: 1 equal, 0.9 inside, else 0.8 of the share of a's words found in order."""
    aw, bw = words(a), words(b)
    run = F.aggregate(bw, F.lit(0), lambda i, w: F.when((i < F.size(aw)) & (w == F.get(aw, i)), i + 1).otherwise(i))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(b, a), 0.9).otherwise(0.8 * run / F.greatest(F.size(aw), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of weighty words plus a fifth of that of the others, at most 1; 0 if either has no weighty word."""
    ac, bc, aj, bj = core(a), core(b), junk(a), junk(b)
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when((F.size(ac) == 0) | (F.size(bc) == 0), 0.0).otherwise(F.least(F.lit(1.0), share(ac, bc) + 0.2 * share(aj, bj)))


def series_bonus(a: Column, b: Column) -> Column:
    hints = F.array(*map(F.lit, SERIES))
    return F.when(F.exists(hints, lambda h: F.contains(a, h) & F.contains(b, h)), 0.3).otherwise(0.0)


def word_share(a: Column | str, b: Column | str) -> Column:
    """Share of a's index words that b has; 0 if a has none."""
    aw = index_words(a)
    return F.when(F.size(aw) == 0, 0.0).otherwise(F.size(F.array_intersect(aw, index_words(b))) / F.greatest(F.size(aw), F.lit(1)))


def track_score(s: Column, c: Column) -> Column:
    """Score 0..100 with one decimal of a described source and candidate."""
    inside = (s["artist"] != "") & F.contains(c["artist"], s["artist"])
    a_dir = F.when(inside, 1.0).otherwise(phrase(s["artist"], c["artist"]))
    a_tok = F.when(inside, 1.0).otherwise(overlap(s["artist"], c["artist"]))
    bias = F.when((a_dir >= 0.9) | (a_tok >= 0.9), 0.20).when((a_tok < 0.3) & (a_dir < 0.3), -0.15).otherwise(0.0)
    apart = F.abs(s["year"] - c["year"])
    year = F.when(apart <= 2, 0.06).when(apart > 5, -0.06).otherwise(0.0)
    far = F.abs(s["duration"] - c["duration"]) / F.greatest(s["duration"], c["duration"])
    there = (s["duration"] > 0) & (c["duration"] > 0)
    length = F.when(~F.coalesce(there, F.lit(False)), 0.0).when(far <= 0.05, 0.10).when(far <= 0.10, 0.05).when(far >= 0.25, -0.08).otherwise(0.0)
    base = 0.55 * phrase(s["title"], c["title"]) + 0.20 * overlap(s["title"], c["title"]) + 0.15 * F.greatest(a_dir, a_tok) + 0.05 * overlap(s["album"], c["album"])
    total = base + bias + series_bonus(s["series"], c["series"]) + year + length
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(total * 100, 1)))


#: Words and characters that a text of a track block is laid out with; tracks with more are compared one at a time.
WORDS, CHARS = 24, 160
#: What two totals of the same score in tenths differ by at most, and a little.
TENTH = 0.1 + 1e-6
WEIGHTLESS = frozenset(JUNK)


def series_flags(series: Column | str) -> Column:
    """The hints of a series that a text holds, as bits."""
    return sum((F.when(F.contains(col(series), F.lit(h)), 1 << i).otherwise(0) for i, h in enumerate(SERIES)), F.lit(0)).cast("int")


class _Texts:
    """Canonical texts of a track block by words: numbers of their words in order, distinct words with and without weight, letters."""

    def __init__(self, texts: list[str]):
        split = [t.split() for t in texts]
        self.long = np.array([len(w) > WORDS or len(t) > CHARS for w, t in zip(split, texts)], dtype=bool)
        split = [() if x else w for w, x in zip(split, self.long)]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for own in split for w in own))}
        self.words = np.full((len(texts), max(map(len, split), default=0)), -1, dtype=np.int32)
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.words[np.arange(self.words.shape[1]) < n[:, None]] = np.fromiter((self.numbers[w] for own in split for w in own), dtype=np.int32, count=int(n.sum()))
        self.n_words = n
        ordered = np.sort(self.words, axis=1)
        first = np.ones_like(ordered, dtype=bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        light = np.append(np.fromiter((w in WEIGHTLESS for w in self.numbers), dtype=bool, count=len(self.numbers)), False)
        self.n_junk = (first & light[ordered]).sum(axis=1)
        self.n_core = (first & (ordered >= 0)).sum(axis=1) - self.n_junk
        self.bytes = np.array(["" if x else t for t, x in zip(texts, self.long)], dtype=np.bytes_)
        self.lengths = np.strings.str_len(self.bytes)
        self.letters = np.fromiter((_letters(t) for t in texts), dtype=np.uint64, count=len(texts))

    def inside(self, text: str, rows: np.ndarray) -> np.ndarray:
        """Whether the text is part of each of the texts of rows."""
        own = np.uint64(_letters(text))
        out = (self.letters[rows] & own == own) & (self.lengths[rows] >= len(text))
        some = np.flatnonzero(out)
        out[some] = np.strings.find(self.bytes[rows[some]], text.encode()) >= 0
        return out

    def run(self, split: list[str], own: np.ndarray) -> np.ndarray:
        """Number of the words found in order, by rows of word numbers."""
        asked = np.array([*(self.numbers.get(w, -2) for w in split), -3], dtype=np.int32)
        i = np.zeros(len(own), dtype=np.int64)
        some = np.flatnonzero((own == asked[0]).any(axis=1))  # else nothing is found
        at = i[some]
        for column in own[some].T:
            at += asked[at] == column
        i[some] = at
        return i

    def overlap(self, split: list[str], rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``overlap`` of the words and each text of rows, in the same order of operations."""
        heavy, light = (list(dict.fromkeys(w for w in split if (w in WEIGHTLESS) == kind)) for kind in (False, True))

        def share(asked: list[str], n: np.ndarray) -> np.ndarray:
            both = np.zeros(len(rows), dtype=np.int64)
            for w in asked:
                if (at := self.numbers.get(w)) is not None:
                    both += (own == at).any(axis=1)
            return both / np.maximum(len(asked) + n - both, 1)

        if not heavy:
            return np.zeros(len(rows))
        core_ = self.n_core[rows]
        return np.where(core_ == 0, 0.0, np.minimum(1.0, share(heavy, core_) + 0.2 * share(light, self.n_junk[rows])))


def _letters(text: str) -> int:
    """The characters of a canonical text as bits."""
    bits = 0
    for ch in set(text):
        bits |= 1 << (ord(ch) & 63)
    return bits


class TrackBlock:
    """Described tracks of a library block, in the order of their norms, among which the best for a query by ``track_score`` are found.

    Totals are worked out as ``track_score`` does, in the same order of operations, but not rounded.
    Neither side has a duration.
    """

    def __init__(self, norms: list[str], index: list[list[str]], title: list[str], artist: list[str], album: list[str], series: np.ndarray, year: np.ndarray):
        self.norms, self.series, self.year = norms, series, year  # year: NaN where there is none
        self.texts = {"title": title, "artist": artist, "album": album}
        self.title, self.artist, self.album = map(_Texts, (title, artist, album))
        self.long = np.flatnonzero(self.title.long | self.artist.long | self.album.long)
        self.is_long = np.zeros(len(norms), dtype=bool)
        self.is_long[self.long] = True
        having: dict[str, list[int]] = {}
        for i, own in enumerate(index):
            for w in own:
                having.setdefault(w, []).append(i)
        self.having = {w: np.array(rows, dtype=np.int32) for w, rows in having.items()}

    def best(self, words_: list[str], title: str, artist: str, album: str, series: int, year: float, least: float = 0.0) -> tuple[float, list[int]]:
        """The highest total of 0..100 of the tracks that share one of the words, and the rows that may have the highest score: the first of each total within a tenth of it. None if ``least`` is more than a tenth higher."""
        there = np.zeros(len(self.norms), dtype=bool)
        for w in words_:
            if (rows := self.having.get(w)) is not None:
                there[rows] = True
        rows = np.flatnonzero(there)
        if not len(rows):
            return 0.0, []
        totals = self.totals(rows, title, artist, album, series, year)
        for i in np.flatnonzero(self.is_long[rows]):
            own = rows[i]
            totals[i] = total_number((title, artist, album, series, year), (*(self.texts[k][own] for k in ("title", "artist", "album")), int(self.series[own]), float(self.year[own])))
        totals = np.clip(totals * 100, 0.0, 100.0)
        top = float(totals.max())
        near = np.flatnonzero(totals >= max(top, least) - TENTH)
        return top, rows[near[np.unique(totals[near], return_index=True)[1]]].tolist()

    def totals(self, rows: np.ndarray, title: str, artist: str, album: str, series: int, year: float) -> np.ndarray:
        split = title.split()
        if title:
            own = self.title.words[rows]
            ordered = 0.8 * self.title.run(split, own) / max(len(split), 1)
            inside = self.title.inside(title, rows)
            t_dir = np.where(inside, np.where(self.title.lengths[rows] == len(title), 1.0, 0.9), ordered)
            t_tok = self.title.overlap(split, rows, own)
        else:
            t_dir = t_tok = np.zeros(len(rows))
        if artist:
            split, own = artist.split(), self.artist.words[rows]
            inside = self.artist.inside(artist, rows)
            a_dir = np.where(inside, 1.0, 0.8 * self.artist.run(split, own) / max(len(split), 1))
            a_tok = np.where(inside, 1.0, self.artist.overlap(split, rows, own))
        else:
            a_dir = a_tok = np.zeros(len(rows))
        albums = self.album.overlap(album.split(), rows, self.album.words[rows]) if album else np.zeros(len(rows))
        bias = np.where((a_dir >= 0.9) | (a_tok >= 0.9), 0.20, np.where((a_tok < 0.3) & (a_dir < 0.3), -0.15, 0.0))
        apart = np.abs(year - self.year[rows])
        years = np.where(apart <= 2, 0.06, np.where(apart > 5, -0.06, 0.0))
        base = 0.55 * t_dir + 0.20 * t_tok + 0.15 * np.maximum(a_dir, a_tok) + 0.05 * albums
        return base + bias + np.where(self.series[rows] & series != 0, 0.3, 0.0) + years


def total_number(s: tuple, c: tuple) -> float:
    """Total of a source and a candidate, both (title, artist, album, series, year), as ``track_score`` has it before it is rounded."""

    def directly(a: str, b: str) -> float:
        aw, i = a.split(), 0
        for w in b.split():
            i += i < len(aw) and w == aw[i]
        return 0.0 if not a or not b else 1.0 if a == b else 0.9 if a in b else 0.8 * i / max(len(aw), 1)

    def tokens(a: str, b: str) -> float:
        (ac, aj), (bc, bj) = (({w for w in x.split() if w not in WEIGHTLESS}, {w for w in x.split() if w in WEIGHTLESS}) for x in (a, b))
        share = lambda x, y: len(x & y) / max(len(x | y), 1)
        return min(1.0, share(ac, bc) + 0.2 * share(aj, bj)) if ac and bc else 0.0

    inside = s[1] != "" and s[1] in c[1]
    a_dir, a_tok = (1.0, 1.0) if inside else (directly(s[1], c[1]), tokens(s[1], c[1]))
    bias = 0.20 if a_dir >= 0.9 or a_tok >= 0.9 else -0.15 if a_tok < 0.3 and a_dir < 0.3 else 0.0
    apart = abs(s[4] - c[4])
    year = 0.06 if apart <= 2 else -0.06 if apart > 5 else 0.0
    base = 0.55 * directly(s[0], c[0]) + 0.20 * tokens(s[0], c[0]) + 0.15 * max(a_dir, a_tok) + 0.05 * tokens(s[2], c[2])
    return base + bias + (0.3 if s[3] & c[3] else 0.0) + year


# ---- the score by edit ratios


def ratio_score(q: dict[str, Column], c: dict[str, Column], text_ratio=ratio, normalised: bool = False) -> Column:
    """Whole score of fields that both have: twice the title's ratio, artist's and album's ratio, a step for the duration.

    0..200, since the title counts double in the mean but not in its divisor; ``normalised`` brings it to 0..100.
    """
    def part(k: str, weight: float) -> Column:
        x, y = squash(q[k]), squash(c[k])
        return F.when((x != "") & (y != ""), text_ratio(x, y) * weight)

    apart = F.abs(q["duration"] - c["duration"])
    length = F.when((q["duration"] != 0) & (c["duration"] != 0), F.when(apart <= 2, 100.0).when(apart <= 5, 80.0).when(apart <= 10, 60.0).otherwise(40.0))
    own = F.filter(F.array(part("title", 1.0 if normalised else 2.0), part("artist", 1.0), part("album", 1.0), length), lambda x: x.isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(own) == 0, F.lit(0)).otherwise((total / F.greatest(F.size(own), F.lit(1))).cast("int"))


# ---- weighted ratio, from its published definition


def clean(s: str) -> str:
    return " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())


def window_number(x: str, y: str) -> float:
    """Best edit ratio of the shorter text with any window of the longer that is as long, or cut off by its end."""
    x, y = sorted((x, y), key=len)
    return max(ratio_number(x, y[i : i + len(x)]) for i in range(len(y))) if x else 0.0


def weighted_ratio_number(a: str, b: str) -> int:
    """Best of plain, sorted-word, word-set and windowed ratios, the latter scaled by how different the lengths are."""
    a, b = clean(a), clean(b)
    if not a or not b:
        return 0

    def by_set(x: str, y: str, compare) -> float:
        sx, sy = set(x.split()), set(y.split())
        both = " ".join(sorted(sx & sy))
        one, two = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (sx - sy, sy - sx))
        return max(compare(both, one), compare(both, two), compare(one, two)) if both else compare(one, two)

    ordered = lambda s: " ".join(sorted(s.split()))
    times = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio_number(a, b)
    if times < 1.5:
        return round(max(plain, 0.95 * ratio_number(ordered(a), ordered(b)), 0.95 * by_set(a, b, ratio_number)))
    scale = 0.9 if times < 8 else 0.6
    return round(max(plain, scale * window_number(a, b), 0.95 * scale * window_number(ordered(a), ordered(b)), 0.95 * scale * by_set(a, b, window_number)))


class WeightedBlock:
    """Texts of a library block of which the most like a query by the weighted ratio are found without comparing each.

    Plain ratios are worked out for all texts at once; with the longest common subsequence they bound
    the windowed ones from above, and shared words from below. Only texts whose bounds differ and reach
    into the best k are compared in full, many at once.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        own = [clean(t) for t in texts]
        split = [t.split() for t in own]
        self.plain, self.ordered = TextBlock(own), TextBlock([" ".join(sorted(w)) for w in split])
        self.doubled = np.array([len(set(w)) < len(w) for w in split], dtype=bool)  # the others' words in order are their unique words in order
        self.repeats = np.flatnonzero(self.doubled)
        self.unique = TextBlock([" ".join(sorted(set(split[i]))) for i in self.repeats])
        self.place = np.cumsum(self.doubled) - 1
        self.unique_lengths = self.ordered.lengths.copy()
        self.unique_lengths[self.repeats] = self.unique.lengths
        self.words = [sorted(set(w)) for w in split]
        self.rank = np.empty(len(texts), dtype=np.int64)
        self.rank[sorted(range(len(texts)), key=lambda i: texts[i])] = np.arange(len(texts))
        self.having: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for x in w:
                self.having.setdefault(x, []).append(i)

    def top(self, query: str, k: int, at_least: int = 0) -> list[tuple[int, int]]:
        """(score, index) of the k best texts, ties by text; those below ``at_least`` may be left out."""
        q = clean(query)
        if not q or not self.texts:
            return [(0, i) for i in sorted(range(len(self.texts)), key=lambda i: self.texts[i])[:k]]
        n, lengths = len(q), self.plain.lengths
        both = np.full(len(self.texts), -1)  # length of the shared words
        for w in set(q.split()):
            both[self.having.get(w, [])] += len(w) + 1
        shares = both > 0
        q_ordered, q_unique = " ".join(sorted(q.split())), " ".join(sorted(set(q.split())))
        plain, ordered = self.plain.ratios(q), self.ordered.ratios(q_ordered)
        unique = ordered.copy() if q_unique == q_ordered else self.ordered.ratios(q_unique)
        unique[self.repeats] = self.unique.ratios(q_unique)

        def windowed(ratio: np.ndarray, m: int, other: np.ndarray) -> np.ndarray:
            common = ratio * (m + other) / 200.0
            return np.where(common > 0, 200.0 * common / (np.minimum(m, other) + common + 1e-9) + 1e-6, 0.0)

        times = np.maximum(lengths, n) / np.maximum(np.minimum(lengths, n), 1)
        scale = np.where(times < 8, 0.9, 0.6)
        near, empty = times < 1.5, lengths == 0
        by_unique = np.where(shares, 0.0, 0.95 * windowed(unique, len(q_unique), self.unique_lengths))
        by_windows = np.maximum(np.maximum(windowed(plain, n, lengths), 0.95 * windowed(ordered, n, self.ordered.lengths)), by_unique)
        by_set = np.where(shares & ~near & ~empty, np.where(times < 8, round(0.95 * 0.9 * 100.0), round(0.95 * 0.6 * 100.0)), 0)  # rounded as in full
        bare = np.where(empty, 0.0, np.where(near, np.maximum(plain, 0.95 * ordered), plain))
        floor = np.maximum(np.rint(bare - 1e-6).astype(int), by_set)
        # shared words with either's words, and both's words by the characters that they have in common in any order
        m, common = len(q_unique), self.ordered.bounds(q_unique) * (len(q_unique) + self.ordered.lengths)
        sets = np.maximum(200.0 * both / np.maximum(both + np.minimum(m, self.unique_lengths), 1), common / (m + self.unique_lengths)) + 1e-6
        others = np.where(near, np.maximum(bare, 0.95 * np.where(shares, sets, unique)), np.maximum(plain, scale * by_windows))
        roof = np.maximum(np.rint(np.where(empty, 0.0, np.minimum(others, 100.0)) + 1e-6).astype(int), floor)

        def by_words(rows: np.ndarray) -> np.ndarray:
            """Best ratio of shared words, with the query's others and with the texts' others; all three begin with the shared ones."""
            asked, groups, rest = q_unique.split(), {}, []
            for at, i in enumerate(rows):
                own = self.words[i]
                groups.setdefault(" ".join(w for w in asked if w not in own), []).append(at)
                rest.append(" ".join(w for w in own if w not in asked))
            block, shared, m, size = TextBlock(rest), both[rows], len(q_unique), self.unique_lengths[rows]
            lcs = shared.copy()
            for text, which in groups.items():
                more = block.lengths[which]
                lcs[which] += np.where((more > 0) & (text != ""), 1 + np.rint(block.ratios(text, np.array(which)) * (len(text) + more) / 200.0).astype(int), 0)
            return np.maximum(np.maximum(200.0 * shared / (shared + m), 200.0 * shared / (shared + size)), 200.0 * lcs / (m + size))

        def tighter(i: np.ndarray) -> np.ndarray:
            """Lower roofs of rows of other lengths than the query."""
            common = lambda ratio, m, other: np.rint(ratio[i] * (m + other[i]) / 200.0)
            sorted_ = self.ordered.windows_at_most(q_ordered, i, common(ordered, n, self.ordered.lengths))
            single = np.where(self.doubled[i] | (q_unique != q_ordered), by_unique[i], np.where(shares[i], 0.0, 0.95 * sorted_))
            most = np.maximum(self.plain.windows_at_most(q, i, common(plain, n, lengths)), np.maximum(0.95 * sorted_, single))
            return np.maximum(np.rint(np.minimum(np.maximum(plain[i], scale[i] * most), 100.0) + 1e-6).astype(int), floor[i])

        def full(rows: np.ndarray) -> np.ndarray:
            """The scores of rows, as ``weighted_ratio_number`` gives them."""
            by = np.zeros(len(rows))
            together = near[rows] & shares[rows]
            i = rows[together]
            by[together] = np.maximum(np.maximum(plain[i], 0.95 * ordered[i]), 0.95 * by_words(i))
            alike = near[rows] & ~shares[rows]
            i = rows[alike]
            by[alike] = np.maximum(np.maximum(plain[i], 0.95 * ordered[i]), 0.95 * unique[i])
            i = rows[~near[rows]]
            sorted_ = self.ordered.windows(q_ordered, i)
            single = sorted_.copy() if q_unique == q_ordered else self.ordered.windows(q_unique, i)
            twice = self.doubled[i]
            single[twice] = self.unique.windows(q_unique, self.place[i[twice]])
            s = scale[i]
            by[~near[rows]] = np.maximum(np.maximum(plain[i], s * self.plain.windows(q, i)), np.maximum(0.95 * s * sorted_, 0.95 * s * np.where(shares[i], 100.0, single)))
            return np.rint(by).astype(int)

        k = min(k, len(floor))
        tight, first = near | empty, True
        while True:
            least = max(np.partition(floor, -k)[-k], at_least)  # the k best scores are this at least
            rows = np.flatnonzero((roof > floor) & (roof >= least))
            if not len(rows):
                break
            rows = rows[np.argsort(-roof[rows], kind="stable")]
            loose = rows[~tight[rows]]
            if len(loose) and not first:
                roof[loose], tight[loose] = tighter(loose), True
                continue
            first, rows = False, rows[:BATCH]
            floor[rows] = roof[rows] = full(rows)
        rows = np.flatnonzero((roof == floor) & (floor >= least))
        return [(int(floor[i]), int(i)) for i in rows[np.lexsort((self.rank[rows], -floor[rows]))][:k]]


@F.pandas_udf(T.IntegerType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio_number(x or "", y or "") for x, y in zip(a, b)], dtype="int32")
