"""Personal information inside free text, found and replaced with typed placeholders.

A linear-chain conditional random field labels white-space tokens with BIO tags of five kinds.
Its features are the shape, affixes and words of a token and its neighbours; it is trained on the
driver from a small labelled table (bounded by ``COPIES`` fillings of each line, the same every
time), and its weights are sent to the tasks. Texts are decoded whole by Viterbi in numpy batches.
"""

from __future__ import annotations

import base64
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from trackloom.llm.labelled import sentences
from trackloom.session import spread

KINDS = ("email", "phone", "identity", "address", "name")
TAGS = ["O", *(p + k for k in KINDS for p in "BI")]
#: How far the field leans to names, since those of performers and titles are left out after it.
LEAN, NAMED = 0.3, [TAGS.index("Bname"), TAGS.index("Iname")]
OFFSETS = (-3, -2, -1, 0, 1, 2)
#: Features of a token that bear on its neighbours; the others bear on the token alone.
CONTEXT = ("w=", "e=", "h=", "r=", "lex=", "stop", "newline", "digit", "host", "@", "nd=")
#: Fillings of each line of the table, passes over it, sequences of a mini-batch, learning rate, and L2 penalty.
COPIES, EPOCHS, BATCH, RATE, PENALTY = 40, 8, 48, 0.15, 1e-4
TOKEN = re.compile(r"[^\s;。]+[;。]?|[;。]|[\r\n]\s*")
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = " \t\r\n\"'<>()[]{},;:!?。“”„»«"
KNOWN_TOKENS = 150_000
#: Folder of the public vocabularies that tell how usual a word is; marks of texts without capitals and without small letters.
VOCABULARIES, LOWER, UPPER = "/opt/tokenizers", "\x01", "\x02"


def allowed() -> np.ndarray:
    """Transitions that BIO forbids, as a matrix of 0 and -1e4."""
    k = len(TAGS)
    m = np.zeros((k, k), dtype=np.float32)
    for a in range(k):
        for b in range(k):
            if TAGS[b][0] == "I" and TAGS[a][1:] != TAGS[b][1:]:
                m[a, b] = -1e4
    return m


def lexicon(folder: str = VOCABULARIES) -> dict[str, str]:
    """Word (lower case) to how public vocabularies write it: "l" also in lower case, "C" with a capital only."""
    out: dict[str, str] = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
                if word[:1] == " " and word[1:].isalpha() and len(word) > 2:
                    if word[1:].islower():
                        out[word[1:]] = "l"
                    elif word[2:].islower():
                        out.setdefault(word[1:].lower(), "C")
    return out


def tokens_of(text: str) -> list[str]:
    """Tokens with digits made 0; in a text without capitals, or without small letters, each is marked as such."""
    for digit in "123456789":
        text = text.replace(digit, "0")
    found = TOKEN.findall(text)
    if mark := LOWER if text.islower() else UPPER if text.isupper() else "":
        return [mark + t for t in found]
    return found


def features(token: str, lex: dict[str, str]) -> list[str]:
    """Features of one token: shape, affixes, word, how usual it is in which case, and the punctuation around it."""
    flat = token[0] in LOWER + UPPER
    if flat:
        token = token[1:].lower()
    if token.isspace():
        return ["b", "newline"]
    core = token.strip(EDGE)
    low = core.lower()
    shape = re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", core)
    out = ["b", "w=" + low.rstrip("."), "s=" + re.sub(r"(.)\1{2,}", r"\1\1+", shape) + "~" * flat, "r=" + re.sub(r"(.)\1+", r"\1", shape) + "~" * flat, "e=" + token[-1:], "h=" + token[:1]]
    if not any(ch.isalnum() for ch in core):
        out.append("symbols")
    letters = low.rstrip(".")
    if letters[:1].isalpha():
        out += ["p3=" + letters[:3], "u3=" + letters[-3:], "u4=" + letters[-4:], "u2=" + letters[-2:]]
        case = "~" if flat else "U" if core.isupper() else "l" if core.islower() else "T" if core[0].isupper() else "m"
        known = lex.get(letters) or lex.get(letters.split("-")[0].split("’")[0].split("'")[0], "-")
        out += ["case=" + case, "lex=" + case + known, "lex=" + known, "stop=" + case + known + token[-1:] * (not token[-1:].isalnum()), f"len={min(len(letters), 12)}"]
    if any(ch.isdigit() for ch in core):
        out += ["digit", f"nd={min(12, sum(ch.isdigit() for ch in core))}", "d=" + re.sub(r"[^\W\d_]", "A", core)]
    if "@" in core:
        out.append("@" if len(core) > 1 and not core.startswith("@") else "handle")
    if "(at)" in low or re.search(r"\.(example|test|invalid|com|org|net|[a-z]{2})$", low):
        out.append("host")
    if token.endswith((";", ",", ":")):
        out.append("stop" + token[-1])
    return out


def tagged(runs: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Tokens of a labelled sentence and their tags; a token belongs to the item that it overlaps."""
    text, spans = "", []
    for part, kind in runs:
        if kind:
            spans.append((len(text), len(text) + len(part), kind))
        text += part
    tags, used = [], None
    for m in TOKEN.finditer(text):
        own = next((s for s in spans if s[0] < m.end() and s[1] > m.start()), None)
        tags.append(0 if own is None else TAGS.index(("I" if own == used else "B") + own[2]))
        used = own
    return tokens_of(text), tags


class Field:
    """Weights of the chain: one vector of tag scores for each feature and offset, transitions, and first tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, trans: np.ndarray, lex: dict[str, str]):
        self.names, self.weights, self.trans, self.lex = names, weights, trans, lex
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(OFFSETS), len(TAGS)), dtype=np.float32)

    def __getstate__(self):
        return {"names": self.names, "weights": self.weights, "trans": self.trans, "lex": self.lex}

    def __setstate__(self, state):
        self.__init__(**state)

    def lookup(self, token: str) -> int:
        n = self.ids[token] = len(self.ids)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        own = [self.names[f] for f in features(token, self.lex) if f in self.names]
        self.table[n] = self.weights[:, own].sum(axis=1) if own else 0
        self.table[n, OFFSETS.index(0), NAMED] += LEAN
        return n

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Tag scores of each token of a text from the tokens around it."""
        ids = self.ids
        at = np.fromiter((ids[t] if t in ids else self.lookup(t) for t in tokens), dtype=np.int64, count=len(tokens))
        n = len(at)
        out = self.table[at, OFFSETS.index(0)].copy()
        for o, d in enumerate(OFFSETS):
            if d < 0 and n > -d:
                out[-d:] += self.table[at[:d], o]
            elif d > 0 and n > d:
                out[:-d] += self.table[at[d:], o]
        return out

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Best tags of each token list by Viterbi, texts of like length together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        start = 0
        while start < len(order):
            longest = len(texts[order[min(len(order) - 1, start + 255)]])
            size = 256 if longest <= 2048 else max(1, 256 * 2048 // len(texts[order[-1]]))
            part = order[start : start + size]
            start += size
            if len(self.ids) > KNOWN_TOKENS:
                self.reset()
            length, n = len(texts[part[-1]]), len(part)
            v = np.zeros((length, len(TAGS), n), dtype=np.float32)  # emissions, then best scores up to each token
            for b, i in enumerate(part):
                v[: len(texts[i]), :, b] = self.scores(texts[i])
            ends = np.array([len(texts[i]) for i in part])
            v[0] += self.trans[0][:, None]
            step = self.trans[:, :, None]
            for t in range(1, length):
                v[t] += (v[t - 1][:, None, :] + step).max(axis=0)
            rows = np.arange(n)
            path = np.zeros((length, n), dtype=np.int8)
            tag = v[ends - 1, :, rows].argmax(axis=1)
            path[ends - 1, rows] = tag
            by_tag = np.ascontiguousarray(self.trans.T)
            for t in range(length - 1, 0, -1):
                tag = np.where(ends > t, (v[t - 1].T + by_tag[tag]).argmax(axis=1), tag)
                path[t - 1] = np.where(ends > t, tag, path[t - 1])
            for b, i in enumerate(part):
                out[i] = path[: ends[b], b]
        return out


def table_of_sequences(copies: int = COPIES, seed: int = 5, part: int | None = None) -> list[tuple[list[str], list[int]]]:
    """The labelled table as token sequences: lines joined as they follow one another in texts, some in capitals or small letters."""
    r = random.Random(seed)
    lines = sentences(copies, seed, part, [w for w, c in lexicon().items() if c == "l"])
    out = []
    i = 0
    while i < len(lines):
        n = r.choice((1, 2, 3, 4))
        runs: list[tuple[str, str]] = []
        for line in lines[i : i + n]:
            runs += [*line, (r.choice((" ", " ", "\n", ". ")), "")]
        i += n
        c = r.random()
        change = str.lower if c < 0.07 else str.upper if c < 0.14 else (lambda x: x)
        out.append(tagged([(change(t), k) for t, k in runs]))
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(1)
def train(copies: int = COPIES, seed: int = 5, part: int | None = None) -> Field:
    """Maximum likelihood by mini-batches: exact gradients from forward-backward, steps by AdaGrad."""
    data = table_of_sequences(copies, seed, part)
    types: dict[str, int] = {}
    for tokens, _ in data:
        for t in tokens:
            types.setdefault(t, len(types))
    count: dict[str, int] = {}
    lex = lexicon()
    feats = [features(t, lex) for t in types]
    for fs in feats:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n > 1 or f[:2] in ("w=", "b")))}
    flat = np.array([names[f] for fs in feats for f in fs if f in names])
    owner = np.repeat(np.arange(len(feats)), [sum(f in names for f in fs) for fs in feats])
    k, o_n = len(TAGS), len(OFFSETS)
    w = np.zeros((o_n, len(names), k))
    seen = np.array([[o == 0 or f.startswith(CONTEXT) for f in names] for o in OFFSETS])
    trans = np.zeros((k, k))
    sq_w, sq_t = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
    bar = allowed().astype(float)
    r = np.random.default_rng(seed)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    seqs = [(np.array([types[t] for t in ts]), np.array(ys)) for ts, ys in data if ts]
    for _ in range(EPOCHS):
        perm = r.permutation(len(seqs))
        for s in range(0, len(perm), BATCH):
            part = sorted((seqs[i] for i in perm[s : s + BATCH]), key=lambda x: -len(x[0]))
            length, n = len(part[0][0]), len(part)
            used = np.unique(np.concatenate([x for x, _ in part]))
            local = {u: i for i, u in enumerate(used)}
            pick = np.isin(owner, used)
            f_ids, f_own = flat[pick], np.searchsorted(used, owner[pick])
            table = np.zeros((o_n, len(used), k))
            cut_at = np.flatnonzero(np.r_[True, f_own[1:] != f_own[:-1]])
            table[:] = np.add.reduceat(w[:, f_ids], cut_at, axis=1)
            ids = np.full((length, n), -1)
            gold = np.zeros((length, n), dtype=int)
            for b, (x, y) in enumerate(part):
                ids[: len(x), b] = [local[v] for v in x]
                gold[: len(y), b] = y
            mask = ids >= 0
            e = np.zeros((length, n, k))
            shifted = []
            for o, d in enumerate(OFFSETS):
                sh = np.full_like(ids, -1)
                if d < 0:
                    sh[-d:] = ids[:d]
                elif d > 0:
                    sh[:-d] = ids[d:]
                else:
                    sh = ids
                ok = (sh >= 0) & mask
                shifted.append((ok, sh))
                e[ok] += table[o][sh[ok]]
            tr = trans + bar
            a = np.zeros((length, n, k))
            a[0] = e[0] + tr[0]
            for t in range(1, length):
                a[t] = np.where(mask[t][:, None], log_sum(a[t - 1][:, :, None] + tr, 1) + e[t], a[t - 1])
            z = log_sum(a[-1], 1)
            back = np.zeros((length, n, k))
            g_t = np.zeros((k, k))
            for t in range(length - 1, 0, -1):
                step = back[t] + e[t]
                pair = np.exp(a[t - 1][:, :, None] + tr + step[:, None, :] - z[:, None, None]) * mask[t][:, None, None]
                g_t -= pair.sum(axis=0)
                back[t - 1] = np.where(mask[t][:, None], log_sum(tr + step[:, None, :], 2), back[t])
                np.add.at(g_t, (gold[t - 1][mask[t]], gold[t][mask[t]]), 1.0)
            p = np.exp(a + back - z[None, :, None])
            g_t[0] -= p[0].sum(axis=0)
            np.add.at(g_t, (np.zeros(n, dtype=int), gold[0]), 1.0)
            g_e = -p
            tt, bb = np.nonzero(mask)
            g_e[tt, bb, gold[tt, bb]] += 1.0
            g_w = np.zeros((o_n, len(names), k))
            touched = np.unique(f_ids)
            for o, (ok, sh) in enumerate(shifted):
                g_tab = np.stack([np.bincount(sh[ok], g_e[ok][:, y], len(used)) for y in range(k)], axis=1)
                g_w[o] = np.stack([np.bincount(f_ids, g_tab[f_own, y], len(names)) for y in range(k)], axis=1)
            g = (g_w[:, touched] - PENALTY * n * w[:, touched]) * seen[:, touched, None]
            sq_w[:, touched] += g * g
            w[:, touched] += RATE * g / np.sqrt(sq_w[:, touched])
            g_t -= PENALTY * n * trans
            sq_t += g_t * g_t
            trans += RATE * g_t / np.sqrt(sq_t)
    del starts
    return Field(names, w.astype(np.float32), (trans + bar).astype(np.float32), lex)


TAG_KIND = [None, *(k for k in KINDS for _ in "BI")]
TAG_BEGINS = [False, *(p == "B" for _ in KINDS for p in "BI")]


def items(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, first token, token after the last) of the items in reading order."""
    out: list[tuple[str, int, int]] = []
    for i in np.flatnonzero(tags).tolist():
        kind = TAG_KIND[tags[i]]
        if not TAG_BEGINS[tags[i]] and out and out[-1][2] == i and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, i, i + 1))
    return out


def trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The span without the punctuation at its edges that belongs to the sentence."""
    edge = " \t\r\n\"'<>[]{},;:!?。“”„»«" + ("" if kind == "phone" else "()")
    while start < end and (text[start] in edge or text[start] == "." ):
        start += 1
    while end > start and (text[end - 1] in edge or text[end - 1] == "." and not re.search(r"\b(?:\w|[A-Za-z]{2,3})\.$", text[start:end]) or text[end - 1] == "." and kind not in ("address",)):
        end -= 1
    if kind == "phone" and text[start:end].count("(") != text[start:end].count(")"):
        start += text[start] == "("
        end -= end > start and text[end - 1] == ")"
    if kind == "email" and text[start:end].lower().startswith("mailto:"):
        start += 7
    return start, end


def proper(text: str, mixed: bool) -> bool:
    """Whether a name's first and last words and the parts of double names have capitals, as they must in a text of mixed letter case; no name is a letter and a hyphen."""
    words = text.split()
    if text[1:2] == "-":
        return False
    if not mixed or not words:
        return True
    return not (words[0][0].islower() or words[-1][0].islower() or any(p[:1].islower() for w in words for p in w.split("-")[1:]))


def spans(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters of each item."""
    at = [m.span() for m in TOKEN.finditer(text)]
    return [(k, *trimmed(text, at[i][0], at[j - 1][1], k)) for k, i, j in items(tags)]


# Words for rooms, ways after and before their names, prepositions and endings of ways in addresses.
ROOM = "flat|unit|apt|apartment|suite|room|floor|studio"
WAY = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|terrace|close|court|ct|way|crescent|place|pl|square|sq|hill|row|walk|green|gate|park|boulevard|blvd|mews|quay|grove|gardens|rise|rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|passage|sentier|square|faubourg"
STREET = r"c/|calle|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|ronda|travesía|carrer|rua|travessa|largo|praça|alameda|via|viale|piazza|corso|ulica|ul\."
BESIDE = "am|an der|an den|an dem|auf dem|auf der|hinter der|hinter dem|hinterm|im|in der|in den|unter den|unter der|vor dem|zum|zur|zu den|beim|bei der|neben der"
ENDING = "straße|strasse|str|weg|gasse|allee|platz|ring|damm|ufer|steig|hof|markt|graben|chaussee|winkel|park|straat|laan|gracht|gatan|vägen|vej|gade"
# What an item must hold to be one, as an exact check after decoding.
PROOF = {
    "email": re.compile(r"@|\bat\b", re.IGNORECASE), "phone": re.compile(r"^(?=(?:\D*\d){7})[\d\s()+./\\–-]*(?:,?\s*(?:ext|x|app|dw)\.?\s*\d+\)?)?$", re.IGNORECASE),
    "identity": re.compile(r"^(?=(?:\D*\d){5})[A-Za-z\d\s./-]*$"),
    "address": re.compile(rf"^(?=[^぀-ヿ一-鿿]*$)(?:(?:{ROOM})\.?\s*\w+,\s*)?(?:\d{{1,5}}\s?(?:[a-z]|bis|ter)?,?\s+(?=.*\b(?:{WAY})(?:\b|$)).*|(?:{STREET})\s*\S.*\d.*|(?:{BESIDE})\s+[^\W\d_].*\d.*|[^\d,;]*(?:{ENDING})\.?\s*\d.*)$", re.IGNORECASE | re.DOTALL),
    "name": re.compile(r"^[^\W\d_]+\.?ª?,?(?:[-’'][^\W\d_]+)*,?\s+(?![^぀-ヿ一-鿿]*[぀-ヿ一-鿿])[^\d\\_/;{}()]*[^\W\d_]{2}[^\d\\_/;{}()]*$"),
}
SPAN = "row long, doc_id long, kind string, start int, stop int, who array<long>"
#: Words after a person's name that may make it a performer's, as in "... Trio" or "... and the ...".
AFTER = 4


@lru_cache(100_000)
def folded(text: str) -> tuple[str, ...]:
    """Words of a text without case and accents."""
    if not text.isascii():
        text = "".join(ch for ch in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(ch))
    return tuple(LETTERS.findall(text.casefold()))


def key_of(words: tuple[str, ...]) -> int | None:
    """Key of a person or performer: its folded words in order of the alphabet, as a hash."""
    return xxhash.xxh64_intdigest(" ".join(sorted(words))) - 2**63 if words else None


def readings_of(text: str, start: int, stop: int) -> list[int]:
    """Keys under which a name may be a performer's or a title: alone, and with the next words, each without and with the word before."""
    before, after = text[max(0, start - 40) : start].split()[-1:], text[stop : stop + 80].split()[:AFTER]
    own, ahead = folded(text[start:stop]), folded(before[0]) if before else ()
    keys = {key_of(own): None, key_of(ahead + own): None}
    for w in after:
        if w := folded(w):
            own += w
            keys |= {key_of(own): None, key_of(ahead + own): None}
    return [k for k in keys if k is not None]


def decoder(model: Field):
    """Pandas function of (row, doc_id, text): the items of each text, those that pass the check."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = []
            for row, doc, t, y in zip(pdf["row"].tolist(), pdf["doc_id"].tolist(), texts, model.decode([tokens_of(t) if t else [] for t in texts])):
                if y.any():
                    mixed = not (t.islower() or t.isupper())
                    for kind, a, b in spans(t, y):
                        if PROOF[kind].search(t[a:b]) and (kind != "name" or proper(t[a:b], mixed)):
                            rows.append((row, doc, kind, a, b, readings_of(t, a, b) if kind == "name" else None))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "kind", "start", "stop", "who"])

    return run


def _known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"who": pd.Series([key_of(folded(c)) for c in pdf["text"]], dtype="Int64")})


def item_spans(docs: DataFrame, library: DataFrame | None = None, model: Field | None = None) -> DataFrame:
    """(doc_id, kind, nth, start, stop): the items; names that are an artist, title or album of ``library``, alone or with the words that follow, are left out by a join."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = spread(own).withColumn("row", F.monotonically_increasing_id()).mapInPandas(decoder(model or train()), SPAN)
    if library is not None:
        fields = [F.col(c).cast("string") for c in ("artist", "title", "album") if c in library.columns]
        texts = library.select(F.explode(F.array(*fields)).alias("text")).where("text is not null").distinct()
        names = texts.mapInPandas(_known, "who long").where("who is not null").distinct().withColumn("known", F.lit(True))
        item = ("row", "doc_id", "kind", "start", "stop")
        found = found.select(*item, F.explode_outer("who").alias("who")).join(names, "who", "left").groupBy(*item).agg(F.max("known").alias("known")).where("known is null")
    order = Window.partitionBy("doc_id", "kind").orderBy("start", "stop")
    return found.select("doc_id", "kind", F.row_number().over(order).cast("long").alias("nth"), "start", "stop")


def find_items(docs: DataFrame, library: DataFrame | None = None, model: Field | None = None) -> DataFrame:
    """(doc_id, kind, nth): one row an item, nth counting the items of a kind in the document from 1.

    Null, empty and blank texts have none; doc_id is the key of a document, rows that repeat it count
    on together; texts are decoded whole, whatever their length.
    """
    return item_spans(docs, library, model).select("doc_id", "kind", "nth")


@F.pandas_udf(T.StringType())
def _replace(texts: pd.Series, found: pd.Series) -> pd.Series:
    out = []
    for t, own in zip(texts, found):
        if t is not None and own is not None and len(own):
            parts, at = [], 0
            for s in sorted(own, key=lambda s: s["start"]):
                parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = s["stop"]
            t = "".join(parts) + t[at:]
        out.append(t)
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, library: DataFrame | None = None, model: Field | None = None) -> DataFrame:
    """(doc_id, text) with each item replaced by [EMAIL], [PHONE], [IDENTITY], [ADDRESS] or [NAME], the rest unchanged; null stays null."""
    found = item_spans(docs, library, model).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("found"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(found, "doc_id", "left").select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(_replace("text", "found")).alias("text"))
