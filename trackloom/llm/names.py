"""Variant spellings of names typed by people, linked by entity.

Spellings are folded (case, accents) to keys. Candidate pairs come from exact bands: two keys that the
similarity accepts have partners for each other's rarest word (a mistyped word counts as usual as the
word it is near), so they meet by what those partners can be. Words a typing error apart meet by what
is left of them without a letter, long ones by MinHash bands over their q-grams, the number of bands
being tuned from the collision curve. A symmetric Monge-Elkan similarity over words that knows typos,
initials, nicknames, abbreviations, acronyms and numbers verifies the pairs; star clustering in rounds
makes the entities.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from trackloom.session import cut, spread

#: q-gram length, rows of a band, similarity from which words must meet, and the recall there.
Q, ROWS, MEET, RECALL = 3, 4, 0.5, 0.99
#: Letters from which a word's q-grams are banded (a typing error leaves words of that length alike by 0.73 and more); up to there it is listed without each of its letters.
LONG = 24
#: Similarity from which keys are one entity.
ACCEPT = 0.8
#: Keys of a band that meet in one part; larger bands are joined in parts.
PART = 200
# Joining words, and words with their usual short or other forms.
JOINERS = frozenset("the and of at in for from an und et".split())
FORMS = """
symphony sym symph|orchestra orch orchestre|philharmonic phil philh|volume vol|part pt|number no nr num|from fr|nights nites nite|sessions sess session
featuring feat ft|company co|brothers bros|saint st|mister mr|ensemble ens|quartet qt qtet|chamber ch|string str|music mus|band bd
"""
NICKNAMES = """
nathaniel nate nat|zacharias zach zack zachary|charles chuck charlie chas|robert rob bob bobby robbie bert|william bill will billy willie liam|katherine kate kathy kat katie kit
elizabeth liz beth betty eliza lizzie betsy|alexander alex sasha xander sandy al|michael mike mick mickey misha|nicholas nick nicky nico|christopher chris kit topher|matthew matt matty
andrew andy drew|anthony tony ant|benjamin ben benny benji|daniel dan danny|david dave davy|edward ed eddie ted ned teddy|frederick fred freddie freddy fritz rick|gabriel gabe
gregory greg gregor|harold harry hal|james jim jimmy jamie jem|jennifer jen jenny jenn|jonathan jon jonny john jonty|joseph joe joey|josephine jo josie|lawrence larry laurie lorry
leonard leo len lenny|leopold leo poldi|margaret maggie peggy meg greta rita|maximilian max|patricia pat patty trish tricia|penelope penny pen|peter pete|philip phil pip
rebecca becky becca|richard rick dick rich ricky richie|rosalind ros roz rosie lindy|samuel sam sammy|sebastian seb bastian|stephen steve stevie steph|susan sue susie suzy
theodore ted theo teddy|thomas tom tommy|timothy tim timmy|valentina val tina|victoria vicky vic tori|vincent vince vinnie vin|walter walt wally|wilhelmina mina minnie billie willa
dorothy dot dottie dolly|florence flo flossie|agnes aggie|tobias toby tobi|dmitri dima mitya|nikolai kolya nick|ulrich uli|konstantin kostya kon|lorenzo enzo|jacob jake
tadeusz tadek|gunther gunni|francoise fran fanny|deborah deb debbie|eleanor ellie nell nora|george geordie|henry hank harry hal|isabella bella izzy|judith judy|kenneth ken kenny
raymond ray|ronald ron ronnie|abigail abby|albert al bert|amelia amy millie|arthur art artie|barbara barb babs|caroline carrie caro|catherine cathy cat kate|donald don donnie
douglas doug|eugene gene|geoffrey geoff jeff|gerald gerry jerry|jessica jess jessie|martin marty|natalie nat|oliver ollie|pamela pam|russell russ|sandra sandy|virginia ginny
"""
ROMAN = {r: str(n) for n, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
COUNTED = frozenset("volume part number symphony disc cd chapter book act opus op".split())


def fold(text: str) -> str:
    """Case folded, without accents, blanks single."""
    flat = unicodedata.normalize("NFD", text.casefold())
    return " ".join("".join(ch for ch in flat if not unicodedata.combining(ch)).replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ı", "i").split())


def groups(table: str) -> dict[str, frozenset[int]]:
    out: dict[str, set[int]] = {}
    for n, g in enumerate(table.replace("\n", "|").split("|")):
        for w in g.split():
            out.setdefault(w, set()).add(n)
    return {w: frozenset(ns) for w, ns in out.items()}


NICK = groups(NICKNAMES)
FULL = {w: g.split()[0] for g in FORMS.replace("\n", "|").split("|") for w in g.split()}


@lru_cache(40_000)
def words_of(key: str) -> tuple[str, ...]:
    """Words of a folded key without joiners: long forms, numbers in digits; dotted capitals are one acronym."""
    key = re.sub(r"\b((?:[^\W\d_]\.){2,})", lambda m: m.group().replace(".", "") + " ", re.sub(r"(?<!\w)['’‘]?n['’‘](?!\w)", " and ", key).replace("@", " at ").replace("#", " no "))
    key = re.sub(r"\b(vol|volume|pt|part|no|nr)\.?(?=\d)", r"\1 ", key)
    raw = [FULL.get(w, w) for w in re.findall(r"[^\W_]+", re.sub(r"['’](?=s?\b)", "", key))]
    out: list[str] = []
    for i, w in enumerate(raw):
        if w in ROMAN and i and (raw[i - 1] in COUNTED):
            w = ROMAN[w]
        elif w.isdigit():
            w = w.lstrip("0") or "0"
        if w not in JOINERS:
            out.append(w)
    return tuple(out) or tuple(raw)


KEYBOARDS = "qwertyuiop asdfghjkl zxcvbnm|йцукенгшщзхъ фывапролджэ ячсмитьбю"  # fixed values: rows of keys


def _neighbours() -> frozenset[str]:
    """Pairs of letters on neighbouring keys."""
    out = set()
    for board in KEYBOARDS.split("|"):
        rows = board.split()
        for r, row in enumerate(rows):
            for i, ch in enumerate(row):
                near = row[i + 1 : i + 2] + (rows[r + 1][max(0, i - 1) : i + 1] if r + 1 < len(rows) else "")
                out |= {x for n in near for x in (ch + n, n + ch)}
    return frozenset(out)


NEAR = _neighbours()


@lru_cache(60_000)
def one_typo(a: str, b: str, least: int = 4) -> bool:
    """Whether one insertion, deletion, swap of neighbours or slip to a neighbouring key makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1 or len(a) < least:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] and a[i] + b[i] in NEAR or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def shortens(a: str, b: str) -> bool:
    """Whether a, of two to four letters, abbreviates b: its first letters, or its first letter and consonants in order."""
    if not 2 <= len(a) <= 4 or len(b) < 5 or a[0] != b[0]:
        return False
    if b.startswith(a):
        return len(a) > 2
    rest = iter(b)
    return not set(a[1:]) & set("aeiouy") and all(ch in rest for ch in a)


def word_sim(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a.isdigit() or b.isdigit():
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    if NICK.get(a, frozenset()) & NICK.get(b, frozenset()):
        return 0.95
    if one_typo(a, b):
        return 0.9
    return 0.85 if shortens(a, b) or shortens(b, a) else 0.0


def slip(w: str) -> bool:
    """Whether the word is a mistyped joiner."""
    return any(one_typo(w, j, 2) for j in ("the", "and", "from", "for"))


def monge_elkan(x: tuple[str, ...], y: tuple[str, ...]) -> float:
    """Smaller of both directions' mean best word similarity, words paired one to one; 0 if any word finds no partner."""
    x, y = _acronyms(x, y), _acronyms(y, x)
    if len(x) != len(y):
        x, y = (tuple(w for w in v if w in other or not slip(w)) for v, other in ((x, y), (y, x)))
    if len(x) != len(y) or not x:
        return 0.0
    left, total, exact, loose, slips = list(y), 0.0, 0, 0, 0
    for a in sorted(x, key=lambda w: (w not in y, -len(w), w)):
        best = max(left, key=lambda b: (word_sim(a, b), b == a))
        s = word_sim(a, best)
        if not s:
            return 0.0
        left.remove(best)
        exact += s == 1.0 and len(a) > 1
        loose += s < 1.0
        slips += s < 1.0 and min(len(a), len(best)) > 4 and one_typo(a, best)
        total += s
    if not exact and slips < len(x):  # without one word in common all must be long words slightly mistyped
        return 0.0
    return total / len(x) if loose <= 1 or loose < len(x) or slips == len(x) else 0.0


def _acronyms(x: tuple[str, ...], y: tuple[str, ...]) -> tuple[str, ...]:
    """x with each word that abbreviates a run of two to four words of y by their initials written out."""
    out: list[str] = []
    for w in x:
        if 2 <= len(w) <= 4 and w not in y:
            n = len(w)
            run = next((y[i : i + n] for i in range(len(y) - n + 1) if "".join(v[0] for v in y[i : i + n]) == w and all(len(v) > 1 for v in y[i : i + n])), None)
            if run and len(y) > n:
                out.extend(run)
                continue
        out.append(w)
    return tuple(out)


def bands(rows: int = ROWS, meet: float = MEET, recall: float = RECALL) -> int:
    """Bands for the wanted recall at similarity ``meet``: solves 1 - (1 - s^r)^b = recall, the collision curve."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meet**rows))


def qgrams(words: tuple[str, ...], q: int = Q) -> set[str]:
    return {p[i : i + q] for w in words for p in ["^" * (q - 1) + w + "$" * (q - 1)] for i in range(len(p) - q + 1)}


class Signer:
    """MinHash: each of n samples takes the q-gram of smallest hash, in bands of ROWS."""

    def __init__(self, n_bands: int):
        rng = np.random.default_rng(11)
        n = n_bands * ROWS
        self.mul, self.add = rng.integers(1, 2**61, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**61, n, dtype=np.uint64)

    def marks(self, word: str) -> list[int]:
        """Hashes of the word's bands."""
        grams = np.array([xxhash.xxh64_intdigest(g) for g in sorted(qgrams((word,)))], dtype=np.uint64)
        rows = ((grams[:, None] * self.mul + self.add) >> np.uint64(11)).min(axis=0).reshape(-1, ROWS)
        return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - 2**63 for i, row in enumerate(rows)]


def shortened(word: str) -> set[str]:
    """The word and what is left of it without any one letter: two words a typing error apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(field, mark, w) from (field, w): marks of which words a typing error apart share one."""
    signer = Signer(bands())
    for pdf in batches:
        rows = []
        for field, w in zip(pdf["field"], pdf["w"]):
            marks = {xxhash.xxh64_intdigest(v) - 2**63 for v in shortened(w)} if len(w) <= LONG else set()
            rows += [(field, m, w) for m in marks.union(signer.marks(w) if len(w) >= LONG else ())]
        yield pd.DataFrame(rows, columns=["field", "mark", "w"])


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(field, w, other), both ways, from (field, ws): words of one mark a typing error apart."""
    for pdf in batches:
        rows = [(field, a, b) for field, ws in zip(pdf["field"], pdf["ws"]) for a in ws for b in ws if a != b and one_typo(a, b)]
        yield pd.DataFrame(rows, columns=["field", "w", "other"])


MATES: dict[int, set[str]] = {}
for _w, _gs in NICK.items():
    for _g in _gs:
        MATES.setdefault(_g, set()).add(_w)


def reached(w: str, near: dict[str, list[str]]) -> set[str]:
    """The words that may be a word's partner as they are: itself, those a typing error away, its nicknames."""
    return {w, *near.get(w, ()), *(m for g in NICK.get(w, ()) for m in MATES[g])}


def _less(words: tuple[str, ...], *gone: str) -> list[str]:
    """The words without one of each of those gone."""
    left = list(words)
    for w in gone:
        left.remove(w)
    return left


def cue(w: str) -> str | None:
    """What is sure of the word that one of up to four letters may stand for: its initial, its first letter and a later consonant, or its first three letters."""
    if len(w) == 1:
        return w
    if not set(w[1:]) & set("aeiouy"):
        return w[:2]
    return f"{w[:3]}-" if len(w) > 2 else None


def cues(w: str) -> set[str]:
    """The ``cue`` of every shorter form of a word."""
    return {w[0]} if w.isdigit() or len(w) < 5 else {w[0], f"{w[:3]}-", *(w[0] + ch for ch in set(w[1:]) - set("aeiouy"))}


#: Sides of a band: a word's own rows meet each other and those that reach it; asking rows meet only those that reach them.
OWN, REACH, ASK = 0, 1, 2


def forms(words: tuple[str, ...], rarest: list[str], near: dict[str, list[str]]) -> set[tuple[str, int]]:
    """(form, side) of a name: any other that ``monge_elkan`` accepts shares a form with it, on a side that meets its own.

    Each name's rarest word r has a partner in the other. Either the two are each other's, or both
    are some other word's: then the names meet by the two partners together. A partner is told as it
    is (``=``), or, if it is short and r may be it in full, by its first letter (``*``; ``^`` where r
    is the short one), or its ``cue``. Where neither is told as it is, a word that both names have stands
    beside, since names without one are similar only by typing errors. Acronyms meet the initials of
    a run by the first letter of a word outside. Words that may be dropped as mistyped joiners are not
    the rarest, unless there are only such: then each is taken.
    """
    short = lambda w: len(w) <= 4 and not w.isdigit()
    whole = lambda w: len(w) > 4 and not w.isdigit()
    out: set[tuple[str, int]] = set()
    for r in rarest:
        rest, partners = _less(words, r), reached(r, near)
        out.add((f"= {r}", OWN))
        out |= {(f"= {p}", REACH) for p in partners if p != r}
        cut_r = [] if r.isdigit() else ["*" + r[0], "^" + r[0]] if short(r) else ["*" + r[0]]
        if cut_r:
            out |= {(f"{r[0]} {u}", REACH if short(r) else ASK) for u in rest if len(u) > 1}
        for w in set(rest):
            cut_w = ["*" + w[0]] if short(w) else ["^" + w[0]] if whole(w) else []
            out |= {(f"={p} {v}", ASK) for p in partners for v in ("=" + w, *cut_w)}
            out |= {(f"={w} {v}", REACH) for v in (*("=" + p for p in partners), *cut_r)}
            for u in {u for u in _less(tuple(rest), w) if len(u) > 1}:
                for c in cut_r:
                    out |= {(f"{c} {v} {u}", ASK) for v in cut_w if c[0] < v[0] or c[0] == v[0] == "^"}
                    out |= {(f"{v} {c} {u}", REACH) for v in cut_w if v[0] < c[0] or c[0] == v[0] == "^"}
                if short(w) and (c := cue(w)):
                    out |= {x for d in cues(r) for x in ((f"* {d} {c} {u}", ASK), (f"* {c} {d} {u}", REACH))}
    starts = lambda ws: {w[0] for w in ws} | ({""} if all(slip(w) for w in ws) else set())
    for i in range(len(words)):
        for j in range(i + 2, min(len(words), i + 4) + 1):
            if j - i < len(words) and all(len(w) > 1 for w in words[i:j]):
                out |= {(f"{''.join(w[0] for w in words[i:j])}. {c}", ASK) for c in starts(words[:i] + words[j:])}
    for w in {w for w in words if 2 <= len(w) <= 4}:
        rest = _less(words, w)
        out |= {(f"{w}. {c}", REACH) for c in starts(rest) | {p[0] for v in rest for p in reached(v, near)}}
    return out


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(band, id, side) from (field, id, words, rarest, near): the rows of a name's ``forms``."""
    for pdf in batches:
        ids, band, side = [], [], []
        for field, known, words, rarest, near in zip(pdf["field"], pdf["id"], pdf["words"], pdf["rarest"], pdf["near"]):
            own = forms(tuple(words), list(rarest), {x["w"]: list(x["others"]) for x in near} if near is not None else {})
            band += [xxhash.xxh64_intdigest(f"{field} {form}") - 2**63 for form, _ in own]
            side += [s for _, s in own]
            ids += [known] * len(own)
        yield pd.DataFrame({"band": np.array(band, dtype=np.int64), "id": np.array(ids, dtype=np.int64), "side": np.array(side, dtype=np.int32)})


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_words(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: list(words_of(k)))


@F.pandas_udf(T.BooleanType())
def slips(words: pd.Series) -> pd.Series:
    return words.map(slip).astype(bool)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([monge_elkan(words_of(x), words_of(y)) for x, y in zip(a, b)], dtype=float)


def near_words(df: DataFrame) -> DataFrame:
    """(field, w, other) from (field, w), both ways: words a typing error apart, of four letters or more."""
    marks = spread(df.where(F.length("w") >= 4).select("field", "w"), by_rows=True).mapInPandas(_marked, "field string, mark long, w string")
    met = marks.groupBy("field", "mark").agg(F.collect_list("w").alias("ws")).where(F.size("ws") > 1).select("field", "ws")
    return met.mapInPandas(_paired, "field string, w string, other string").distinct()


def candidates(keys: DataFrame) -> DataFrame:
    """(field, a, b), a < b: pairs of keys that share one of their ``forms``.

    Bands of many keys are joined in parts, so that no task gets one whole.
    """
    split = cut(keys.withColumn("words", split_words("key")).withColumn("id", F.xxhash64("field", "key")))
    words = split.select("field", "id", F.explode(F.array_distinct("words")).alias("w"))
    df = cut(words.groupBy("field", "w").agg(F.count("*").alias("df")))
    near = cut(near_words(df))
    most = near.join(df.withColumnRenamed("w", "other"), ["field", "other"]).groupBy("field", "w").agg(F.max("df").alias("most"))
    kind = F.when(F.length("w") <= 1, 3).when(slips("w"), 2).when(F.col("w").rlike("^[0-9]+$"), 1).otherwise(0)
    rarity = df.join(most, ["field", "w"], "left").select("field", "w", kind.alias("kind"), F.greatest("df", F.coalesce("most", F.lit(0))).alias("most"))
    ranked = words.join(rarity, ["field", "w"]).groupBy("field", "id").agg(F.sort_array(F.collect_list(F.struct("kind", "most", "w"))).alias("all"))
    first = F.col("all")[0]
    rarest = F.when(first["kind"] < 2, F.array(first["w"])).otherwise(F.transform(F.filter("all", lambda x: x["kind"] == 2), lambda x: x["w"]))
    # a name with no word of more than one letter is like no other
    ranked = ranked.where(first["kind"] < 3).select("field", "id", rarest.alias("rarest"), F.col("all.w").alias("every"))
    told = cut(ranked)
    # typing errors count for the rarest words, and beside a word that may be an acronym
    asked = told.select("field", "id", F.explode(F.when(F.exists("every", lambda w: F.length(w).between(2, 4)), F.col("every")).otherwise(F.col("rarest"))).alias("w"))
    others = near.groupBy("field", "w").agg(F.collect_list("other").alias("others"))
    known = asked.join(others, ["field", "w"]).groupBy("id").agg(F.collect_list(F.struct("w", "others")).alias("near"))
    names = told.select("id", "rarest").join(split.select("field", "id", "words"), "id").join(known, "id", "left")
    rows = cut(spread(names, by_rows=True).mapInPandas(_banded, "band long, id long, side int"))
    parts = rows.groupBy("band").agg(F.count("*").alias("m"), F.min("side").alias("low"), F.max("side").alias("high")).where(f"m > 1 and (low = {OWN} or low < high)").select("band", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    live = cut(rows.join(parts, "band"))
    a = live.select("band", F.col("id").alias("a"), F.col("side").alias("side_a"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    b = live.select("band", F.col("id").alias("b"), F.col("side").alias("side_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, ["band", "part"]).where(f"a < b and (side_a <> side_b or side_a = {OWN})").select("a", "b").distinct()
    # keys of equal hash are all taken: the similarity decides
    named = lambda c: split.select("field", F.col("id").alias(c), F.col("key").alias(f"{c}_key"), F.col("words").alias(f"{c}_words"))
    shown = pairs.join(named("a"), "a").join(named("b"), ["field", "b"]).where(comparable("a_words", "b_words"))
    return shown.select("field", F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))


def comparable(a: str, b: str) -> F.Column:
    """Whether names may be similar by the number of their words: equal, or one has a word so short that it may stand for several or for none."""
    short = lambda c: F.exists(c, lambda w: F.length(w).between(2, 5))
    return (F.size(a) == F.size(b)) | short(a) | short(b)


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(field, key, center): stars over the verified edges, by whole words, degree and weight.

    Keys without initials go before those with, since an initial may stand for several names. In every round each key that outweighs all its free neighbours becomes a center, and the free
    neighbours of centers join the best of them (similarity, then weight). Rounds end when no free
    key has a free neighbour; the key left alone is its own center.
    """
    both = edges.select("field", F.col("a").alias("key"), F.col("b").alias("other"), "sim").unionByName(edges.select("field", F.col("b").alias("key"), F.col("a").alias("other"), "sim"))
    both = cut(both)
    degree = both.groupBy("field", "key").agg(F.count("*").alias("degree"))
    whole = ~F.exists(F.split("key", " "), lambda w: F.length(F.regexp_replace(w, r"\W", "")) == 1)
    ranked = nodes.join(degree, ["field", "key"]).select("field", "key", F.struct(whole.alias("whole"), "degree", "n", "key").alias("rank"))
    other = ranked.select("field", F.col("key").alias("other"), F.col("rank").alias("other_rank"))
    live = cut(both.join(other, ["field", "other"]).join(ranked, ["field", "key"]))
    done = None
    while not live.isEmpty():  # the free key of highest rank becomes a center in every round
        top = live.groupBy("field", "key").agg(F.max("other_rank").alias("best"), F.first("rank").alias("rank")).where("rank > best").select("field", F.col("key").alias("other"))
        joined = live.join(top, ["field", "other"]).groupBy("field", "key").agg(F.max_by("other", F.struct("sim", "other_rank")).alias("center"))
        took = cut(joined.unionByName(top.select("field", F.col("other").alias("key"), F.col("other").alias("center"))))
        done = took if done is None else done.unionByName(took)
        gone = took.select("field", "key")
        live = cut(live.join(gone, ["field", "key"], "left_anti").join(gone.withColumnRenamed("key", "other"), ["field", "other"], "left_anti"))
    if done is None:
        return nodes.select("field", "key", F.col("key").alias("center"))
    return nodes.select("field", "key").join(done, ["field", "key"], "left").select("field", "key", F.coalesce("center", "key").alias("center"))


def cluster_names(values: DataFrame) -> DataFrame:
    """(field, name, center) from (field, name): the entity of each distinct spelling.

    Null and blank names have no rows; letter case and accents make different spellings of one
    key; ties go to the larger key. Repeated rows only add weight. An empty table gives no rows.
    """
    own = values.where(F.trim("name") != "").groupBy("field", "name").agg(F.count("*").alias("n")).withColumn("key", folded("name")).where("key <> ''")
    own = cut(own)
    keys = own.groupBy("field", "key").agg(F.sum("n").alias("n"))
    edges = candidates(keys.select("field", "key")).withColumn("sim", similarity("a", "b")).where(F.col("sim") >= ACCEPT)
    return own.join(star_clusters(keys, edges), ["field", "key"]).select("field", "name", "center")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """(field, name_a, name_b), name_a < name_b by code point: the spellings of one entity."""
    a = clusters.select("field", "center", F.col("name").alias("name_a"))
    b = clusters.select("field", "center", F.col("name").alias("name_b"))
    return a.join(b, ["field", "center"]).where("name_a < name_b").select("field", "name_a", "name_b")
