import os
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from trackloom.llm import lookalike, mojibake, tokens

FLACS = "flac_id long, artist string, album string, title string, text string, field string, n int, word string"


def flacs(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y", 1, "z") for i, r in enumerate(rows)], FLACS)


CLEAN = [("Björn Gupukrolir", "Über den Dächern", "Señor Corazón"), ("Юрий Зикотрузанян", "Белый город", "Синий дождь"), ("Ann Lee", "Blue Sky", "Don’t Stop"), ("Ann Lee", "Zephyr²", "静かな雨")]


def garbled(text, wrong, right="utf8"):
    return "".join(chr(b) if w == "�" else w for b, w in ((b, bytes([b]).decode(wrong, "replace")) for b in text.encode(right)))


@pytest.mark.parametrize("wrong,right,text", [("cp1252", "utf8", "Björn Gupukrolir"), ("cp437", "utf8", "Über den Dächern"), ("cp1251", "utf8", "Señor Corazón"), ("mac_roman", "utf8", "Юрий Зикотрузанян"), ("latin1", "cp1251", "Белый город"), ("cp1251", "koi8_r", "Синий дождь"), ("latin1", "cp1252", "Don’t Stop")])
def test_restores(spark, wrong, right, text):
    bad = text.encode(right).decode("latin1") if wrong == "latin1" else garbled(text, wrong, right)
    assert bad != text
    r = {(x["flac_id"], x["field"]): x for x in mojibake.repair_fields(flacs(spark, [*CLEAN * 4, (bad, None, "")])).collect()}
    assert r[16, "artist"]["garbled"] and r[16, "artist"]["restored"] == text
    assert not any(x["garbled"] for k, x in r.items() if k[0] < 16)


def test_twice_and_lost(spark):
    twice = garbled(garbled("Björn Gupukrolir", "cp1252"), "cp1252")
    r = mojibake.repair_fields(flacs(spark, [*CLEAN, (twice, "Bj�rn Gupukrolir", "Qq�q")])).where("flac_id = 4").collect()
    out = {x["field"]: (x["garbled"], x["restored"]) for x in r}
    assert out == {"artist": (True, "Björn Gupukrolir"), "album": (True, "Björn Gupukrolir"), "title": (True, "Qq�q")}
    assert {tuple(x) for x in mojibake.garbled_fields(flacs(spark, [*CLEAN, (twice, None, None)])).collect()} == {(4, "artist")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([0x41, 0xC3, 0xA9, 0xE2, 0x80, 0x99, 0xF0, 0x9F])), max_size=7))
def test_byte_lattice_against_every_path(data):
    """The search finds a path as cheap as the cheapest of all ways to cut the bytes up."""

    def cheapest(i):
        if i == len(data):
            return 0.0
        costs = []
        for j in range(i + 1, min(len(data), i + 4) + 1):
            part = data[i:j]
            if len(part) == 1:
                costs.append((0.0 if part[0] is not None and part[0] < 0x80 else mojibake.LOSS) + cheapest(j))
            elif part[0] is not None and part[0] >= 0xC2 and len(part) <= (2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4) and all(x is None or 0x80 <= x < 0xC0 for x in part[1:]):
                try:
                    bytes(part).decode()
                    costs.append(-mojibake.SEQUENCE + cheapest(j))
                except (UnicodeDecodeError, TypeError):
                    costs.append(mojibake.LOSS + cheapest(j))
        return min(costs)

    r = mojibake.utf8_readings(data)
    assert (mojibake.LOSS * r[2] - mojibake.SEQUENCE * r[1] if r else 0.0) == cheapest(0)


def test_lost_words_compete(spark):
    """A damaged word stands for every corpus word that fits it; the more frequent one wins, the letter case of what is left counting."""
    rows = [("Björn", "x", "x")] * 6 + [("Bjárn", "x", "x")] * 2 + [("ZÜRICH", "x", "x")] * 3 + [("Zürich", "x", "x")] * 3 + [("Bj\ufffdrn", "Z\ufffdrich", "Z\ufffdRICH")]
    out = {x["field"]: x["restored"] for x in mojibake.repair_fields(flacs(spark, rows)).where(f"flac_id = {len(rows) - 1}").collect()}
    assert out == {"artist": "Björn", "album": "Zürich", "title": "ZÜRICH"}


def test_every_fitting_word_competes(spark):
    """The word that fits wins however many more frequent ones have the same skeleton: by what is left, and by letter case."""
    more = [f"Z{a}x{b}" for a in "áàâãäå" for b in "óòôõ"]  # all more frequent, with another last letter
    rows = [(w, None, None) for w in more for _ in range(3)] + [("Zýxü", "x", "x")] * 2 + [("Z\ufffdxü", "Z\ufffdx\ufffd", None)]
    out = {x["field"]: x["restored"] for x in mojibake.repair_fields(flacs(spark, rows)).where(f"flac_id = {len(rows) - 1}").collect()}
    assert out == {"artist": "Zýxü", "album": min(more)}
    upper = [(w, None, None) for w in more for _ in range(3)] + [("ZÝXÜ", None, None)] * 2 + [("Z\ufffdX\ufffd", None, None)]
    assert mojibake.repair_fields(flacs(spark, upper)).where(f"flac_id = {len(upper) - 1}").first()["restored"] == "ZÝXÜ"


def test_mojibake_edges(spark):
    rows = [(None, None, None), ("", " ", "é" * 5000), ("Ann", "Ann", "Ann")]
    assert mojibake.garbled_fields(flacs(spark, rows)).count() == 0
    assert mojibake.garbled_fields(flacs(spark, rows).limit(0)).count() == 0


PLAIN = {
    "Ｓｏｎｇｓ　ｆｒｏｍ": "Songs from", "Тhе Mefedopan Sessions": "The Mefedopan Sessions", "Мuѕіϲ for": "Music for", "Юрий Зикотpузанян": "Юрий Зикотрузанян", "a b": "a b", "ó": "ó", "Half‐gone": "Half-gone", "ﬁnal": "final",
    "Mus﻿ic": "Music", "Op͏en": "Open", "Νο. 5 Sky": "No. 5 Sky", "ｶﾞ": "ガ", "Үаrrow": "Yarrow", "Ѕіnglеѕ": "Singles",
}
PROPER = ["Белый город (Zuge)", "Νύχτα χωρίς φεγγάρι (Folasha)", "Zephyr²", "Don’t", "ガラスの庭", "조용한 거리", "Yağmurlu günler", "Дмитрий x Юрий", "№ 5", "", "Ævintýrið", "A – B"]


def test_plain():
    assert {k: lookalike.plain(k) for k in PLAIN} == PLAIN
    assert [lookalike.plain(t) for t in PROPER] == PROPER and lookalike.plain(None) is None
    assert lookalike.plain("Ａ" * 30000) == "A" * 30000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAоОсеrtτρνі ѕ２ｂ́​ é’ﬁЖλ"), max_size=20))
def test_plain_is_at_rest(text):
    once = lookalike.plain(text)
    assert lookalike.plain(once) == once == unicodedata.normalize("NFC", once)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=0xC0, max_codepoint=0x24F), st.characters(min_codepoint=0x300, max_codepoint=0x36F), st.characters(min_codepoint=0x1E00, max_codepoint=0x1EFF), st.characters(min_codepoint=0x1100, max_codepoint=0x11C2), st.sampled_from("aeiouAEO")), max_size=12))
def test_transducer_composes_as_unicode_does(text):
    """Where no character is of a compatibility form, the transducer's one pass gives the composed form."""
    if all(lookalike.plain_table().get(ch, ch) == unicodedata.normalize("NFC", ch) for ch in text):
        assert "".join(c + "".join(m) for c, m in lookalike.transducer().clusters(text)) == unicodedata.normalize("NFC", text)


def test_clusters_of_several_characters():
    machine = lookalike.transducer()
    assert machine.clusters("e\u0302\u0323") == machine.clusters("e\u0323\u0302") == [("ệ", [])]
    assert machine.clusters("\uff25\u0301") == [("É", [])] and machine.clusters("a\u200b\u0301") == [("á", [])]
    assert machine.clusters("q\u0301") == [("q", ["\u0301"])] and machine.clusters("\u1112\u1161\u11ab") == [("한", [])]
    assert len(machine.arcs) > 10_000


def test_tables_do_not_conflict():
    table = lookalike.plain_table()
    assert all(x not in table for out in table.values() for x in out) and len(table) > 1000
    lookalike.script_tables()


def test_disguised(spark, got):
    bad = garbled("Björn Gupukrolir", "cp1252")
    rows = [*CLEAN * 3, ("Тhе Sessions", bad, "ok"), (None, "", "a b")]
    assert got(lookalike.disguised_fields(flacs(spark, rows))) == [(12, "artist"), (13, "title")]
    full = {(r["flac_id"], r["field"]): r["plain"] for r in lookalike.plain_fields(flacs(spark, rows)).collect()}
    assert full[12, "artist"] == "The Sessions" and full[13, "album"] == "" and (13, "artist") not in full


needs_files = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@needs_files
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokens_any_text(text):
    from tokenizers import Tokenizer

    a = tokens.automaton()
    global _lib
    if "_lib" not in globals():
        _lib = Tokenizer.from_file(tokens.VOCABULARY)
        _lib.encode_special_tokens = True
    assert a.encode(text) == _lib.encode(text, add_special_tokens=False).ids
    assert a.decode(a.encode(text)) == text


@needs_files
def test_tokens_against_merging():
    """The automaton against plain merging, lowest merge first, over a small vocabulary."""
    merges = [(b"a", b"b"), (b"ab", b"a"), (b"b", b"a"), (b"a", b"a"), (b"aa", b"aa"), (b"aba", b"b"), (b"c", b"ab"), (b"cab", b"cab"), (b"aa", b"b")]
    vocab = {bytes([x]): i for i, x in enumerate(b"abc")}
    for x, y in merges:
        vocab.setdefault(x + y, len(vocab))
    machine = tokens.Automaton(vocab, merges)
    rank = {m: i for i, m in enumerate(merges)}
    r = random.Random(2)
    for _ in range(500):
        word = "".join(r.choices("abc", k=r.randrange(1, 14)))
        parts = [bytes([x]) for x in word.encode()]
        while True:
            found = min((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank) if any(p in rank for p in zip(parts, parts[1:])) else None
            if found is None:
                break
            best, out, i = found[0], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        assert machine.word(word) == [vocab[p] for p in parts], word


@needs_files
def test_encode_corpus(spark, library):
    texts = [None, "", " ", "Hello  world\n\n don't", "ガラスの庭 Ünï 🎵", "a" * 20000, "<|endoftext|>", "Hello  world\n\n don't"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(docs).collect()}
    assert out == {i: ids for i, ids in enumerate(library([t or "" for t in texts]))}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0
