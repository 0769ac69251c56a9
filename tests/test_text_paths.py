import pytest
from pyspark.sql import functions as F

from trackloom.functions import paths, text


@pytest.mark.parametrize("raw,want", [(None, ""), ("", ""), ("  A 　b\tC ", "a b c"), ("x" * 20000, "x" * 20000)])
def test_squash(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(text.squash("x")).first()[0] == want


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""), ("Title (Live) [Remix]", "title"), ("AC & DC+Q|x`y", "ac and dc and q x'y"), ("Ｓｏｎｇ", "song"), ("Привет", ""),
        ("Don’t", "don t"), ("(a)bp single track b", "a bp single track b"), ("é", ""), ("{x}y", "y"),
    ],
)
def test_canon(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.canon("x")).first()[0] == want


def test_words(spark):
    df = spark.createDataFrame([("don't stop the mix live at",)], "x string")
    r = df.select(text.index_words("x"), text.query_words("x"), text.core("x"), text.junk("x")).first()
    assert list(r) == [["don't", "stop", "the", "mix", "live"], ["don", "stop", "the", "mix", "live"], ["don't", "stop", "the", "at"], ["mix", "live"]]


CASES = [
    ("01 - Song", ("", "", "Song", 1, None)), ("50 Cent - In Da Club", ("Cent", "", "In Da Club", 50, None)), ("1999 - X", ("1999", "", "X", None, 1999)),
    ("Artist - (2020) Album - 02. Title", ("Artist", "", "(2020) Album - 02", None, 2020)), ("Artist - (2020) Album - 02. Title.flac", ("Artist", "(2020) Album", "Title", 2, 2020)),
    ("Mr. Brightside", ("", "", "Mr", None, None)), ("AC/DC - Thunderstruck", ("DC", "AC", "Thunderstruck", None, None)), ("foo.", ("", "", "foo.", None, None)),
    ("A - B/01 - Song.flac", ("A", "B", "Song", 1, None)), ("/m/Ann/Blue (1994)/07 - Sky.flac", ("Ann", "Blue (1994)", "Sky", 7, 1994)), (None, ("", "", "", None, None)), ("", ("", "", "", None, None)),
]


@pytest.mark.parametrize("raw,want", CASES)
def test_parse_path(spark, raw, want):
    df = paths.parse_path(spark.createDataFrame([(raw, 1)], "path string, title int"))
    r = df.select("artist", "album", "title", "trackno", "yr").first()
    assert tuple(r) == want


def test_parse_by_folder(spark, got):
    df = spark.createDataFrame([("/m/Ann/Blue (1994)/07 - Sky.flac",), ("x.flac",), (None,)], "path string")
    assert got(paths.parse_path_by_folder(df).select("artist", "album", "title", "trackno", "yr")) == [
        ("Ann", "Blue (1994)", "Sky", 7, 1994), (None, None, "", None, None), (None, None, "x", None, None)]


def test_stem_and_hidden(spark):
    df = spark.createDataFrame([("/a/._x.flac",), ("/a/.flac",), ("/a/b.c.flac",)], "path string")
    assert [tuple(r) for r in df.select(paths.stem("path"), paths.hidden("path")).collect()] == [("._x", True), (".flac", False), ("b.c", False)]


def test_query_text(spark):
    df = paths.parse_path(spark.createDataFrame([("ann/blue/07 - sky.flac",), ("plain words",)], "track string"), "track", "s_")
    out = [r[0] for r in df.select(paths.query_text("track", "s_artist", "s_title", "s_album")).collect()]
    assert out == ["ann sky blue", "plain words"]
    assert F is not None
