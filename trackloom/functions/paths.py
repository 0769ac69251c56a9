"""Path functions and the two parsers that read metadata out of paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions.text import col, strip

NUMBERED = r"(?s)^([0-9]{1,3})[\s_.-]+(.+)$"  # fixed value: a leading track number
YEAR = r"(?:^|[^\p{L}\p{N}_])((?:19|20)[0-9]{2})(?:[^\p{L}\p{N}_]|$)"
DASH = " - "


def parts(path: Column | str) -> Column:
    """Components of a path without empty ones and dots; an absolute path begins with "/"."""
    p = col(path)
    own = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return F.when(p.startswith("/"), F.concat(F.array(F.lit("/")), own)).otherwise(own)


def back(path: Column | str, n: int) -> Column:
    """The n-th component from the end (1 the last), null beyond the first."""
    p = parts(path)
    return F.when(F.size(p) >= n, F.get(p, F.size(p) - n))


def stem(path: Column | str) -> Column:
    """Last component without its suffix; a dot at either end makes no suffix."""
    return F.regexp_replace(F.coalesce(back(path, 1), F.lit("")), r"(?s)^(.+)\.[^.]+$", "$1")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(back(path, 1), F.lit("")), r"(?s)^.+(\.[^.]+)$", 1))


def hidden(path: Column | str) -> Column:
    """Whether the file is an AppleDouble companion."""
    return F.element_at(F.split(col(path), "/"), -1).startswith("._")


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBERED), F.regexp_extract(c, NUMBERED, 1)).try_cast("int")


def _unnumbered(c: Column) -> Column:
    return F.when(c.rlike(NUMBERED), strip(F.regexp_extract(c, NUMBERED, 2))).otherwise(c)


def parse_path(df: DataFrame, path: str = "path", prefix: str = "") -> DataFrame:
    """Add artist, album, title (empty if not told), trackno and yr read from a path or a track text.

    The file name gives number, artist and title, also as "Artist - Album - 02. Title"; folders give what
    it lacks; the year is the first of four digits in album, folder and then components from the last.
    Null gives empty fields.
    """
    c = {k: f"{prefix}{k}" for k in ("artist", "album", "title", "trackno", "yr")}
    base = df.withColumn("_s", stem(F.coalesce(F.col(path), F.lit("")))).withColumn("_n", _number(F.col("_s"))).withColumn("_t", _unnumbered(F.col("_s")))
    cut = F.split("_t", DASH, 2)
    named = F.contains("_t", F.lit(DASH)) & (F.length(cut[0]) <= 80)
    base = base.withColumn("_a", F.when(named, _some(strip(cut[0])))).withColumn("_r", F.when(named, F.coalesce(_some(strip(cut[1])), F.col("_t"))).otherwise(F.col("_t")))
    segments = F.filter(F.transform(F.split("_r", DASH), strip), lambda s: s != "")
    base = base.withColumn("_g", F.when(F.col("_a").isNotNull() & F.contains("_r", F.lit(DASH)), segments))
    last = F.element_at("_g", -1)
    deep = F.coalesce((F.size("_g") >= 2) & last.rlike(NUMBERED), F.lit(False))
    base = base.withColumn("_deep", deep)
    album = F.when(F.col("_deep"), _some(strip(F.array_join(F.slice("_g", 1, F.greatest(F.size("_g") - 1, F.lit(0))), DASH))))
    title = F.when(F.col("_deep"), strip(F.regexp_extract(last, NUMBERED, 2))).otherwise(F.col("_r"))
    number = F.when(F.col("_deep") & (F.coalesce("_n", F.lit(0)) == 0), _number(last)).otherwise(F.col("_n"))
    base = base.withColumn("_al", album).withColumn("_p", F.coalesce(F.when(F.size(parts(path)) >= 2, F.when(back(path, 2) != "/", back(path, 2))), F.lit("")))
    pair = F.split("_p", DASH, 2)
    split = F.contains("_p", F.lit(DASH))
    up = F.when(back(path, 3) != "/", back(path, 3))
    artist = F.coalesce("_a", F.when(split, _some(strip(pair[0]))).otherwise(_some(up)))
    folder = F.coalesce("_al", F.when(split, _some(strip(pair[1]))).otherwise(_some(F.col("_p"))))
    base = base.withColumn(c["trackno"], number).withColumn(c["title"], title).withColumn(c["artist"], F.coalesce(artist, F.lit(""))).withColumn(c["album"], F.coalesce(folder, F.lit("")))
    order = F.concat(F.array(F.col(c["album"]), F.col("_p")), F.reverse(F.coalesce(parts(path), F.array().cast("array<string>"))))
    years = F.filter(F.transform(order, lambda x: F.regexp_extract(x, YEAR, 1)), lambda y: y != "")
    return base.withColumn(c["yr"], F.get(years, 0).try_cast("int")).drop("_s", "_n", "_t", "_a", "_r", "_g", "_deep", "_al", "_p")


def parse_path_by_folder(df: DataFrame, path: str = "path") -> DataFrame:
    """Add artist, album (null if there is no such folder), title, trackno and yr told by folder positions alone."""
    s = stem(path)
    return df.select(
        "*", back(path, 3).alias("artist"), back(path, 2).alias("album"), _unnumbered(s).alias("title"), _number(s).alias("trackno"),
        _some(F.regexp_extract(back(path, 2), r"\(([0-9]{4})\)", 1)).try_cast("int").alias("yr"),
    )


def query_text(track: Column | str, artist: Column | str, title: Column | str, album: Column | str) -> Column:
    """Text to search by: of a track that looks like a path its parsed fields, else the track itself."""
    t = col(track)
    pathlike = F.contains(t, F.lit("/")) | F.lower(t).endswith(".flac")
    return F.when(pathlike, F.concat_ws(" ", *(_some(col(x)) for x in (artist, title, album)))).otherwise(t)
