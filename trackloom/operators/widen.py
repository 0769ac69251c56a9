"""Entity, attribute, value rows to one typed row an entity.

Every pair is resolved first (key spelling to field, value to the field's type) in plain column
expressions, so that only known fields travel; the pairs of an entity are then pre-aggregated to
one value a field, gathered into a key-value map and projected into typed columns. Values that
cannot be read are kept: their number and first specimen beside the row, all of them by
``failures``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Usual names of the tags, in lower case without blanks and punctuation.
KEYS = {
    "title": "title tit2 tracktitle nam songtitle",
    "artist": "artist tpe1 trackartist art",
    "album": "album talb albumtitle alb",
    "albumartist": "albumartist tpe2 aart albumartistname",
    "genre": "genre tcon gen genrename",
    "isrc": "isrc tsrc isrccode",
    "trackno": "tracknumber track trck trackno tracknum trkn trackindex",
    "discno": "discnumber disc tpos disk disknumber discno diskno discnum disk discindex",
    "rel_year": "date year tdrc tyer releasedate releaseyear day tdrl relyear recordingdate",
    "seconds": "length duration tlen seconds tracklength",
    "bpm": "bpm tbpm tempo tmpo beatsperminute",
    "gain_db": "replaygaintrackgain rgtrackgain trackgain rgtrack",
    "is_compilation": "compilation tcmp itunescompilation cpil iscompilation partofacompilation",
}
TYPES = {f: "string" for f in ("title", "artist", "album", "albumartist", "genre", "isrc")} | {f: "int" for f in ("trackno", "discno", "rel_year", "seconds")}
TYPES |= {"bpm": "double", "gain_db": "double", "is_compilation": "boolean"}
BLANK = r"^[\s\p{Z}\x{FEFF}\x{200B}]*$"
YES, NO = "yes y true t 1 on ja oui si", "no n false f 0 off nein non"


def with_field(tags: DataFrame, key: str = "tag_key") -> DataFrame:
    """Add ``field``, the code (1..) of the field that the tag key names, null for other keys.

    A hash join with the fixed list above, some sixty rows whatever the data.
    """
    names = [(k, n) for n, ks in enumerate(KEYS.values(), 1) for k in dict.fromkeys(ks.split())]
    lookup = tags.sparkSession.createDataFrame(names, "bare string, field tinyint")
    return tags.withColumn("bare", F.regexp_replace(F.lower(F.col(key)), r"[^\p{L}\p{N}]", "")).join(F.broadcast(lookup), "bare", "left").drop("bare")


def code(field: str) -> int:
    return list(KEYS).index(field) + 1


def number(value: Column, unit: str) -> Column:
    """A decimal number with point or comma, any kind of minus and an optional unit, as double."""
    plain = F.translate(F.regexp_replace(F.lower(value), r"[\s\p{Z}]+", ""), "−–,", "--.")
    return F.regexp_extract(plain, rf"^([+-]?\d+(?:\.\d+)?)(?:{unit})?$", 1).try_cast("double")


def seconds(value: Column) -> Column:
    """Seconds of a number with or without unit, a clock time, or an ISO or worded duration, as int."""
    v = F.lower(F.regexp_replace(value, r"[\s\p{Z}]+", ""))
    clock = r"^(?:(\d+):)?(\d{1,3}):(\d{1,2}(?:[.,]\d+)?)$"
    worded = r"^(?:pt)?(?:(\d+)(?:h|hours?|hrs?|std))?(?:(\d+)(?:m|min|mins|minutes?|'))?(?:(\d+(?:[.,]\d+)?)(?:s|secs?|seconds?|''|\"))?$"

    def hms(pattern: str) -> Column:
        part = [F.coalesce(F.replace(F.regexp_extract(v, pattern, i), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3)]
        return part[0] * 3600 + part[1] * 60 + part[2]

    millis = number(value, "ms|msecs?|milliseconds?") / 1000
    total = (
        F.when(v.rlike(r"^[\d.,]+(ms|msecs?|milliseconds?)$"), millis)
        .when(v.rlike(clock), hms(clock))
        .when(v.rlike(r"\d(h|m|s|'|\")") & v.rlike(worded), hms(worded))
        .otherwise(number(value, "s|secs?|seconds?"))
    )
    return F.when(total >= 0, total).try_cast("int")


def year(value: Column) -> Column:
    """First year of four digits from 1900 to 2029, also at the head of a compact date."""
    alone = F.regexp_extract(value, r"(?<!\d)(19\d\d|20[0-2]\d)(?!\d)", 1)
    compact = F.regexp_extract(value, r"(?<!\d)(19\d\d|20[0-2]\d)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)", 1)
    return F.coalesce(alone.try_cast("int"), compact.try_cast("int"))


def read_value(field: Column, value: Column) -> Column:
    """Canonical string of the value as the field's type, or null if it cannot be read."""
    whole = F.regexp_extract(F.lower(value), r"^[\s\p{Z}]*(\d{1,9})[\s\p{Z}]*(?:(?:/|of)[\s\p{Z}]*\d*[\s\p{Z}]*)?$", 1).try_cast("int")
    word = F.lower(F.regexp_replace(value, r"[\s\p{Z}.]+", ""))
    flag = F.when(word.isin(*YES.split()), "true").when(word.isin(*NO.split()), "false")
    return (
        F.when(field.isin(*(code(f) for f, t in TYPES.items() if t == "string")), F.when(~value.rlike(BLANK), value))
        .when(field.isin(code("trackno"), code("discno")), whole.cast("string"))
        .when(field == code("rel_year"), year(value).cast("string"))
        .when(field == code("seconds"), seconds(value).cast("string"))
        .when(field == code("bpm"), number(value, "bpm").cast("string"))
        .when(field == code("gain_db"), number(value, "db").cast("string"))
        .when(field == code("is_compilation"), flag)
    )


def resolved(tags: DataFrame) -> DataFrame:
    """(path, field, tag_id, raw, value): pairs with the code of their field (null for other keys) and canonical value."""
    known = with_field(tags.where("path is not null").select("path", "tag_id", "tag_key", F.col("tag_value").cast("string").alias("raw")))
    return known.select("path", "field", "tag_id", F.when(F.col("field").isNotNull(), F.col("raw")).alias("raw"), read_value(F.col("field"), F.col("raw")).alias("value"))


def cells(tags: DataFrame) -> DataFrame:
    """(path, field, value, failed, first_failed): one row a path and field, after map-side pre-aggregation.

    Of several readable values the one with the smallest tag_id (then the smallest value) stands.
    A path without known keys has one row with a null field.
    """
    failed = F.col("value").isNull() & F.col("field").isNotNull()
    value = F.min(F.when(F.col("value").isNotNull(), F.struct("tag_id", "value"))).getField("value").alias("value")
    kept = (F.count_if(failed).alias("failed"), F.min(F.when(failed, F.struct("tag_id", "raw"))).getField("raw").alias("first_failed"))
    return resolved(tags).groupBy("path", "field").agg(value, *kept)


def wide(tags: DataFrame) -> DataFrame:
    """One row a path: the typed columns of ``TYPES`` and ``cast_failures``, a map of field to (n, first raw value).

    Null paths are no entities and dropped; null, blank and unknown keys fill no column; exact
    duplicates change nothing; a field none of whose values can be read is null and stands in
    ``cast_failures``. Further columns of the input are ignored. An empty table gives no rows.
    """
    there = F.when(F.col("field").isNotNull(), F.struct("field", F.struct("value", "failed", "first_failed")))
    maps = cells(tags).groupBy("path").agg(F.map_from_entries(F.collect_list(there)).alias("m"))
    cell = {f: F.try_element_at("m", F.lit(code(f)).cast("tinyint")) for f in TYPES}
    cols = [cell[f]["value"].cast(t).alias(f) for f, t in TYPES.items()]
    names = F.array(*map(F.lit, KEYS))
    bad = F.map_filter("m", lambda _, v: v["failed"] > 0)
    named = F.transform_keys(bad, lambda k, _: F.get(names, k - 1))
    return maps.select("path", *cols, F.transform_values(named, lambda _, v: F.struct(v["failed"].alias("n"), v["first_failed"].alias("first"))).alias("cast_failures"))


def filled(tags: DataFrame) -> DataFrame:
    """(path, field) of every non-null cell of the wide table."""
    w = wide(tags)
    entries = F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in TYPES))
    return w.select("path", F.explode(F.array_compact(entries)).alias("field"))


def failures(tags: DataFrame) -> DataFrame:
    """(tag_id, path, field, raw): every row of a known key whose value cannot be read, null values included."""
    name = F.get(F.array(*map(F.lit, KEYS)), F.col("field") - 1).alias("field")
    return resolved(tags).where("field is not null and value is null").select("tag_id", "path", name, "raw")
