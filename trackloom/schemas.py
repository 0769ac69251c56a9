"""Schemas of the library tables."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: Library with text track numbers and years, and the one with numbers and a duration.
LIBRARY_TEXT = _struct("path:string norm:string mtime:long artist:string album:string title:string track_number:string year:string format_json:string")
LIBRARY_TYPED = _struct("path:string norm:string mtime:long artist:string album:string title:string trackno:int year:int duration:int format_json:string")
FORMAT = _struct("sample_rate:int bits_per_sample:int channels:int")
PLAYLIST = _struct("pos:int track:string")
TRACKS = _struct("pos:int artist:string album:string title:string duration:int")
TABLES = ("flacs", "formats", "flac_tags")
