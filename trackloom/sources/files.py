"""Audio files as a table: a Python data source that lists folders in parallel.

Spark's file sources leave out names that begin with "_" or "." and empty files; this one lists all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Suffixes of audio files, of the two scans.
AUDIO = (".flac", ".mp3", ".wav", ".m4a", ".ogg")
AUDIO_WIDE = (".flac", ".mp3", ".m4a", ".ogg", ".wav", ".aac", ".wma")


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.suffixes = tuple(options.get("suffixes", ",".join(AUDIO)).split(","))
        self.fold = options.get("fold", "true") == "true"

    def partitions(self) -> list[Folder]:
        """One partition a folder of the first level, and one for the files of each root."""
        out = []
        for root in self.roots:
            out.append(Folder(root, False))
            with os.scandir(root) as entries:
                out += [Folder(e.path, True) for e in entries if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        for at, folders, names in os.walk(partition.path):
            if not partition.deep:
                folders.clear()
            for name in names:
                if (name.lower() if self.fold else name).endswith(self.suffixes) and Path(name).suffix:
                    full = os.path.join(at, name)
                    try:
                        stat = os.stat(full)
                    except OSError:
                        continue  # an unreadable file is passed over
                    yield full, int(stat.st_mtime), stat.st_size


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "path string, mtime long, length long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def scan(spark: SparkSession, roots: list[str] | str, suffixes: tuple[str, ...] = AUDIO, fold: bool = True, missing: str = "error") -> DataFrame:
    """(path, mtime, length) of the audio files below the roots; suffixes match in any case if ``fold``.

    A root that is missing or no folder is an error, or is passed over if ``missing`` is "skip".
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    for r in roots:
        if missing != "skip" and not os.path.isdir(r):
            raise OSError(f"no folder: {r}")
    there = [r for r in roots if os.path.isdir(r)]
    if not there:
        return spark.createDataFrame([], "path string, mtime long, length long")
    spark.dataSource.register(FolderSource)
    return spark.read.format("folders").option("roots", "\n".join(there)).option("suffixes", ",".join(suffixes)).option("fold", str(fold).lower()).load()


def scan_flac(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, (".flac",))


def scan_wide(spark: SparkSession, roots: list[str]) -> DataFrame:
    """As the second engine lists: suffixes in small letters only, missing roots passed over."""
    return scan(spark, roots, AUDIO_WIDE, fold=False, missing="skip")
