"""A folder of audio files as a stream of media rows: each new file is parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.media import EXTENSIONS, parse_media

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_media(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A streaming DataFrame of media rows; max_files bounds a micro-batch, not the stream."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return parse_media(files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)))
