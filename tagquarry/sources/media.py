"""Audio files as rows: a binaryFile scan and a parser over Arrow batches, one row a file.

Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch (64 MB), so large files come in small batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    from .containers import Media

EXTENSIONS = ("flac", "mp3", "m4a", "m4b", "mp4", "wav", "wave", "aiff", "aif", "aifc", "aac", "ogg", "oga", "opus", "mka", "mkv", "webm")
SCHEMA = (
    "path string, size long, format string, container string, "
    "tracks array<struct<codec:string,codec_profile:string,sample_rate:int,channels:int,bits_per_sample:int,total_samples:decimal(20,0),duration_ns:bigint,bitrate:int,md5:binary>>, "
    "tags array<struct<key:string,values:array<string>>>, pictures array<struct<type:int,mime:string,description:string,width:int,height:int,depth:int,colors:int,data:binary>>, "
    "chapters array<struct<start_ns:bigint,end_ns:bigint,title:string,language:string,hidden:boolean,disabled:boolean>>, "
    "synced_lyrics array<struct<language:string,description:string,lines:array<struct<time_ns:bigint,text:string>>>>, "
    "families array<struct<key:string,family:string,values:array<string>,selected:boolean,legacy:boolean>>, warnings array<struct<code:string,message:string>>, "
    "native array<struct<kind:string,size:bigint>>, essence_ranges array<struct<lo:bigint,hi:bigint>>, essence string, error struct<code:string,message:string>"
)
NAMES = ("path", "size", "format", "container", "tracks", "tags", "pictures", "chapters", "synced_lyrics", "families", "warnings", "native", "essence_ranges", "essence", "error")


def row(path: str, content: bytes | None, m: Media | None = None, only: Iterable[str] = NAMES) -> dict:
    """One media row; m: the content, parsed, where that has been done; only: the columns that are asked for, families and their warnings are left out where neither is. Bytes that can't be parsed give a row with an error, not a failed task."""
    from .containers import TooLarge, essence, parse

    out = dict.fromkeys(NAMES) | {"path": path, "size": len(content or b"")}
    try:
        b = content or b""
        m = m or parse(b)
        families = m.families() if "families" in only or "warnings" in only else []
        return out | {
            "format": m.format, "container": m.container, "tracks": m.tracks, "tags": m.tags(), "pictures": m.pictures, "chapters": m.chapters, "synced_lyrics": m.lyrics, "families": families,
            "warnings": [{"code": c, "message": x} for c, x in m.warnings], "native": [{"kind": k, "size": n} for k, n in m.native], "essence_ranges": [{"lo": lo, "hi": hi} for lo, hi in m.ranges], "essence": essence(b, m),
        }
    except TooLarge as e:
        return out | {"error": {"code": "too-large", "message": str(e)}}
    except ValueError as e:
        return out | {"error": {"code": "unsupported-format", "message": str(e)}}
    except Exception as e:  # any shape of broken bytes
        return out | {"error": {"code": "malformed", "message": f"{type(e).__name__}: {e}"}}


#: Rows and bytes of one Arrow batch that Python sends.
PIECE_ROWS, PIECE_BYTES = 1000, 1 << 22


def pieces(items: Iterable, size: Callable) -> Iterator[list]:
    """Lists of at most PIECE_ROWS items; one that holds PIECE_BYTES takes no more."""
    out, n = [], 0
    for x in items:
        out.append(x)
        n += size(x)
        if len(out) == PIECE_ROWS or n >= PIECE_BYTES:
            yield out
            out, n = [], 0
    if out:
        yield out


def map_rows(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterable[dict]], ddl: str) -> DataFrame:
    """Media rows, with whatever columns of their own they have, that `rows` makes of df's batches; only the columns that ddl names are turned into Arrow."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(rows(batches), lambda r: r["size"]):
            if "tracks" in schema.names:
                piece = [_decimal(r) for r in piece]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in piece], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def columns_ddl(columns: Iterable[str]) -> str:
    """Those columns of SCHEMA."""
    kinds = StructType.fromDDL(SCHEMA)
    return ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in columns)


def _decimal(r: dict) -> dict:
    from decimal import Decimal

    if r["tracks"]:
        r["tracks"] = [t | {"total_samples": Decimal(t["total_samples"])} for t in r["tracks"]]
    return r


def parse_media(files: DataFrame) -> DataFrame:
    """Rows of path, content to media rows; further columns are left out. A null content is an empty file, which no format takes."""
    return map_rows(files.select("path", "content"), lambda bs: (row(path, content.as_py()) for b in bs for path, content in zip(b.column(0).to_pylist(), b.column(1))), SCHEMA)


#: Bytes of a file that Spark's binaryFile takes as one value.
MAX_SIZE = (1 << 31) - 1


def _walk(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS))


def list_files(spark: SparkSession, path: str, max_size: int = MAX_SIZE) -> DataFrame:
    """Audio files below a folder by extension, in any case, up to max_size. Spark itself passes over names with a leading dot or underscore, and empty files."""
    return _walk(spark, path).where(F.col("length") <= max_size)


def read_media(spark: SparkSession, path: str, max_size: int = MAX_SIZE) -> DataFrame:
    """A row for each audio file; one beyond max_size is a row with the error `too-large`, its bytes unread."""
    # Without the content's column the bytes aren't read.
    large = _walk(spark, path).where(F.col("length") > max_size).select("path", "length")
    error = F.struct(F.lit("too-large").alias("code"), F.concat(F.col("length").cast("string"), F.lit(f" bytes, of {max_size} at most")).alias("message"))
    kinds = StructType.fromDDL(SCHEMA)
    known = {"path": F.col("path"), "size": F.col("length"), "error": error}
    rows = large.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
    return parse_media(list_files(spark, path, max_size)).unionByName(rows)


def inspect(media: DataFrame) -> DataFrame:
    """A cheap snapshot: everything but the pictures' bytes and the lyrics' lines."""
    return media.select("path", "size", "format", "container", "tracks", "tags", F.size("pictures").alias("n_pictures"), F.size("chapters").alias("n_chapters"), F.transform("warnings", lambda w: w["code"]).alias("codes"), "error", F.array_max(F.transform("tracks", lambda t: t["duration_ns"])).alias("duration_ns"), F.aggregate(F.filter("native", lambda n: n["kind"] == "PADDING"), F.lit(0).cast("long"), lambda a, n: a + n["size"]).alias("padding"))


def duplicates(media: DataFrame) -> DataFrame:
    """essence, n, paths of audio that several files hold."""
    return media.where("essence <> ''").groupBy("essence").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")
