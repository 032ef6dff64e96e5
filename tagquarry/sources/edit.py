"""Edits over folders of files: parse, apply operations, write anew, verify; originals stay as they are."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as K
from ..functions.text import SPACE
from ..operators import tags as T
from .containers import Media, parse
from .media import NAMES, columns_ddl, map_rows, pieces, row
from .writers import KEEP, Sets, written

PICTURES = "array<struct<type:int,mime:string,description:string,data:binary>>"
CHAPTERS = "array<struct<start_ns:bigint,end_ns:bigint,title:string>>"
LYRICS = "array<struct<language:string,description:string,lines:array<struct<time_ns:bigint,text:string>>>>"


_INT = re.compile(r"[+-]?[0-9]+")

Op = tuple[str | None, str | None, list[str] | None]


def _side(x: str) -> bool:
    """Whether one side of a slash, trimmed, is blank or a 64-bit integer."""
    return x == "" or bool(_INT.fullmatch(x)) and len(x.lstrip("+-0")) < 20 and -(1 << 63) <= int(x) < 1 << 63


def prepared(tags: dict[str, list[str]], ops: list[Op]) -> dict[str, list[str]]:
    """What `operators.tags.prepare` gives, of one file: ops (kind, key, values) applied, tokens trimmed, pairs split (a slash wins unless the ops touch the total), empty keys dropped."""
    out = dict(tags)
    for kind, key, values in ops:
        if kind == "clear":
            out.pop(key, None)
        elif kind == "add":
            out[key] = None if values is None else [*(out.get(key) or ()), *values]
        else:
            out[key] = values
    for key, values in out.items():
        if values and key in K.TRIMMABLE:
            out[key] = [v if v is None else v.strip(SPACE) for v in values]
    touched = {key for _, key, _ in ops}
    for key, total in (("TRACKNUMBER", "TRACKTOTAL"), ("DISCNUMBER", "DISCTOTAL")):
        values = out.get(key)
        if values and len(values) == 1 and values[0] is not None and "/" in values[0]:
            n, t = (x.strip(SPACE) for x in values[0].split("/", 1))
            if (n or t) and _side(n) and _side(t):
                if n:
                    out[key] = [n]
                else:
                    del out[key]
                if t and total not in touched:
                    out[total] = [t]
    return {k: v for k, v in out.items() if v}


class Edited(NamedTuple):
    """content: null with an error; media: the content, parsed."""

    content: bytes | None
    changed: bool
    error: str | None
    media: Media | None


def edited(content: bytes | None, ops: list[Op] | None, sets: Sets = KEEP, strip: bool = False, m: Media | None = None) -> Edited:
    """One file's edit; m: the content, parsed, where that has been done. The outcome is parsed once, to be checked."""
    try:
        m = m or parse(content or b"")
        old = {t["key"]: t["values"] for t in m.tags()}
        new = old if ops is None else prepared(old, ops)
        if new == old and not strip and not sets.any():
            return Edited(content, False, None, m)
        out, again = written(content, new, sets, strip, m)
        return Edited(out, True, None, again)
    except Exception as e:  # any shape of broken bytes
        return Edited(None, False, str(e) or type(e).__name__, None)


def _ops(column: pa.ListArray) -> Iterator[list[Op] | None]:
    """The operations of each row, read off the flat arrays below the nested one."""
    flat = column.values
    values = flat.field("values")
    at, texts = values.offsets.to_pylist(), values.values.to_pylist()
    lists = [texts[lo:hi] if ok else None for lo, hi, ok in zip(at, at[1:], values.is_valid().to_pylist())]
    ops = list(zip(flat.field("kind").to_pylist(), flat.field("key").to_pylist(), lists))
    at = column.offsets.to_pylist()
    return (ops[lo:hi] if ok else None for lo, hi, ok in zip(at, at[1:], column.is_valid().to_pylist()))


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Edited]]:
    for b in batches:
        path, content, ops, *sets, strip = b.columns
        for p, c, o, x, y, z, s in zip(path, content, _ops(ops), *sets, strip):
            yield p.as_py(), edited(c.as_py(), o, Sets(x.as_py(), y.as_py(), z.as_py()), bool(s.as_py()))


def _given(files: DataFrame, ops: Column, pictures: Column | None, chapters: Column | None, lyrics: Column | None, strip: Column | None) -> DataFrame:
    sets = {"pictures": (pictures, PICTURES), "chapters": (chapters, CHAPTERS), "lyrics": (lyrics, LYRICS), "strip": (strip, "boolean")}
    return files.select("path", "content", ops.cast(T.OPS).alias("ops"), *((F.lit(None) if c is None else c).cast(kind).alias(n) for n, (c, kind) in sets.items()))


def rewrite(files: DataFrame, ops: Column, pictures: Column | None = None, chapters: Column | None = None, lyrics: Column | None = None, strip: Column | None = None) -> DataFrame:
    """path, content (the new file), changed, error of each file (path, content); ops: operations on the tags, the same or by the files' columns.

    pictures, chapters, lyrics: what takes the place of the file's own; null keeps them. strip: whether old tags behind the audio go. A file that can't be parsed or written has null content and an error; one whose tags don't change keeps its bytes.
    """
    # A file is read, changed, written and checked at one go, so its bytes cross to Python and back once and no list of files is held.
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("changed", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(((p, e.content, e.changed, e.error) for p, e in _edits(batches)), lambda r: len(r[1] or b"")):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece), schema)], schema=schema)

    return _given(files, ops, pictures, chapters, lyrics, strip).mapInArrow(run, "path string, content binary, changed boolean, error string")


def reread(files: DataFrame, ops: Column, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """The media rows, or those columns of them, of what rewrite makes of the files; the new files stay in Python."""
    return map_rows(_given(files, ops, None, None, None, None), lambda bs: (row(p, e.content, e.media, columns) for p, e in _edits(bs)), columns_ddl(columns))


def save(rewritten: DataFrame, source: str, folder: str) -> DataFrame:
    """Writes the new files below a folder that all executors share, by their paths below `source`; path, bytes of each. A file appears whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                local = path.removeprefix("file:").replace("///", "/")
                to = os.path.join(folder, os.path.relpath(local, source))
                os.makedirs(os.path.dirname(to), exist_ok=True)
                temp = f"{to}.{os.getpid()}.part"
                data = content.as_py()
                with open(temp, "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(temp, to)
                done.append((to, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return rewritten.where("content IS NOT NULL").select("path", "content").mapInArrow(run, "path string, bytes long")
