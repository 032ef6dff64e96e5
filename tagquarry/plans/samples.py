"""Small audio files, byte by byte, from the public container specifications; and one of each format for each of the driver's parts."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.media import pieces
from .views import spread

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 3, 2, 8, 2, 0, 0, 0) + b"\0" * 8


def comments(pairs, vendor="v"):
    out = struct.pack("<I", len(vendor)) + vendor.encode() + struct.pack("<I", len(pairs))
    for k, v in pairs:
        x = f"{k}={v}".encode()
        out += struct.pack("<I", len(x)) + x
    return out


def picture(kind=3, mime="image/png", desc="d", data=PNG):
    return struct.pack(">II", kind, len(mime)) + mime.encode() + struct.pack(">I", len(desc)) + desc.encode() + struct.pack(">IIIII", 3, 2, 24, 0, len(data)) + data


def flac(pairs=(), pics=(), audio=b"\xff\xf8frames", padding=10, samples=44100):
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + (44100 << 44 | 1 << 41 | 15 << 36 | samples).to_bytes(8, "big") + b"m" * 16
    blocks = [(0, info), (4, comments(pairs)), *((6, picture(*p)) for p in pics), (1, b"\0" * padding)]
    return b"fLaC" + b"".join(bytes([k | (128 if i == len(blocks) - 1 else 0)]) + len(d).to_bytes(3, "big") + d for i, (k, d) in enumerate(blocks)) + audio


def safe(n):
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def frame(name, data, version=4):
    if version == 2:
        return name.encode() + len(data).to_bytes(3, "big") + data
    return name.encode() + (safe(len(data)) if version == 4 else len(data).to_bytes(4, "big")) + b"\0\0" + data


def text(name, value, enc=3, version=4):
    return frame(name, bytes([enc]) + value.encode({0: "latin-1", 1: "utf-16", 3: "utf-8"}[enc]), version)


def id3(*frames, version=4):
    body = b"".join(frames) + b"\0" * 10
    return b"ID3" + bytes([version, 0, 0]) + safe(len(body)) + body


def id3v1(title="Old", genre=17, track=5):
    return b"TAG" + title.encode().ljust(30, b"\0") + b"A".ljust(30, b"\0") + b"".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + bytes([0, track, genre])


def ape(items):
    body = b"".join(struct.pack("<II", len(v), 0) + k.encode() + b"\0" + v for k, v in items)
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + b"\0" * 8


def mpeg(n=4):
    return (b"\xff\xfb\x90\x00" + b"\0" * 413) * n


def xing(frames):
    return b"\xff\xfb\x90\x00" + b"\0" * 32 + b"Xing" + struct.pack(">II", 1, frames) + b"\0" * 369


def adts(n=5, size=20):
    total = 7 + size
    return (bytes([0xFF, 0xF1, 1 << 6 | 4 << 2, 2 << 6 | total >> 11, total >> 3 & 255, (total & 7) << 5, 0]) + b"\1" * size) * n


def chunk(name, data, big=False):
    return name + len(data).to_bytes(4, "big" if big else "little") + data + b"\0" * (len(data) & 1)


def wav(info=(), tag=b"", data=b"\1\0" * 44100):
    fmt = struct.pack("<HHIIHH", 1, 1, 44100, 88200, 2, 16)
    body = b"WAVE" + chunk(b"fmt ", fmt) + (chunk(b"LIST", b"INFO" + b"".join(chunk(k, v) for k, v in info)) if info else b"") + chunk(b"data", data) + (chunk(b"id3 ", tag) if tag else b"")
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def aiff(texts=(), frames=44100):
    comm = struct.pack(">HIH", 2, frames, 16) + struct.pack(">HQ", 16383 + 15, 44100 << 48)
    body = b"AIFF" + chunk(b"COMM", comm, True) + b"".join(chunk(k, v, True) for k, v in texts) + chunk(b"SSND", b"\0" * 8 + b"\2" * 40, True)
    return b"FORM" + len(body).to_bytes(4, "big") + body


def page(body, granule, flags, seq):
    lace = bytes([255] * (len(body) // 255) + [len(body) % 255])
    return b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, 7, seq, 0) + bytes([len(lace)]) + lace + body


def opus(pairs=()):
    head = b"OpusHead\1\2" + struct.pack("<HIhB", 312, 48000, 0, 0)
    return page(head, 0, 2, 0) + page(b"OpusTags" + comments(pairs), 0, 0, 1) + page(b"x" * 30, 960, 0, 2) + page(b"audio!", 48312, 4, 3)


def vorbis(pairs=()):
    head = b"\1vorbis" + struct.pack("<IBIiiiBB", 0, 2, 44100, 0, 0, 0, 0, 1)
    return page(head, 0, 2, 0) + page(b"\3vorbis" + comments(pairs), 0, 0, 1) + page(b"\5vorbis setup", 0, 0, 2) + page(b"audio", 88200, 4, 3)


def atom(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def mp4(items=(), titles=()):
    datum = lambda kind, d: atom(b"data", struct.pack(">II", kind, 0), d)
    ilst = atom(b"ilst", *(atom(k, datum(t, d)) if k != b"----" else atom(k, atom(b"mean", b"\0\0\0\0com.apple.iTunes"), atom(b"name", b"\0\0\0\0" + t.encode()), datum(1, d)) for k, t, d in items))
    chpl = atom(b"chpl", b"\1\0\0\0" + b"\0" * 4, bytes([len(titles)]), *(struct.pack(">QB", s * 10_000, len(t)) + t for s, t in titles)) if titles else b""
    entry = atom(b"mp4a", b"\0" * 16, struct.pack(">HHHH", 2, 16, 0, 0), struct.pack(">HH", 44100, 0))
    stbl = atom(b"stbl", atom(b"stsd", b"\0" * 4 + struct.pack(">I", 1), entry))
    mdhd = atom(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 1000, 2500, 0, 0))
    moov = atom(b"moov", atom(b"trak", atom(b"mdia", mdhd, atom(b"minf", stbl))), atom(b"udta", chpl, atom(b"meta", b"\0\0\0\0", ilst)))
    return atom(b"ftyp", b"M4A \0\0\0\0") + moov + atom(b"mdat", b"sound")


def element(ident, data):
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (1 << 56 | len(data)).to_bytes(8, "big") + data


def matroska(tags=(), doc=b"matroska", chapters=()):
    e = element
    simple = lambda k, v: e(0x67C8, e(0x45A3, k) + e(0x4487, v))
    info = e(0x1549A966, e(0x2AD7B1, (1_000_000).to_bytes(3, "big")) + e(0x4489, struct.pack(">d", 1500.0)))
    tracks = e(0x1654AE6B, e(0xAE, e(0x83, b"\2") + e(0x86, b"A_FLAC") + e(0xE1, e(0xB5, struct.pack(">d", 48000.0)) + e(0x9F, b"\2"))))
    body = b"".join(e(0x7373, e(0x63C0, e(0x68CA, bytes([level]))) + simple(k, v)) for level, k, v in tags)
    chap = e(0x1043A770, e(0x45B9, b"".join(e(0xB6, e(0x91, s.to_bytes(8, "big")) + e(0x92, t.to_bytes(8, "big")) + e(0x80, e(0x85, n) + e(0x437C, b"und"))) for s, t, n in chapters))) if chapters else b""
    segment = info + tracks + e(0x1254C367, body) + chap + e(0x1F43B675, b"cluster")
    return e(0x1A45DFA3, e(0x4282, doc)) + e(0x18538067, segment)


# Files of the driver's parts: each format's own structures, filled from a row


def _mark(key: int) -> bytes:
    """In each file, where the model doesn't look."""
    return b"KEEP%d." % key


def _flac(key, name, brand, kind, size):
    b = flac([("title", name), ("ARTIST", brand), ("tracknumber", f"{size}/60"), ("CHAPTER001", "00:00:01.500"), ("CHAPTER001NAME", kind), ("SYNCEDLYRICS", f"[offset:100]\n[00:01.50][00:03.00] {brand}\n[00:02.25]{kind}")], [(3,)], samples=size * 22050)
    at = b.index(b"\xff\xf8frames") - 14
    return b[:at] + b"\2\0\0" + bytes([4 + len(_mark(key))]) + b"test" + _mark(key) + b[at:]


def _chap(ident, start, end, title, version=4):
    return frame("CHAP", ident + b"\0" + struct.pack(">IIII", start, end, 0xFFFFFFFF, 0xFFFFFFFF) + text("TIT2", title, 0, version), version)


def _id3(key, name, brand, kind, size, version=4):
    """Text, a user's text, credits, two comments of which one is described, two owners, two chapters of one id, timed lyrics of two kinds, a picture, and a private frame."""
    t = lambda n, v: text(n, v, 3 if version == 4 else 1, version)
    comm = lambda desc, v: frame("COMM", b"\0eng" + desc + b"\0" + v.encode("latin-1"), version)
    sylt = lambda stamp, content: frame("SYLT", b"\0eng" + bytes([stamp, content]) + b"\0" + brand.encode("latin-1") + b"\0" + struct.pack(">I", 1000 + size), version)
    credit = "TIPL" if version == 4 else "IPLS"
    return id3(
        t("TIT2", name), t("TPE1", brand), t("TRCK", f"{size}/60"), t("TCON", "(17)" if version == 3 else "17"), frame("TXXX", b"\0LABEL\0" + kind.encode("latin-1"), version), frame(credit, f"\0producer\0{brand}\0gaffer\0{kind}".encode("latin-1"), version),
        *([frame("TMCL", f"\0drums\0{brand}".encode("latin-1"))] if version == 4 else []), comm(b"", f"c {size}"), comm(b"iTunNORM", _mark(key).decode()), frame("UFID", b"http://musicbrainz.org\0mb%d" % size, version), frame("UFID", b"other\0" + _mark(key), version),
        _chap(b"a", 2000, 3000, "later", version), _chap(b"a", 0, 2000, kind, version), sylt(2, 1), sylt(1, 1), sylt(2, 3), frame("APIC", b"\0image/png\0\3d\0" + PNG, version), frame("PRIV", b"me\0" + _mark(key), version), version=version,
    )


def _mp3(key, name, brand, kind, size):
    return _id3(key, name, brand, kind, size) + mpeg(size) + ape([("Comment", brand.encode())]) + id3v1()


def _mp3_v23(key, name, brand, kind, size):
    return _id3(key, name, brand, kind, size, 3) + xing(size * 2) + mpeg(4)


def _aac(key, name, brand, kind, size):
    return _id3(key, name, brand, kind, size) + adts(size * 10)


def _wav(key, name, brand, kind, size):
    return wav([(b"INAM", name.encode() + b"\0"), (b"IART", brand.encode()), (b"IENG", _mark(key))], data=b"\1\0" * (441 * size))


def _aiff(key, name, brand, kind, size):
    return aiff([(b"NAME", name.encode()), (b"AUTH", brand.encode()), (b"MARK", _mark(key))], frames=441 * size)


def _opus(key, name, brand, kind, size):
    return opus([("TITLE", name), ("ARTIST", brand), ("TRACKNUMBER", str(size)), ("CHAPTER009URL", _mark(key).decode())])


def _vorbis(key, name, brand, kind, size):
    return vorbis([("TITLE", name), ("ARTIST", brand), ("ALBUM ARTIST", kind), ("CHAPTER009URL", _mark(key).decode())])


def _mp4(key, name, brand, kind, size):
    return mp4([(b"\xa9nam", 1, name.encode()), (b"\xa9ART", 1, brand.encode()), (b"trkn", 0, struct.pack(">HHHH", 0, size, 60, 0)), (b"cpil", 21, bytes([size % 2])), (b"gnre", 0, struct.pack(">H", 18)), (b"covr", 14, PNG), (b"xxxx", 1, _mark(key))], [(0, brand.encode()), (1000 * size, kind.encode())])


def _matroska(key, name, brand, kind, size):
    b = matroska([(50, b"TITLE", kind.encode()), (30, b"TITLE", name.encode()), (30, b"ARTIST", brand.encode())], b"webm" if size % 2 else b"matroska", [(0, size * 10**9, brand.encode())])
    return b + b"\xec" + (1 << 56 | len(_mark(key))).to_bytes(8, "big") + _mark(key)


BUILDERS: dict[str, Callable[..., bytes]] = {"flac": _flac, "mp3": _mp3, "mp3_v23": _mp3_v23, "aac": _aac, "wav": _wav, "aiff": _aiff, "opus": _opus, "vorbis": _vorbis, "mp4": _mp4, "matroska": _matroska}


def kind_of(key: int) -> str:
    """The kind of a part's file where each is of another kind."""
    return list(BUILDERS)[key % len(BUILDERS)]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file is built from."""
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


def built(batches: Iterable[pa.RecordBatch], kind: str | None = None) -> Iterator[tuple[str, bytes]]:
    """Path and content of each part's file, one at a time; without a kind, one of each in turn."""
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns[:5])):
            k = kind or kind_of(r[0])
            yield f"{k}/{r[0]}", BUILDERS[k](*r)


def files(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """path (kind/part key), content: a file of that kind for each part; without a kind, one of each in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(built(batches, kind), lambda x: len(x[1])):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in piece], pa.string()), pa.array([c for _, c in piece], pa.binary())], ["path", "content"])

    return parts(spark, sf_dir).mapInArrow(run, "path string, content binary")
