"""Container parsers: the bytes of one audio file to one media record. Plain Python over bytes, called from Arrow batches.

Every read is bounded by the file; broken bytes give a warning or an error in the record, never an exception.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib

from ..functions import vocabulary as K

GENRES = """Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial|Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|Ambient|Trip-Hop|Vocal|Jazz+Funk|Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise|Alt. Rock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|Ethnic|Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|Dream|Southern Rock|Comedy|Cult|Gangsta Rap|Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|Psychedelic|Rave|Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock|Folk|Folk-Rock|National Folk|Swing|Fast-Fusion|Bebop|Latin|Revival|Celtic|Bluegrass|Avantgarde|Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|Easy Listening|Acoustic|Humour|Speech|Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|Satire|Slow Jam|Club|Tango|Samba|Folklore|Ballad|Power Ballad|Rhythmic Soul|Freestyle|Duet|Punk Rock|Drum Solo|A Cappella|Euro-House|Dance Hall|Goa|Drum & Bass|Club-House|Hardcore|Terror|Indie|BritPop|Afro-Punk|Polsk Punk|Beat|Christian Gangsta Rap|Heavy Metal|Black Metal|Crossover|Contemporary Christian|Christian Rock|Merengue|Salsa|Thrash Metal|Anime|JPop|Synthpop|Abstract|Art Rock|Baroque|Bhangra|Big Beat|Breakbeat|Chillout|Downtempo|Dub|EBM|Eclectic|Electro|Electroclash|Emo|Experimental|Garage|Global|IDM|Illbient|Industro-Goth|Jam Band|Krautrock|Leftfield|Lounge|Math Rock|New Romantic|Nu-Breakz|Post-Punk|Post-Rock|Psytrance|Shoegaze|Space Rock|Trop Rock|World Music|Neoclassical|Audiobook|Audio Theatre|Neue Deutsche Welle|Podcast|Indie Rock|G-Funk|Dubstep|Garage Rock|Psybient""".split("|")


def genres(value: str) -> list[str]:
    """Names of a genre field: bare canonical numbers and leading (n), (RX), (CR) references are resolved, other text stays."""
    named = {"RX": "Remix", "CR": "Cover"}

    def one(ref: str) -> str | None:
        return named.get(ref) or (GENRES[int(ref)] if re.fullmatch(r"0|[1-9][0-9]{0,2}", ref) and int(ref) < len(GENRES) else None)

    if (whole := one(value)) is not None:
        return [whole]
    out, rest = [], value
    while m := re.match(r"\(([0-9A-Z]{1,3})\)", rest):
        if (name := one(m[1])) is None:
            break
        out.append(name)
        rest = rest[m.end() :]
    rest = rest[1:] if rest.startswith("((") else rest
    if rest:
        out.append(rest)
    return [g for i, g in enumerate(out) if not i or out[i - 1] != g]


#: Elements of one level, and lines of a timed lyric, that a parser takes.
MAX_ELEMENTS, MAX_LINES = 100_000, 65_536


class TooLarge(ValueError):
    """Beyond a limit of the parser: an error of the file, which is never read in part."""


def _counted(n: int) -> int:
    if n >= MAX_ELEMENTS:
        raise TooLarge(f"more than {MAX_ELEMENTS} elements")
    return n + 1


def frame_data(d: bytes, flags: int, version: int) -> bytes | None:
    """A frame's data as its format flags have it; null for an encrypted frame, or one that can't be unpacked."""
    if version == 4:
        packed, secret, grouped, length = flags & 8, flags & 4, flags & 64, flags & 1
        d = d[1 if grouped else 0 :]
        d = d[4 if length else 0 :]
        d = d.replace(b"\xff\x00", b"\xff") if flags & 2 else d
    else:
        packed, secret, grouped = flags & 128, flags & 64, flags & 32
        d = d[4 if packed else 0 :]
        d = d[1 if grouped and not secret else 0 :]
    if secret:
        return None
    if packed:
        try:
            return zlib.decompressobj().decompress(d, 1 << 28)
        except zlib.error:
            return None
    return d


class Media:
    def __init__(self):
        self.format = ""
        self.container = ""
        self.tracks: list[dict] = []
        self.items: list[tuple[str, str, str, str]] = []  # key, value, family, source
        self.legacy: list[tuple[str, str, str]] = []  # key, value, family
        self.pictures: list[dict] = []
        self.chapters: list[dict] = []
        self.lyrics: list[dict] = []
        self.warnings: list[tuple[str, str]] = []
        self.native: list[tuple[str, int]] = []
        self.ranges: list[tuple[int, int]] = []
        self.config = b""

    def warn(self, code: str, message: str = "") -> None:
        self.warnings.append((code, message))

    def add(self, key: str, value: str, family: str, source: str = "") -> None:
        if key and value is not None:
            self.items.append((key.upper(), value.replace("\0", ""), family, source or key))

    def pair(self, number: str, total: str, value: str, family: str, source: str) -> None:
        n, slash, t = value.partition("/")
        fine = lambda s: re.fullmatch(r"\s*[+-]?\d*\s*", s)
        if slash and fine(n) and fine(t) and (n.strip() or t.strip()):
            if n.strip():
                self.add(number, n.strip(), family, source)
            if t.strip():
                self.add(total, t.strip(), family, source)
        else:
            self.add(number, value, family, source)

    def picture(self, kind: int, mime: str, description: str, data: bytes) -> None:
        seen, w, h, depth = sniff_image(data)
        self.pictures.append({"type": kind if 0 <= kind <= 20 else 0, "mime": seen or ("application/octet-stream" if data else mime), "description": description, "width": w, "height": h, "depth": depth, "colors": 0, "data": data})
        if not seen and mime != "-->":
            self.warn("invalid-picture", mime)

    def chapter(self, start: int, end: int, title: str, language: str = "", hidden: bool = False, disabled: bool = False) -> None:
        self.chapters.append({"start_ns": start, "end_ns": end, "title": title, "language": language, "hidden": hidden, "disabled": disabled})

    def timed(self, lines: list[dict], language: str = "", description: str = "") -> None:
        if len(lines) > MAX_LINES:
            self.warn("synced-lyrics-truncated", str(len(lines)))
        self.lyrics.append({"language": language, "description": description, "lines": lines[:MAX_LINES]})

    def tags(self) -> list[dict]:
        out: dict[str, list[str]] = {}
        for key, value, _, _ in self.items:
            own = out.setdefault(key, [])
            if not (key in K.NUMBER_PAIR and own):
                own.append(value)
        for n, t in (("TRACKNUMBER", "TRACKTOTAL"), ("DISCNUMBER", "DISCTOTAL")):
            v = out.get(n)
            if v and len(v) == 1 and re.fullmatch(r"\s*[+-]?\d*\s*/\s*[+-]?\d*\s*", v[0]) and v[0].strip() != "/":
                a, b = (x.strip() for x in v[0].split("/"))
                if b and t not in out:
                    out[t] = [b]
                if a:
                    out[n] = [a]
                else:
                    del out[n]
        return [{"key": k, "values": v} for k, v in out.items()]

    def families(self) -> list[dict]:
        out: dict[tuple[str, str], dict] = {}
        for key, value, family, source in self.items:
            f = out.setdefault((key, family), {"key": key, "family": family, "values": [], "selected": True, "legacy": False, "_s": set()})
            f["values"].append(value)
            f["_s"].add(source)
        for f in out.values():
            if len(f["_s"]) > 1 and len({v.strip().lower() for v in f["values"]}) > 1:
                f["selected"] = False
                self.warn("conflicting-families", f["key"])
        own = {t["key"]: {v.strip().lower() for v in t["values"]} for t in self.tags()}
        for key, value, family in self.legacy:
            f = out.setdefault((key, family), {"key": key, "family": family, "values": [], "selected": True, "legacy": True})
            f["values"].append(value)
            f["selected"] &= key not in own or value.strip().lower() in own[key]
        return [{k: v for k, v in f.items() if k != "_s"} for f in out.values()]


def sniff_image(b: bytes) -> tuple[str, int, int, int]:
    """MIME, width, height, bits a pixel; an empty MIME for what is no known image."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 26:
        w, h, depth, kind = struct.unpack(">IIBB", b[16:26])
        return "image/png", w, h, depth * (1, 1, 3, 1, 2, 1, 4)[min(kind, 6)]
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 11:
        w, h, flags = struct.unpack("<HHB", b[6:11])
        return "image/gif", w, h, (flags & 7) + 1
    if b[:2] == b"BM" and len(b) >= 30:
        w, h, _, depth = struct.unpack("<iiHH", b[18:30])
        return "image/bmp", w, abs(h), depth
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        if b[12:16] == b"VP8X" and len(b) >= 30:
            return "image/webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), 24
        return "image/webp", 0, 0, 0
    if b[:4] in (b"II*\0", b"MM\0*"):
        return "image/tiff", 0, 0, 0
    if b[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            m, n = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return "image/jpeg", w, h, b[at + 4] * (b[at + 9] if at + 9 < len(b) else 3)
            at += 2 + n if n >= 2 else len(b)
        return "image/jpeg", 0, 0, 0
    return "", 0, 0, 0


def track(codec: str, rate: int, channels: int, bits: int = 0, samples: int = 0, ns: int | None = None, size: int = 0) -> dict:
    ns = int(samples / rate * 1e9) if ns is None and rate > 0 else ns or 0
    bps = int(size * 8 / (ns / 1e9)) if ns > 0 and size > 0 else 0
    return {"codec": codec, "sample_rate": rate, "channels": channels, "bits_per_sample": bits, "total_samples": samples, "duration_ns": ns, "bitrate": bps if bps < 2147483647 else 0}


# ID3, APE


def syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | (b[3] & 127)


def id3_size(b: bytes, at: int = 0) -> int:
    """Bytes of an ID3v2 tag at a place; 0 if there is none."""
    if b[at : at + 3] != b"ID3" or len(b) < at + 10 or max(b[at + 6 : at + 10]) > 127 or b[at + 3] > 4:
        return 0
    return 10 + syncsafe(b[at + 6 : at + 10]) + (10 if b[at + 5] & 16 else 0)


def frame_text(enc: int, b: bytes) -> list[str]:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(enc, "latin-1")
    if enc == 1 and b[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        codec = "utf-16-le"
    s = b.decode(codec, "replace")
    parts = [x.lstrip("﻿") for x in s.split("\0")]
    while len(parts) > 1 and not parts[-1]:
        parts.pop()
    return parts


def cut_string(enc: int, b: bytes) -> tuple[str, bytes]:
    """A terminated string and what follows."""
    if enc in (1, 2):
        at = 0
        while at + 1 < len(b) and b[at : at + 2] != b"\0\0":
            at += 2
        return frame_text(enc, b[:at])[0] if at else "", b[at + 2 :]
    head, _, rest = b.partition(b"\0")
    return frame_text(enc, head)[0], rest


def id3v2(m: Media, b: bytes, family: str = "id3v2") -> None:
    version, flags = b[3], b[5]
    body = b[10 : 10 + syncsafe(b[6:10])]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 64 and version >= 3 and len(body) >= 4:
        n = syncsafe(body[:4]) if version == 4 else int.from_bytes(body[:4], "big") + 4
        body = body[min(n, len(body)) :]
    at, head = 0, 6 if version == 2 else 10
    dates: dict[str, str] = {}
    chaps: dict[bytes, list[tuple]] = {}
    order: list[bytes] = []
    while at + head <= len(body) and body[at]:
        if version == 2:
            name, n, fl = body[at : at + 3], int.from_bytes(body[at + 3 : at + 6], "big"), 0
        else:
            name, n = body[at : at + 4], syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
            fl = body[at + 9]
        if not re.fullmatch(rb"[A-Z0-9]+", name) or at + head + n > len(body):
            m.warn("tag-structure-dropped", repr(name))
            break
        data = body[at + head : at + head + n]
        at += head + n
        f = name.decode()
        if version > 2 and (data := frame_data(data, fl, version)) is None:
            m.warn("tag-structure-dropped", f)
        f = K.ID3_V22.get(f, f) if version == 2 else f
        if data:
            _frame(m, f, data, family, dates, chaps, order, version)
    for frame, key in (("TDRC", "RECORDINGDATE"), ("TDRL", "RELEASEDATE"), ("TDOR", "ORIGINALDATE")):
        v = dates.get(frame)
        if frame == "TDRC" and v is None and (y := dates.get("TYER")):
            v = y
            if re.fullmatch(r"\d{4}", y) and re.fullmatch(r"\d{4}", dates.get("TDAT", "")):
                v += f"-{dates['TDAT'][2:]}-{dates['TDAT'][:2]}"
                if re.fullmatch(r"\d{4}", dates.get("TIME", "")):
                    v += f"T{dates['TIME'][:2]}:{dates['TIME'][2:]}"
        v = dates.get("TORY") if frame == "TDOR" and v is None else v
        if v:
            m.add(key, v, family, frame)
    # Of several with one id, the table of contents takes the first first.
    listed = [chaps[i].pop(0) for i in order if chaps.get(i)]
    for start, end, title in sorted([*listed, *(c for cs in chaps.values() for c in cs)], key=lambda c: c[0]):
        m.chapter(start, end, title)
    m.native.append(("ID3v2", len(b)))


def _frame(m: Media, f: str, d: bytes, family: str, dates: dict, chaps: dict, order: list, version: int) -> None:
    enc = d[0]
    if f == "TXXX":
        desc, rest = cut_string(enc, d[1:])
        up = desc.upper()
        key = K.ID3_TXXX.get(up) or K.ALIASES.get(up, up)
        for v in frame_text(enc, rest):
            m.add(key, v, family, f"TXXX\0{up}")
    elif f in ("TYER", "TDAT", "TIME", "TORY", "TDRC", "TDRL", "TDOR"):
        dates.setdefault(f, frame_text(enc, d[1:])[0].strip())
    elif f == "TCON":
        for v in frame_text(enc, d[1:]):
            names = genres(v)
            if names != [v]:
                m.warn("numeric-genre", v)
            for g in names:
                m.add("GENRE", g, family, f)
    elif f in ("TRCK", "TPOS"):
        n, t = ("TRACKNUMBER", "TRACKTOTAL") if f == "TRCK" else ("DISCNUMBER", "DISCTOTAL")
        m.pair(n, t, frame_text(enc, d[1:])[0], family, f)
    elif f in ("TIPL", "IPLS", "TMCL"):
        pairs = frame_text(enc, d[1:])
        for role, who in zip(pairs[::2], pairs[1::2]):
            if f == "TMCL":
                m.add("PERFORMER", f"{who} ({role})" if role else who, family, f)
            elif key := K.ID3_ROLES.get(role.strip().lower()):
                m.add(key, who, family, f"{f}\0{role}")
    elif f in K.ID3_FRAMES:
        for v in frame_text(enc, d[1:]):
            m.add(K.ID3_FRAMES[f], v, family, f)
    elif f in ("COMM", "USLT") and len(d) > 4:
        desc, rest = cut_string(enc, d[4:])
        if f == "USLT" or not desc:
            m.add("LYRICS" if f == "USLT" else "COMMENT", frame_text(enc, rest)[0], family, f)
    elif f == "UFID":
        owner, _, ident = d.partition(b"\0")
        if owner == b"http://musicbrainz.org":
            m.add("MUSICBRAINZ_TRACKID", ident.decode("latin-1"), family, f)
    elif f == "APIC":
        if version == 2 and len(d) > 5:
            mime, kind, rest = {b"JPG": "image/jpeg", b"PNG": "image/png"}.get(d[1:4], d[1:4].decode("latin-1")), d[4], d[5:]
        else:
            raw, _, rest = d[1:].partition(b"\0")
            mime, kind, rest = raw.decode("latin-1"), rest[0] if rest else 0, rest[1:]
        desc, data = cut_string(enc, rest)
        m.picture(kind, mime, desc, data)
    elif f == "SYLT" and len(d) > 6 and d[4] != 2:
        m.warn("synced-lyrics-timestamp-format", str(d[4]))
    elif f == "SYLT" and len(d) > 6 and d[5] != 1:
        m.warn("synced-lyrics-content-type", str(d[5]))
    elif f == "SYLT" and len(d) > 6:
        desc, rest = cut_string(enc, d[6:])
        lines = []
        while rest:
            t, rest = cut_string(enc, rest)
            if len(rest) < 4:
                break
            lines.append({"time_ns": int.from_bytes(rest[:4], "big") * 1_000_000, "text": t.lstrip("\n")})
            rest = rest[4:]
        m.timed(lines, d[1:4].decode("latin-1"), desc)
    elif f == "CHAP":
        ident, _, rest = d.partition(b"\0")
        if len(rest) >= 16:
            start, end = struct.unpack(">II", rest[:8])
            title, sub = "", rest[16:]
            while len(sub) >= 10:
                n = syncsafe(sub[4:8]) if version == 4 else int.from_bytes(sub[4:8], "big")
                if sub[:4] == b"TIT2" and n > 1:
                    title = frame_text(sub[10], sub[11 : 10 + n])[0]
                sub = sub[10 + n :]
            if start != 0xFFFFFFFF:
                chaps.setdefault(ident, []).append((start * 1_000_000, 0 if end == 0xFFFFFFFF else end * 1_000_000, title))
    elif f == "CTOC":
        _, _, rest = d.partition(b"\0")
        if len(rest) >= 2 and rest[0] & 2 or not order:
            order[:] = rest[2:].split(b"\0")[: rest[1]] if len(rest) >= 2 else []


def id3v1(b: bytes) -> list[tuple[str, str]]:
    s = lambda lo, hi: b[lo:hi].split(b"\0")[0].decode("latin-1").rstrip()
    out = [("TITLE", s(3, 33)), ("ARTIST", s(33, 63)), ("ALBUM", s(63, 93)), ("RECORDINGDATE", s(93, 97)), ("COMMENT", s(97, 127 if b[125] or not b[126] else 125))]
    if not b[125] and b[126]:
        out.append(("TRACKNUMBER", str(b[126])))
    if b[127] < len(GENRES):
        out.append(("GENRE", GENRES[b[127]]))
    return [(k, v) for k, v in out if v]


def ape(b: bytes, end: int) -> tuple[int, list[tuple[str, str]]]:
    """Where an APEv2 tag that ends at `end` starts, and its items; (end, []) if there is none."""
    foot = b[end - 32 : end]
    if end < 32 or foot[:8] != b"APETAGEX":
        return end, []
    _, size, count, flags = struct.unpack("<IIII", foot[8:24])
    start = end - size
    if start < 0 or size < 32:
        return end, []
    at, out = start, []
    for n in range(count):
        _counted(n)
        if at + 8 > end - 32:
            break
        n, fl = struct.unpack("<II", b[at : at + 8])
        stop = b.find(b"\0", at + 8, end - 32)
        if stop < 0 or stop + 1 + n > end - 32:
            break
        key = b[at + 8 : stop].decode("latin-1").upper()
        if (fl >> 1) & 3:
            out.append(("", key))  # no text
        else:
            out += [(K.ALIASES.get(key, key), v) for v in b[stop + 1 : stop + 1 + n].decode("utf-8", "replace").split("\0") if v]
        at = stop + 1 + n
    return max(0, start - 32) if flags >> 31 else start, out


# Vorbis comments


def vorbis_comments(m: Media, b: bytes, family: str) -> None:
    n = int.from_bytes(b[:4], "little")
    vendor = b[4 : 4 + n].decode("utf-8", "replace")
    at = 4 + n
    count = int.from_bytes(b[at : at + 4], "little")
    at += 4
    chap: dict[str, list[str]] = {}
    for k in range(count):
        _counted(k)
        if at + 4 > len(b):
            m.warn("tag-structure-dropped", "comment list")
            break
        n = int.from_bytes(b[at : at + 4], "little")
        raw = b[at + 4 : at + 4 + n]
        at += 4 + n
        name, eq, value = raw.decode("utf-8", "replace").partition("=")
        up = name.upper()
        if not eq or not _KEY.fullmatch(name):
            m.warn("invalid-tag-key", name)
        elif up == "METADATA_BLOCK_PICTURE":
            try:
                flac_picture(m, base64.b64decode(value))
            except ValueError:
                m.warn("invalid-picture", up)
        elif up == "SYNCEDLYRICS":
            m.timed(lrc(value))
        elif x := _CHAPTER.fullmatch(up):
            chap.setdefault(x[1], ["", "", ""])[{"NAME": 1, "URL": 2}.get(x[2], 0)] = value
        else:
            m.add(K.ALIASES.get(up, up), value, family, up)
    for _, (t, title, _) in sorted(chap.items()):
        if x := re.fullmatch(r"(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,9}))?", t):
            m.chapter(((int(x[1]) * 60 + int(x[2])) * 60 + int(x[3])) * 10**9 + int((x[4] or "0").ljust(9, "0")), 0, title)
    if re.search("lavf|libavformat", vendor, re.I):
        m.warn("inherited-encoder", vendor)


_KEY, _CHAPTER = re.compile(r"[\x20-\x3C\x3E-\x7E]+"), re.compile(r"CHAPTER(\d{3})(NAME|URL)?")
_STAMP = re.compile(r"\[(\d+):([0-5]?\d)(?:[.:](\d{1,3}))?\]")


def lrc(text: str) -> list[dict]:
    """The lines of a timed lyric, by time: a line may have several stamps; an `[offset:ms]` is taken off all."""
    out, offset = [], 0
    for line in text.lstrip("\ufeff").splitlines():
        if x := re.fullmatch(r"\s*\[offset:\s*([+-]?\d{1,9})\s*\]\s*", line):
            offset = int(x[1])
            continue
        at, stamps = 0, []
        while x := _STAMP.match(line, at):
            stamps.append((int(x[1]) * 60 + int(x[2])) * 1000 + int((x[3] or "0").ljust(3, "0")))
            at = x.end()
        words = line[at:]
        out += [(t, words[1:] if words.startswith(" ") else words) for t in stamps]
    return [{"time_ns": max(t - offset, 0) * 1_000_000, "text": words} for t, words in sorted(out, key=lambda x: x[0])]


def flac_picture(m: Media, b: bytes) -> None:
    kind, n = struct.unpack(">II", b[:8])
    mime, at = b[8 : 8 + n].decode("latin-1"), 8 + n
    n = int.from_bytes(b[at : at + 4], "big")
    desc = b[at + 4 : at + 4 + n].decode("utf-8", "replace")
    at += 4 + n + 16
    n = int.from_bytes(b[at : at + 4], "big")
    m.picture(kind, mime, desc, b[at + 4 : at + 4 + n])


# Formats


def flac(m: Media, b: bytes, at: int) -> None:
    m.format = m.container = "FLAC"
    pos, last, comments = at + 4, False, 0
    while not last and pos + 4 <= len(b):
        kind, n = b[pos] & 127, int.from_bytes(b[pos + 1 : pos + 4], "big")
        last, d = bool(b[pos] & 128), b[pos + 4 : pos + 4 + n]
        if len(d) < n:
            m.warn("truncated-audio", "metadata block")
        if kind == 0 and n >= 34:
            x = int.from_bytes(d[10:18], "big")
            m.tracks.append(track("FLAC", x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1) | {"md5": d[18:34]})
            m.config = d[:34]
        elif kind == 4:
            comments += 1
            if comments > 1:
                m.warn("multiple-vorbis-comment")
            else:
                vorbis_comments(m, d, "vorbis")
        elif kind == 6 and n >= 32:
            flac_picture(m, d)
        elif kind > 6:
            m.warn("unknown-block", str(kind))
        m.native.append(({0: "STREAMINFO", 1: "PADDING", 2: "APPLICATION", 3: "SEEKTABLE", 4: "VORBIS_COMMENT", 5: "CUESHEET", 6: "PICTURE"}.get(kind, "UNKNOWN"), n))
        pos += 4 + n
    end = len(b) - 128 if b[-128:-125] == b"TAG" and len(b) - 128 >= pos else len(b)
    if end < len(b):
        m.warn("trailing-id3v1")
        m.legacy += [(k, v, "id3v1") for k, v in id3v1(b[-128:])]
    m.ranges = [(min(pos, end), end)]
    for t in m.tracks:
        t["bitrate"] = track("", 1, 1, ns=t["duration_ns"], size=max(0, end - pos))["bitrate"]


def ogg(m: Media, b: bytes) -> None:
    at, packets, part, granule, serial, audio = 0, [], b"", 0, None, []
    while at + 27 <= len(b) and b[at : at + 4] == b"OggS":
        n = b[at + 26]
        lace = b[at + 27 : at + 27 + n]
        body, size = at + 27 + n, sum(lace)
        own = b[at + 14 : at + 18]
        if serial is None:
            serial = own
        elif own != serial and b[at + 5] & 2:
            m.warn("chained-stream")
        if own == serial:
            g = int.from_bytes(b[at + 6 : at + 14], "little", signed=True)
            granule = max(granule, g)
            if len(packets) < 3:
                p = body
                for x in lace:
                    part += b[p : p + x]
                    p += x
                    if x < 255:
                        packets.append(part)
                        part = b""
            else:
                audio.append((body, min(body + size, len(b))))
        at = body + size
    if at > len(b):
        m.warn("truncated-audio")
    head = packets[0] if packets else b""
    m.container = "Ogg"
    if head[:8] == b"OpusHead" and len(head) >= 19:
        m.format = "Opus"
        skip = int.from_bytes(head[10:12], "little")
        m.tracks.append(track("Opus", 48000, head[9], samples=max(0, granule - skip)))
        if len(packets) > 1 and packets[1][:8] == b"OpusTags":
            vorbis_comments(m, packets[1][8:], "vorbis")
    elif head[:7] == b"\x01vorbis" and len(head) >= 16:
        m.format = "Ogg Vorbis"
        m.tracks.append(track("Vorbis", int.from_bytes(head[12:16], "little"), head[11], samples=max(0, granule)))
        if len(packets) > 1 and packets[1][:7] == b"\x03vorbis":
            vorbis_comments(m, packets[1][7:], "vorbis")
    else:
        raise ValueError("unsupported Ogg stream")
    m.config, m.ranges = head, audio


def _tail(m: Media, b: bytes, lo: int) -> int:
    """Takes ID3v1 and APE tags off the end; returns where the audio ends."""
    end, going = len(b), True
    while going and end > lo:
        going = False
        if end - 128 >= lo and b[end - 128 : end - 125] == b"TAG":
            m.legacy += [(k, v, "id3v1") for k, v in id3v1(b[end - 128 : end])]
            m.warn("trailing-id3v1")
            end, going = end - 128, True
        start, items = ape(b, end)
        if start < end and start >= lo:
            m.legacy += [(k, v, "ape") for k, v in items if k]
            if n := sum(not k for k, _ in items):
                m.native.append(("LEGACY-OPAQUE", n))
            m.warn("legacy-ape")
            end, going = start, True
    return end


_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_KBPS = {
    k: tuple(map(int, v.split()))
    for k, v in {
        (1, 1): "32 64 96 128 160 192 224 256 288 320 352 384 416 448", (1, 2): "32 48 56 64 80 96 112 128 160 192 224 256 320 384", (1, 3): "32 40 48 56 64 80 96 112 128 160 192 224 256 320",
        (2, 1): "32 48 56 64 80 96 112 128 144 160 176 192 224 256", (2, 2): "8 16 24 32 40 48 56 64 80 96 112 128 144 160", (2, 3): "8 16 24 32 40 48 56 64 80 96 112 128 144 160",
    }.items()
}


def mpeg_header(h: bytes) -> dict | None:
    if len(h) < 4 or h[0] != 255 or h[1] & 0xE0 != 0xE0:
        return None
    v, layer, br, sr = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if v == 1 or layer == 4 or br in (0, 15) or sr == 3:
        return None
    rate, kbps = _RATES[v][sr], _KBPS[1 if v == 3 else 2, layer][br - 1]
    per = 384 if layer == 1 else 1152 if layer == 2 or v == 3 else 576
    size = (12 * kbps * 1000 // rate + (h[2] >> 1 & 1)) * 4 if layer == 1 else per // 8 * kbps * 1000 // rate + (h[2] >> 1 & 1)
    return {"version": v, "layer": layer, "kbps": kbps, "rate": rate, "channels": 1 if h[3] >> 6 == 3 else 2, "per": per, "size": size, "mono": h[3] >> 6 == 3}


def mp3(m: Media, b: bytes, lo: int) -> None:
    m.format, m.container = "MP3", "MPEG"
    if lo:
        id3v2(m, b[:lo])
    end = _tail(m, b, lo)
    at = lo
    while at + 4 <= end:
        at = b.find(b"\xff", at, end)
        if at < 0:
            break
        h = mpeg_header(b[at : at + 4])
        if h and (at + h["size"] + 4 > end or mpeg_header(b[at + h["size"] : at + h["size"] + 4])):
            side = (17 if h["mono"] else 32) if h["version"] == 3 else (9 if h["mono"] else 17)
            x = at + 4 + side
            frames = None
            if b[x : x + 4] in (b"Xing", b"Info") and b[x + 7] & 1:
                frames = int.from_bytes(b[x + 8 : x + 12], "big")
            elif b[at + 36 : at + 40] == b"VBRI":
                frames = int.from_bytes(b[at + 50 : at + 54], "big")
            n = end - at
            if frames:
                t = track(f"MPEG-{ {3: '1', 2: '2', 0: '2.5'}[h['version']] } Layer {h['layer']}", h["rate"], h["channels"], samples=frames * h["per"], size=n)
                if t["bitrate"] and t["bitrate"] < 8000:
                    m.warn("truncated-audio")
            else:
                t = track(f"MPEG-{ {3: '1', 2: '2', 0: '2.5'}[h['version']] } Layer {h['layer']}", h["rate"], h["channels"], ns=n * 8 * 10**9 // (h["kbps"] * 1000))
                t["bitrate"] = h["kbps"] * 1000
            t["codec"] = f"MP{h['layer']}"
            m.tracks.append(t)
            break
        at += 1
    m.ranges = [(lo, end)]


def aac(m: Media, b: bytes, lo: int) -> None:
    m.format, m.container = "AAC", "ADTS"
    if lo:
        id3v2(m, b[:lo])
    end, at, samples, first = _tail(m, b, lo), lo, 0, None
    rates = tuple(map(int, "96000 88200 64000 48000 44100 32000 24000 22050 16000 12000 11025 8000 7350".split()))
    while at + 7 <= end and b[at] == 255 and b[at + 1] & 0xF6 == 0xF0:
        n = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5
        sr = b[at + 2] >> 2 & 15
        if n < 7 or sr >= len(rates):
            break
        if first is None:
            first = (rates[sr], (b[at + 2] & 1) << 2 | b[at + 3] >> 6, b[at + 2] >> 6)
        samples += 1024 * ((b[at + 6] & 3) + 1)
        at += n
    if at > end:
        m.warn("truncated-audio")
    if first:
        m.tracks.append(track("AAC", first[0], {7: 8}.get(first[1], first[1]), samples=samples, size=end - lo) | {"codec_profile": ("Main", "LC", "SSR", "LTP")[first[2]]})
    m.ranges = [(lo, end)]


def _chunks(m: Media, b: bytes, big: bool):
    at, n = 12, 0
    while at + 8 <= len(b):
        n = _counted(n)
        if b[at : at + 3] == b"TAG" and len(b) - at == 128:
            return
        size = int.from_bytes(b[at + 4 : at + 8], "big" if big else "little")
        if at + 8 + size > len(b):
            m.warn("truncated-audio" if b[at : at + 4] in (b"data", b"SSND") else "oversized-chunk", b[at : at + 4].decode("latin-1"))
            size = len(b) - at - 8
        yield b[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def _overlay(m: Media, native: list[tuple[str, str]], family: str) -> None:
    """Native text below an ID3 tag: keys that ID3 has are legacy, others count."""
    own = {k for k, _, _, _ in m.items}
    for k, v in native:
        if k in own:
            m.legacy.append((k, v, family))
        else:
            m.items.append((k, v, family, k))


def wav(m: Media, b: bytes) -> None:
    m.format = m.container = "WAV"
    if b[:4] in (b"RF64", b"BW64"):
        raise ValueError("64-bit WAVE is not supported")
    fmt, data, native = None, None, []
    for name, at, n in _chunks(m, b, False):
        m.native.append((name.decode("latin-1"), n))
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack("<HHIIHH", b[at : at + 16])
            m.config = b[at : at + min(n, 40)]
        elif name == b"data" and data is None:
            data = (at, at + n)
        elif name == b"LIST" and b[at : at + 4] == b"INFO":
            p = at + 4
            while p + 8 <= at + n:
                k = b[p : p + 4].decode("latin-1")
                s = int.from_bytes(b[p + 4 : p + 8], "little")
                v = b[p + 8 : p + 8 + s].split(b"\0")[0]
                try:
                    v = v.decode()
                except UnicodeDecodeError:
                    v = v.decode("latin-1")
                if k == "ISFT" and re.search("lavf|libavformat", v, re.I):
                    m.warn("inherited-encoder", v)
                if k in K.RIFF_INFO and v:
                    native.append((K.RIFF_INFO[k], v))
                p += 8 + s + (s & 1)
        elif name in (b"id3 ", b"ID3 ") and id3_size(b, at):
            id3v2(m, b[at : at + n])
    _overlay(m, native, "riff-info")
    if fmt:
        n = data[1] - data[0] if data else 0
        ns = int(n / fmt[3] * 1e9) if fmt[3] else 0
        m.tracks.append(track({1: "PCM", 3: "PCM float", 6: "A-law", 7: "mu-law", 0xFFFE: "PCM"}.get(fmt[0], f"0x{fmt[0]:04x}"), fmt[2], fmt[1], fmt[5], n // fmt[4] if fmt[4] else 0, ns, n))
    m.ranges = [data] if data else []


def aiff(m: Media, b: bytes) -> None:
    m.format, m.container = "AIFF", b[8:12].decode("latin-1")
    native = []
    for name, at, n in _chunks(m, b, True):
        m.native.append((name.decode("latin-1"), n))
        d = b[at : at + n]
        if name == b"COMM" and n >= 18:
            ch, frames, bits, e, frac = struct.unpack(">HIHHQ", d[:18])
            rate = int(frac * 2.0 ** ((e & 0x7FFF) - 16383 - 63)) if e & 0x7FFF < 16446 else 0
            m.tracks.append(track("PCM" if n < 22 or d[18:22] in (b"NONE", b"sowt", b"twos") else d[18:22].decode("latin-1"), rate, ch, bits, frames))
            m.config = d
        elif name == b"SSND" and n >= 8:
            off = int.from_bytes(d[:4], "big")
            m.ranges = [(min(at + 8 + off, at + n), at + n)]
        elif (k := K.AIFF_TEXT.get(name.decode("latin-1"))) and n:
            native.append((k, d.rstrip(b"\0").decode("utf-8", "replace")))
        elif name == b"ID3 " and id3_size(b, at):
            id3v2(m, d)
    _overlay(m, native, "aiff-text")


def _atoms(b: bytes, lo: int, hi: int):
    n = 0
    while lo + 8 <= hi:
        n = _counted(n)
        size, head = int.from_bytes(b[lo : lo + 4], "big"), 8
        if size == 1 and lo + 16 <= hi:
            size, head = int.from_bytes(b[lo + 8 : lo + 16], "big"), 16
        elif size == 0:
            size = hi - lo
        if size < head:
            return
        yield b[lo + 4 : lo + 8], lo + head, min(lo + size, hi)
        lo += size


def mp4(m: Media, b: bytes) -> None:
    m.format = m.container = "MP4"
    duration = 0
    own = ("moov", "udta", "trak", "mdia", "minf", "stbl")

    def value(lo: int, hi: int) -> list[tuple[int, bytes]]:
        return [(int.from_bytes(b[x : x + 4], "big") & 0xFFFFFF, b[x + 8 : y]) for a, x, y in _atoms(b, lo, hi) if a == b"data" and y - x >= 8]

    def ilst(lo: int, hi: int) -> None:
        for a, x, y in _atoms(b, lo, hi):
            name = a.decode("latin-1")
            if a in (b"trkn", b"disk"):
                for _, d in value(x, y)[:1]:
                    n, t = struct.unpack(">HH", d[2:6]) if len(d) >= 6 else (0, 0)
                    for k, v in zip(("TRACKNUMBER", "TRACKTOTAL") if a == b"trkn" else ("DISCNUMBER", "DISCTOTAL"), (n, t)):
                        if v:
                            m.add(k, str(v), "mp4", name)
            elif a == b"gnre":
                for _, d in value(x, y):
                    g = int.from_bytes(d[:2], "big")
                    if 0 < g <= len(GENRES):
                        m.add("GENRE", GENRES[g - 1], "mp4", name)
                        m.warn("numeric-genre", str(g))
            elif a in (b"cpil", b"stik"):
                for _, d in value(x, y)[:1]:
                    m.add("COMPILATION" if a == b"cpil" else "MEDIATYPE", str(int.from_bytes(d[:4], "big")), "mp4", name)
            elif a == b"covr":
                for kind, d in value(x, y):
                    m.picture(3, {13: "image/jpeg", 14: "image/png", 27: "image/bmp"}.get(kind, ""), "", d)
            elif a == b"----":
                parts = {n: b[p + 4 : q].decode("utf-8", "replace") for n, p, q in _atoms(b, x, y) if n in (b"mean", b"name")}
                up = parts.get(b"name", "").upper()
                key = K.MP4_FREEFORM.get(up) or K.ALIASES.get(up, up)
                for _, d in value(x, y):
                    m.add(key, d.decode("utf-8", "replace"), "mp4", f"----:{up}")
            elif name in K.MP4_TEXT:
                for _, d in value(x, y):
                    m.add(K.MP4_TEXT[name], d.decode("utf-8", "replace"), "mp4", name)

    def walk(lo: int, hi: int, depth: int) -> None:
        nonlocal duration
        for a, x, y in _atoms(b, lo, hi):
            name = a.decode("latin-1")
            if name in own and depth < 16:
                walk(x, y, depth + 1)
            elif a == b"meta" and depth < 16:
                walk(x + 4 if b[x : x + 4] == b"\0\0\0\0" else x, y, depth + 1)
            elif a == b"ilst":
                ilst(x, y)
            elif a in (b"mdhd", b"mvhd") and y - x >= 24:
                scale, n = struct.unpack(">IQ", b[x + 20 : x + 32]) if b[x] == 1 and y - x >= 32 else struct.unpack(">II", b[x + 12 : x + 20])
                if scale and (a == b"mdhd" or not duration):
                    duration = n * 10**9 // scale
            elif a == b"stsd":
                for fmt, p, q in _atoms(b, x + 8, y):
                    if q - p >= 28 and fmt in (b"mp4a", b"alac", b"fLaC", b"Opus", b"ac-3", b"ec-3", b".mp3"):
                        ch, bits = struct.unpack(">HH", b[p + 16 : p + 20])
                        rate = int.from_bytes(b[p + 24 : p + 26], "big")
                        codec = {b"mp4a": "AAC", b"alac": "ALAC", b"fLaC": "FLAC", b"ac-3": "AC-3", b"ec-3": "E-AC-3", b".mp3": "MP3"}.get(fmt, fmt.decode())
                        m.tracks.append(track(codec, rate, ch, 0 if codec == "AAC" else bits, ns=duration))
            elif a == b"chpl" and y - x >= 9:
                p = x + (8 if b[x] else 4)
                n, p = b[p], p + 1
                for _ in range(n):
                    if p + 9 > y:
                        break
                    size = b[p + 8]
                    m.chapter(int.from_bytes(b[p : p + 8], "big") * 100, 0, b[p + 9 : p + 9 + size].decode("utf-8", "replace"))
                    p += 9 + size
            elif a == b"mdat":
                m.ranges.append((x, y))
            elif a in (b"moof", b"mvex"):
                m.warn("fragmented")
            if depth == 0:
                m.native.append((name, y - x))

    walk(0, len(b), 0)
    if not any(a == b"moov" for a, _, _ in _atoms(b, 0, len(b))):
        raise ValueError("no moov atom")


def _vint(b: bytes, at: int, keep: bool) -> tuple[int, int]:
    if at >= len(b) or not b[at]:
        return -1, len(b) + 1
    n = 9 - b[at].bit_length()
    raw = int.from_bytes(b[at : at + n], "big")
    if not keep:
        raw &= (1 << 7 * n) - 1
        if raw == (1 << 7 * n) - 1:
            raw = -1
    return raw, at + n


def _elements(b: bytes, lo: int, hi: int):
    n = 0
    while lo < hi:
        n = _counted(n)
        ident, at = _vint(b, lo, True)
        size, at = _vint(b, at, False)
        if at > hi or ident < 0:
            return
        end = hi if size < 0 else min(at + size, hi)
        yield ident, at, end
        lo = end


def matroska(m: Media, b: bytes) -> None:
    scale, duration, doc = 1_000_000, 0.0, "matroska"
    num = lambda x, y: int.from_bytes(b[x:y], "big")
    text = lambda x, y: b[x:y].split(b"\0")[0].decode("utf-8", "replace")
    real = lambda x, y: struct.unpack(">f" if y - x == 4 else ">d", b[x:y])[0] if y - x in (4, 8) else 0.0

    def simple(x: int, y: int, scope: str, depth: int) -> None:
        f = {i: (p, q) for i, p, q in _elements(b, x, y)}
        if 0x45A3 in f:
            name = text(*f[0x45A3]).upper()
            key = K.MATROSKA.get(name) or K.ALIASES.get(name, name)
            if name not in K.MATROSKA_TECHNICAL and not name.startswith("_STATISTICS") and 0x4487 in f:
                v = text(*f[0x4487])
                if key == "TRACKNUMBER" or key == "DISCNUMBER":
                    m.pair(key, key.replace("NUMBER", "TOTAL"), v, f"matroska:{scope}", name)
                else:
                    m.add("ALBUM" if scope == "album" and key == "TITLE" else key, v, f"matroska:{scope}", name)

    def atom(x: int, y: int) -> None:
        c = {"s": 0, "e": 0, "t": "", "l": "", "h": False, "d": False}
        for i, p, q in _elements(b, x, y):
            if i == 0x91:
                c["s"] = num(p, q)
            elif i == 0x92:
                c["e"] = num(p, q)
            elif i == 0x98:
                c["h"] = bool(num(p, q))
            elif i == 0x4598:
                c["d"] = not num(p, q)
            elif i == 0x80 and not c["t"]:
                for j, r, s in _elements(b, p, q):
                    if j == 0x85:
                        c["t"] = text(r, s)
                    elif j == 0x437C:
                        c["l"] = "" if text(r, s) == "und" else text(r, s)
        m.chapter(c["s"], c["e"] if c["e"] > c["s"] else 0, c["t"], c["l"], c["h"], c["d"])

    for i, x, y in _elements(b, 0, len(b)):
        if i == 0x1A45DFA3:
            doc = next((text(p, q) for j, p, q in _elements(b, x, y) if j == 0x4282), doc)
        if i != 0x18538067:
            continue
        for j, p, q in _elements(b, x, y):
            if j == 0x1549A966:
                for k, r, s in _elements(b, p, q):
                    scale = num(r, s) if k == 0x2AD7B1 else scale
                    duration = real(r, s) if k == 0x4489 else duration
                    if k == 0x7BA9:
                        m.add("TITLE", text(r, s), "matroska:info", "Title")
            elif j == 0x1654AE6B:
                for k, r, s in _elements(b, p, q):
                    e = {i2: (r2, s2) for i2, r2, s2 in _elements(b, r, s)}
                    if 0x83 in e and num(*e[0x83]) == 2:
                        a = {i3: (r3, s3) for i3, r3, s3 in _elements(b, *e[0xE1])} if 0xE1 in e else {}
                        raw = text(*e[0x86]) if 0x86 in e else ""
                        codec = {"A_AAC": "AAC", "A_FLAC": "FLAC", "A_OPUS": "Opus", "A_VORBIS": "Vorbis", "A_MPEG/L3": "MP3", "A_ALAC": "ALAC", "A_AC3": "AC-3", "A_EAC3": "E-AC-3"}.get(raw, "PCM" if raw.startswith("A_PCM") else raw)
                        m.tracks.append(track(codec, int(real(*a[0xB5])) if 0xB5 in a else 8000, num(*a[0x9F]) if 0x9F in a else 1, num(*a[0x6264]) if 0x6264 in a else 0, ns=0))
            elif j == 0x1254C367:
                for _, r, s in _elements(b, p, q):
                    level, parts = 50, []
                    for k, t, u in _elements(b, r, s):
                        if k == 0x63C0:
                            level = next((num(v, w) for l2, v, w in _elements(b, t, u) if l2 == 0x68CA), 50)
                        elif k == 0x67C8:
                            parts.append((t, u))
                    for t, u in parts:
                        simple(t, u, "album" if level >= 50 else "track", 0)
            elif j == 0x1941A469:
                for _, r, s in _elements(b, p, q):
                    e = {k: (t, u) for k, t, u in _elements(b, r, s)}
                    mime = text(*e[0x4660]) if 0x4660 in e else ""
                    if mime.startswith("image/") and 0x465C in e:
                        name = text(*e[0x466E]) if 0x466E in e else ""
                        m.picture(3 if re.match(r"(?i)(small_)?cover", name) else 0, mime, text(*e[0x467E]) if 0x467E in e else "", b[e[0x465C][0] : e[0x465C][1]])
            elif j == 0x1043A770:
                editions = [(r, s) for k, r, s in _elements(b, p, q) if k == 0x45B9]
                chosen = next((e for e in editions if any(k == 0x45DB and num(t, u) for k, t, u in _elements(b, *e))), editions[0] if editions else None)
                for k, t, u in _elements(b, *chosen) if chosen else ():
                    if k == 0xB6:
                        atom(t, u)
            elif j == 0x1F43B675:
                m.ranges.append((p, q))
    m.format = "WebM" if doc == "webm" else "Matroska"
    m.container = m.format
    m.chapters.sort(key=lambda c: c["start_ns"])
    for t in m.tracks:
        t["duration_ns"] = int(duration * scale)


def detect(b: bytes) -> tuple[str, int]:
    """The format by the leading bytes, looking past an ID3v2 tag; and where its own bytes start."""
    for at in dict.fromkeys((0, id3_size(b))):
        h = b[at : at + 16]
        if h[:4] == b"fLaC":
            return "FLAC", at
        if at == 0:
            if h[:4] == b"OggS":
                return "Ogg", 0
            if h[:4] in (b"RIFF", b"RF64", b"BW64") and h[8:12] == b"WAVE":
                return "WAV", 0
            if h[:4] == b"FORM" and h[8:12] in (b"AIFF", b"AIFC"):
                return "AIFF", 0
            if h[4:8] == b"ftyp":
                return "MP4", 0
            if h[:4] == b"\x1a\x45\xdf\xa3":
                return "Matroska", 0
        if len(h) >= 7 and h[0] == 255 and h[1] & 0xF6 == 0xF0:
            return "AAC", at
        if mpeg_header(h[:4]):
            return "MP3", at
    n = id3_size(b)
    return ("MP3", min(n, len(b))) if n or b[-128:-125] == b"TAG" else ("", 0)


def parse(b: bytes) -> Media:
    """ValueError for what is no supported file."""
    name, at = detect(b)
    m = Media()
    if name == "FLAC":
        if at:
            m.warn("stray-leading-id3")
        flac(m, b, at)
    elif name in ("MP3", "AAC"):
        (mp3 if name == "MP3" else aac)(m, b, at)
    elif name:
        {"Ogg": ogg, "WAV": wav, "AIFF": aiff, "MP4": mp4, "Matroska": matroska}[name](m, b)
    else:
        raise ValueError("unsupported format")
    if not any(hi > lo for lo, hi in m.ranges):
        m.warnings = [w for w in m.warnings if w[0] != "truncated-audio"]
        m.warn("no-audio")
    return m


def essence(b: bytes, m: Media) -> str:
    """sha256/<format>-v1:<hex> over the configuration and the ordered audio ranges; empty without audio."""
    if not any(hi > lo for lo, hi in m.ranges):
        return ""
    h, at = hashlib.sha256(m.config), -1
    for lo, hi in m.ranges:
        if lo < at:
            raise ValueError("audio ranges out of order")
        h.update(b[lo:hi])
        at = hi
    return f"sha256/{m.format.lower().replace(' ', '-')}-v1:{h.hexdigest()}"
