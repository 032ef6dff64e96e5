"""Metadata writers: a file's bytes with new tags, as segments of literals and ranges of the old file.

Audio bytes are only ever copied. What the tag model doesn't hold (pictures, chapters, unknown blocks and
frames) is copied too. `write` raises ValueError where a file can't be written.
"""

from __future__ import annotations

import base64
import re
import struct
from dataclasses import dataclass

from ..functions import vocabulary as K
from .containers import Media, _atoms, _elements, cut_string, detect, frame_data, frame_text, id3_size, parse, sniff_image, syncsafe

Segment = bytes | tuple[int, int]


@dataclass
class Sets:
    """What takes the place of a file's pictures (type, mime, description, data), chapters (start_ns, end_ns, title) and timed lyrics (language, description, lines of time_ns, text); None keeps the old ones."""

    pictures: list[dict] | None = None
    chapters: list[dict] | None = None
    lyrics: list[dict] | None = None

    def any(self) -> bool:
        return not self.pictures is self.chapters is self.lyrics is None


KEEP = Sets()


def join(b: bytes, segments: list[Segment]) -> bytes:
    return b"".join(s if isinstance(s, bytes) else b[s[0] : s[1]] for s in segments)


def output_length(segments: list[Segment]) -> int:
    return sum(len(s) if isinstance(s, bytes) else s[1] - s[0] for s in segments)


# Vorbis comments


_DATE = {"RECORDINGDATE": "DATE"}
_OWN = re.compile(r"CHAPTER\d{3}(NAME|URL)?|METADATA_BLOCK_PICTURE|SYNCEDLYRICS")


def _clock(ns: int) -> str:
    ms = ns // 1_000_000
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def lrc_text(lines: list[dict]) -> str:
    return "\n".join(f"[{x['time_ns'] // 60_000_000_000:02d}:{x['time_ns'] // 1_000_000_000 % 60:02d}.{x['time_ns'] // 1_000_000 % 1000:03d}]{x['text']}" for x in lines)


def picture_block(p: dict) -> bytes:
    mime, desc, data = (p["mime"] or "").encode("latin-1", "replace"), (p["description"] or "").encode(), bytes(p["data"])
    _, w, h, depth = sniff_image(data)
    return struct.pack(">II", p["type"], len(mime)) + mime + struct.pack(">I", len(desc)) + desc + struct.pack(">IIIII", w, h, depth, 0, len(data)) + data


def _set_comments(sets: Sets) -> list[str]:
    if len(sets.chapters or ()) > 999:
        raise ValueError("more than 999 chapters")
    out = []
    for i, c in enumerate(sets.chapters or (), 1):
        out += [f"CHAPTER{i:03d}={_clock(c['start_ns'])}", f"CHAPTER{i:03d}NAME={c['title'] or ''}"]
    return out + [f"SYNCEDLYRICS={lrc_text(y['lines'])}" for y in sets.lyrics or ()]


def comment_list(old: bytes, tags: dict[str, list[str]], sets: Sets = KEEP, blocks: bool = True) -> bytes:
    """A comment list with the old one's vendor and reserved entries, the tags, and new sets; blocks: pictures have blocks of their own."""
    gone = [n for n, new in (("CHAPTER", sets.chapters), ("METADATA", sets.pictures), ("SYNCED", sets.lyrics)) if new is not None]
    n = int.from_bytes(old[:4], "little") if len(old) >= 4 else 0
    vendor, at = old[4 : 4 + n], 4 + n
    kept = []
    for _ in range(int.from_bytes(old[at : at + 4], "little") if len(old) >= at + 4 else 0):
        at += 4
        size = int.from_bytes(old[at : at + 4], "little")
        x = old[at + 4 : at + 4 + size]
        at += size
        name = x.partition(b"=")[0].decode("latin-1").upper()
        if _OWN.fullmatch(name) and not any(name.startswith(g) for g in gone):
            kept.append(x)
    kept += [x.encode() for x in _set_comments(sets)]
    kept += [b"METADATA_BLOCK_PICTURE=" + base64.b64encode(picture_block(p)) for p in sets.pictures or () if not blocks]
    kept += [f"{_DATE.get(k, k)}={v}".encode() for k, vs in tags.items() for v in vs]
    return struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(kept)) + b"".join(struct.pack("<I", len(x)) + x for x in kept)


def write_flac(b: bytes, tags: dict, sets: Sets = KEEP) -> list[Segment]:
    at = detect(b)[1] + 4
    blocks: list[tuple[int, Segment]] = []
    old, last = b"", False
    while not last and at + 4 <= len(b):
        kind, n, last = b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big"), bool(b[at] & 128)
        if kind == 4:
            old = old or b[at + 4 : at + 4 + n]
        elif kind != 6 or sets.pictures is None:
            blocks.append((kind, (at + 4, min(at + 4 + n, len(b)))))
        at += 4 + n
    new = comment_list(old, tags, sets)
    added = [(4, new), *((6, picture_block(p)) for p in sets.pictures or ())]
    if any(len(d) >= 1 << 24 for _, d in added):
        raise ValueError("comments or a picture beyond a block's size")
    blocks[1:1] = added
    out: list[Segment] = [(0, detect(b)[1] + 4)]
    for i, (kind, d) in enumerate(blocks):
        out += [bytes([kind | (128 if i == len(blocks) - 1 else 0)]) + output_length([d]).to_bytes(3, "big"), d]
    return [*out, (min(at, len(b)), len(b))]


_CRC = []


def ogg_crc(b: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, unreflected, from 0."""
    if not _CRC:
        for i in range(256):
            r = i << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
            _CRC.append(r)
    r = 0
    for x in b:
        r = (r << 8 & 0xFFFFFFFF) ^ _CRC[r >> 24 ^ x]
    return r


def _page(body: bytes, lace: bytes, granule: int, flags: int, serial: bytes, seq: int) -> bytes:
    p = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial + struct.pack("<II", seq, 0) + bytes([len(lace)]) + lace + body
    return p[:22] + struct.pack("<I", ogg_crc(p)) + p[26:]


def write_ogg(b: bytes, tags: dict, sets: Sets = KEEP) -> list[Segment]:
    """The header packets are paged anew; audio pages keep their bodies, with new numbers and checksums."""
    pages, at = [], 0
    while at + 27 <= len(b) and b[at : at + 4] == b"OggS":
        n = b[at + 26]
        lace = b[at + 27 : at + 27 + n]
        pages.append((at, at + 27 + n, lace))
        at += 27 + n + sum(lace)
    serial = b[14:18]
    want = 2 if b[28:36] == b"OpusHead" or b[pages[0][1] : pages[0][1] + 8] == b"OpusHead" else 3
    packets, part, used = [], b"", 0
    for start, body, lace in pages:
        if b[start + 14 : start + 18] != serial:
            raise ValueError("several streams")
        for x in lace:
            part += b[body : body + x]
            body += x
            if x < 255:
                packets.append(part)
                part = b""
        used += 1
        if len(packets) >= want:
            break
    if len(packets) != want or part:
        raise ValueError("header packets share a page with audio")
    head = 8 if want == 2 else 7
    c = packets[1]
    packets[1] = c[:head] + comment_list(c[head:], tags, sets, False) + (b"" if want == 2 else b"\1")
    out: list[Segment] = [_page(packets[0], bytes([255] * (len(packets[0]) // 255) + [len(packets[0]) % 255]), 0, 2, serial, 0)]
    data = b"".join(packets[1:])
    lacing = b"".join(bytes([255] * (len(p) // 255) + [len(p) % 255]) for p in packets[1:])
    seq, pos = 1, 0
    for i in range(0, len(lacing), 255):
        lace = lacing[i : i + 255]
        body = data[pos : pos + sum(lace)]
        out.append(_page(body, lace, 0 if any(x < 255 for x in lace) else -1, 1 if i and lacing[i - 1] == 255 else 0, serial, seq))
        pos += sum(lace)
        seq += 1
    for start, body, lace in pages[used:]:
        out.append(_page(b[body : body + sum(lace)], lace, int.from_bytes(b[start + 6 : start + 14], "little", signed=True), b[start + 5], serial, seq))
        seq += 1
    return out


# ID3


_FRAMES = {k: f for f, k in reversed(K.ID3_FRAMES.items())}
_TXXX = {k: n for n, k in reversed(K.ID3_TXXX.items())}
_ROLE = {"PRODUCER": "producer", "ENGINEER": "engineer", "MIXER": "mix", "ARRANGER": "arranger", "DJMIXER": "DJ-mix"}
_DATES = {"RECORDINGDATE": "TDRC", "RELEASEDATE": "TDRL", "ORIGINALDATE": "TDOR"}
_MODELLED = {*K.ID3_FRAMES, *_DATES.values(), *"TXXX TCON TRCK TPOS TIPL IPLS TMCL TYER TDAT TIME TORY".split()}
_CREDIT = re.compile(r"(.+) \(([^()]+)\)", re.S)


def _modelled(name: str, flags: bytes, d: bytes, version: int) -> bool:
    """Whether the model holds this frame, so that its tags are written in its place."""
    if frame_data(d, flags[1], version) is None:
        return False
    if name == "USLT":
        return len(d) > 4
    if name == "COMM":
        return len(d) > 4 and not cut_string(d[0], d[4:])[0]
    if name == "UFID":
        return d.startswith(b"http://musicbrainz.org\0")
    return name in _MODELLED


def _unknown_roles(frames: list[tuple[str, bytes, bytes]]) -> list[str]:
    """Roles and people of the old credits that no key stands for."""
    out: list[str] = []
    for name, _, d in frames:
        if name in ("TIPL", "IPLS") and d:
            pairs = frame_text(d[0], d[1:])
            out += [x for role, who in zip(pairs[::2], pairs[1::2]) if role.strip().lower() not in K.ID3_ROLES for x in (role, who)]
    return out


def _frames(b: bytes) -> list[tuple[str, bytes, bytes]]:
    """name, flags, data of each frame of a v2.3 or v2.4 tag."""
    version, out = b[3], []
    body = b[10 : 10 + syncsafe(b[6:10])]
    if b[5] & 128 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if b[5] & 64 and version >= 3:
        at = syncsafe(body[:4]) if version == 4 else int.from_bytes(body[:4], "big") + 4
    while version > 2 and at + 10 <= len(body) and body[at]:
        n = syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        out.append((body[at : at + 4].decode("latin-1"), body[at + 8 : at + 10], body[at + 10 : at + 10 + n]))
        at += 10 + n
    return out


def _set_frames(sets: Sets, version: int) -> list[tuple[str, bytes]]:
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) if version == 4 else n.to_bytes(4, "big")
    enc, end = (b"\3", b"\0") if version == 4 else (b"\1", b"\0\0")
    say = lambda s: (s or "").encode("utf-8" if version == 4 else "utf-16")
    out = [("APIC", enc + (p["mime"] or "").encode("latin-1", "replace") + b"\0" + bytes([p["type"]]) + say(p["description"]) + end + bytes(p["data"])) for p in sets.pictures or ()]
    ids = []
    for i, c in enumerate(sets.chapters or ()):
        start, stop = c["start_ns"] // 1_000_000, (c["end_ns"] or 0) // 1_000_000 or 0xFFFFFFFF
        if max(start + 1, stop) > 0xFFFFFFFF:
            raise ValueError("a chapter beyond ID3's time")
        title = enc + say(c["title"])
        ids.append(b"ch%d" % i)
        out.append(("CHAP", ids[-1] + b"\0" + struct.pack(">IIII", start, stop, 0xFFFFFFFF, 0xFFFFFFFF) + b"TIT2" + size(len(title)) + b"\0\0" + title))
    if ids:
        if len(ids) > 255:
            raise ValueError("more than 255 chapters")
        out.insert(len(out) - len(ids), ("CTOC", b"toc\0" + bytes([3, len(ids)]) + b"".join(i + b"\0" for i in ids)))
    for y in sets.lyrics or ():
        lines = b"".join(say(x["text"]) + end + struct.pack(">I", x["time_ns"] // 1_000_000) for x in y["lines"])
        out.append(("SYLT", enc + (y["language"] or "XXX").encode("latin-1", "replace")[:3].ljust(3) + b"\2\1" + say(y["description"]) + end + lines))
    return out


def _replaced(name: str, d: bytes, sets: Sets) -> bool:
    return name == "APIC" and sets.pictures is not None or name in ("CHAP", "CTOC") and sets.chapters is not None or name == "SYLT" and sets.lyrics is not None and d[4:6] == b"\2\1"


def id3_tag(old: bytes, tags: dict[str, list[str]], sets: Sets = KEEP) -> bytes:
    """A tag of the old one's version (2.4 where there is none), its frames that the model doesn't hold, and the tags."""
    version = 3 if old[3:4] == b"\3" else 4
    out: list[tuple[str, bytes, bytes]] = []
    none = b"\0\0"

    def put(name: str, values: list[str]) -> None:
        s = "\0".join(values)
        out.append((name, none, b"\3" + s.encode() if version == 4 else b"\1" + s.encode("utf-16")))

    frames = _frames(old) if old else []
    roles, people = _unknown_roles(frames), []
    for key, values in tags.items():
        if not values or key in ("TRACKTOTAL", "DISCTOTAL") and key.replace("TOTAL", "NUMBER") in tags:
            continue
        if key in ("TRACKNUMBER", "DISCNUMBER", "TRACKTOTAL", "DISCTOTAL"):
            stem = key[:5].rstrip("NT") if key[0] == "T" else "DISC"
            n, t = tags.get(f"{'TRACK' if stem != 'DISC' else 'DISC'}NUMBER", [""])[0], tags.get(f"{'TRACK' if stem != 'DISC' else 'DISC'}TOTAL", [""])[0]
            put("TPOS" if stem == "DISC" else "TRCK", [f"{n}/{t}" if t else n])
        elif key in _FRAMES:
            put(_FRAMES[key], values)
        elif key == "GENRE":
            put("TCON", ["(" + v if v.startswith("(") else v for v in values])
        elif key in _DATES and version == 4:
            put(_DATES[key], values[:1])
        elif key == "RECORDINGDATE" and re.fullmatch(r"\d{4}(-\d\d-\d\d)?", values[0]):
            put("TYER", [values[0][:4]])
            if len(values[0]) == 10:
                put("TDAT", [values[0][8:10] + values[0][5:7]])
        elif key == "ORIGINALDATE" and version == 3 and re.fullmatch(r"\d{4}", values[0]):
            put("TORY", values[:1])
        elif key in _ROLE:
            for v in values:
                roles += [_ROLE[key], v]
        elif key == "PERFORMER" and version == 4:
            for v in values:
                m = _CREDIT.fullmatch(v)
                people += [m[2], m[1]] if m else ["", v]
        elif key in ("COMMENT", "LYRICS"):
            for v in values:
                enc = (b"\3", b"\0", v.encode()) if version == 4 else (b"\1", b"\xff\xfe\0\0", v.encode("utf-16"))
                out.append(("COMM" if key == "COMMENT" else "USLT", none, enc[0] + b"XXX" + enc[1] + enc[2]))
        elif key == "MUSICBRAINZ_TRACKID":
            out.append(("UFID", none, b"http://musicbrainz.org\0" + values[0].encode("latin-1", "replace")))
        else:
            put("TXXX", [_TXXX.get(key, key), *values])
    if roles:
        put("TIPL" if version == 4 else "IPLS", roles)
    if people:
        put("TMCL", people)
    out += [(n, none, d) for n, d in _set_frames(sets, version)]
    out += [f for f in frames if not _modelled(*f, version) and not _replaced(f[0], f[2], sets)]
    body = b"".join(n.encode("latin-1") + (bytes([len(d) >> 21 & 127, len(d) >> 14 & 127, len(d) >> 7 & 127, len(d) & 127]) if version == 4 else len(d).to_bytes(4, "big")) + fl + d for n, fl, d in out)
    n = len(body) + 64
    if n >= 1 << 28:
        raise ValueError("a tag beyond ID3's size")
    return b"ID3" + bytes([version, 0, 0, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body + b"\0" * 64


def write_id3_front(b: bytes, tags: dict, sets: Sets = KEEP) -> list[Segment]:
    n = min(id3_size(b), len(b))
    return [*([id3_tag(b[:n], tags, sets)] if tags or n or sets.any() else []), (n, len(b))]


def _write_chunks(b: bytes, tags: dict, big: bool, sets: Sets = KEEP) -> list[Segment]:
    order = "big" if big else "little"
    out: list[Segment] = [(8, 12)]
    at, old = 12, b""
    native = K.AIFF_TEXT if big else None
    while at + 8 <= len(b):
        name, n = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], order)
        end = min(at + 8 + n + (n & 1), len(b))
        if name in (b"id3 ", b"ID3 "):
            old = b[at + 8 : at + 8 + n]
        elif not big and name == b"LIST" and b[at + 8 : at + 12] == b"INFO":
            kept = b"".join(_info_left(b, at + 12, min(at + 8 + n, len(b))))
            if kept:
                out.append(b"LIST" + (len(kept) + 4).to_bytes(4, order) + b"INFO" + kept)
        elif not (native and name.decode("latin-1") in native):
            out.append((at, end))
            if (end - at) & 1:
                out.append(b"\0")
        at = at + 8 + n + (n & 1)
    if tags or old or sets.any():
        new = id3_tag(old, tags, sets)
        out.append((b"ID3 " if big else b"id3 ") + len(new).to_bytes(4, order) + new + b"\0" * (len(new) & 1))
    return [b[:4] + output_length(out).to_bytes(4, order), *out]


def _info_left(b: bytes, at: int, end: int):
    """The items of an INFO list that no key stands for, as they are."""
    while at + 8 <= end:
        n = int.from_bytes(b[at + 4 : at + 8], "little")
        if b[at : at + 4].decode("latin-1") not in K.RIFF_INFO:
            x = b[at : min(at + 8 + n, end)]
            yield x + b"\0" * (len(x) & 1)
        at += 8 + n + (n & 1)


# MP4


_MP4 = {k: n for n, k in reversed(K.MP4_TEXT.items())}
_FREE = {k: n for n, k in reversed(K.MP4_FREEFORM.items())}


def _atom(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def _items(old: bytes, tags: dict[str, list[str]], sets: Sets = KEEP) -> bytes:
    data = lambda kind, d: _atom(b"data", struct.pack(">II", kind, 0), d)
    num = lambda k: int(v) if (v := (tags.get(k) or ["0"])[0].strip()).lstrip("+").isdigit() else 0
    out = []
    for key, values in tags.items():
        if key in ("TRACKNUMBER", "TRACKTOTAL", "DISCNUMBER", "DISCTOTAL"):
            stem = "TRACK" if key[0] == "T" else "DISC"
            n, t = num(stem + "NUMBER"), num(stem + "TOTAL")
            if (n or t) and (key.endswith("NUMBER") or stem + "NUMBER" not in tags):
                out.append(_atom(b"trkn" if stem == "TRACK" else b"disk", data(0, struct.pack(">HHHH", 0, min(n, 65535), min(t, 65535), 0))))
        elif key in ("COMPILATION", "MEDIATYPE"):
            v = values[0].strip().lower() if values else ""
            v = {"true": "1", "yes": "1", "false": "0", "no": "0"}.get(v, v)
            if v.isdigit() and int(v) < 256:
                out.append(_atom(b"cpil" if key == "COMPILATION" else b"stik", data(21, bytes([int(v)]))))
        elif key in _MP4:
            out.append(_atom(_MP4[key].encode("latin-1"), *(data(1, v.encode()) for v in values)))
        elif values:
            out.append(_atom(b"----", _atom(b"mean", b"\0\0\0\0com.apple.iTunes"), _atom(b"name", b"\0\0\0\0" + _FREE.get(key, key).encode()), *(data(1, v.encode()) for v in values)))
    known = {b"trkn", b"disk", b"cpil", b"stik", b"gnre", b"----", *(n.encode("latin-1") for n in K.MP4_TEXT)}
    if sets.pictures is not None:
        known.add(b"covr")
        kinds = {"image/jpeg": 13, "image/png": 14, "image/bmp": 27}
        covers = [(kinds.get(sniff_image(bytes(p["data"]))[0]), bytes(p["data"])) for p in sets.pictures]
        if any(k is None for k, _ in covers):
            raise ValueError("a picture of a kind that MP4 doesn't take")
        out += [_atom(b"covr", *(data(k, d) for k, d in covers))] if covers else []
    kept = [_atom(a, old[x:y]) for a, x, y in _atoms(old, 0, len(old)) if a not in known]
    return _atom(b"ilst", *out, *kept)


def _chpl(chapters: list[dict]) -> bytes:
    if len(chapters) > 255:
        raise ValueError("more than 255 chapters")
    titles = [(c["title"] or "").encode()[:255].decode("utf-8", "ignore").encode() for c in chapters]
    return _atom(b"chpl", b"\1\0\0\0\0\0\0\0", bytes([len(chapters)]), *(struct.pack(">QB", c["start_ns"] // 100, len(t)) + t for c, t in zip(chapters, titles))) if chapters else b""


def write_mp4(b: bytes, tags: dict, sets: Sets = KEEP) -> list[Segment]:
    """moov is built anew with the item list; where that moves the audio, its offset tables are moved along. Files with offsets elsewhere (fragments, iloc, saio) are refused."""
    if sets.lyrics is not None:
        raise ValueError("timed lyrics aren't written to MP4")
    top = list(_atoms(b, 0, len(b)))

    def offsets(lo: int, hi: int, depth: int) -> bool:
        return any(a in (b"moof", b"mvex", b"iloc", b"saio") or depth < 8 and a in (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta") and offsets(x, y, depth + 1) for a, x, y in _atoms(b, lo, hi))

    if offsets(0, len(b), 0) or any(a == b"meta" and b"iloc" in b[x:y] for a, x, y in top):
        raise ValueError("fragmented, or with offsets that can't be moved")

    def rebuild(lo: int, hi: int, path: tuple, shift: int) -> bytes:
        parts, done = [], False
        for a, x, y in _atoms(b, lo, hi):
            body = b[x:y]
            if a == b"chpl" and path == (b"moov", b"udta") and sets.chapters is not None:
                continue
            if a in (b"trak", b"mdia", b"minf", b"stbl") or path == (b"moov",) and a == b"udta":
                body = rebuild(x, y, (*path, a), shift)
                done |= a == b"udta"
            elif a == b"meta" and path == (b"moov", b"udta"):
                head = 4 if body[:4] == b"\0\0\0\0" else 0
                body = body[:head] + rebuild(x + head, y, (*path, a), shift)
                done = True
            elif a == b"ilst" and path == (b"moov", b"udta", b"meta"):
                parts.append(_items(body, tags, sets))
                done = True
                continue
            elif a in (b"stco", b"co64") and shift:
                w = 4 if a == b"stco" else 8
                n = int.from_bytes(body[4:8], "big")
                body = body[:8] + b"".join((int.from_bytes(body[8 + w * i : 8 + w * i + w], "big") + shift).to_bytes(w, "big") for i in range(min(n, (len(body) - 8) // w))) + body[8 + w * n :]
            parts.append(_atom(a, body))
        if path == (b"moov", b"udta") and sets.chapters:
            parts.append(_chpl(sets.chapters))
        hdlr = _atom(b"hdlr", b"\0" * 8 + b"mdirappl" + b"\0" * 9)
        if not done and path == (b"moov",):
            parts.append(_atom(b"udta", _chpl(sets.chapters or []), _atom(b"meta", b"\0\0\0\0", hdlr, _items(b"", tags, sets))))
        elif not done and path == (b"moov", b"udta"):
            parts.append(_atom(b"meta", b"\0\0\0\0", hdlr, _items(b"", tags, sets)))
        elif not done and path == (b"moov", b"udta", b"meta"):
            parts.append(_items(b"", tags, sets))
        return b"".join(parts)

    moov = next((i for i, (a, _, _) in enumerate(top) if a == b"moov"), None)
    if moov is None:
        raise ValueError("no moov atom")
    lo, hi = top[moov][1], top[moov][2]
    start = lo - (16 if int.from_bytes(b[lo - 16 : lo - 12], "big") == 1 and b[lo - 12 : lo - 8] == b"moov" else 8)
    new = rebuild(lo, hi, (b"moov",), 0)
    before = any(a == b"mdat" and x > lo for a, x, _ in top)
    shift = len(new) + 8 - (hi - start) if before else 0
    if shift:
        new = rebuild(lo, hi, (b"moov",), shift)
    return [(0, start), _atom(b"moov", new), (hi, len(b))]


# Matroska


_MKV = {k: n for n, k in reversed(K.MATROSKA.items())} | {"RECORDINGDATE": "DATE_RECORDED", "RELEASEDATE": "DATE_RELEASED", "ARTIST": "ARTIST"}


def _element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (1 << 56 | len(data)).to_bytes(8, "big") + data


def write_matroska(b: bytes, tags: dict, sets: Sets = KEEP) -> list[Segment]:
    """Old tags become a void of their size, so nothing moves; the new ones come last in the segment."""
    if sets.any():
        raise ValueError("pictures, chapters and lyrics aren't written to Matroska")
    segment = next(((x, y) for i, x, y in _elements(b, 0, len(b)) if i == 0x18538067), None)
    if segment is None:
        raise ValueError("no segment")
    lo, hi = segment
    n = b[lo - 8]
    if n != 1:
        raise ValueError("a segment whose size has no room")
    simple = lambda k, v: _element(0x67C8, _element(0x45A3, k.encode()) + _element(0x4487, v.encode()))
    album = [simple("TITLE", v) for v in tags.get("ALBUM", ())]
    song = [simple(_MKV.get(k, k), v) for k, vs in tags.items() if k != "ALBUM" for v in vs]
    target = lambda level, parts: _element(0x7373, _element(0x63C0, _element(0x68CA, bytes([level]))) + b"".join(parts)) if parts else b""
    new = _element(0x1254C367, target(50, album) + target(30, song))
    out: list[Segment] = [(0, lo - 8), b"", (lo, lo)]
    at, size = lo, 0
    for i, x, y in _elements(b, lo, hi):
        if i == 0x1254C367:
            out += [(at, at), b"\xec" + (1 << 56 | (y - at - 9)).to_bytes(8, "big") + b"\0" * (y - at - 9)] if y - at >= 9 else [(at, y)]
        elif i == 0x1549A966 and "TITLE" in tags or i == 0x1549A966:
            # The info title would come before any tag.
            kept = [(p, q) for k, r, q in _elements(b, x, y) for p in [_start(b, x, r)] if k != 0x7BA9]
            out += [(at, at), b"", *([(at, y)] if all(k != 0x7BA9 for k, _, _ in _elements(b, x, y)) else [_retitle(b, at, x, y, kept)])]
        else:
            out.append((at, y))
        at = y
    size = output_length(out[2:]) + len(new)
    out[1] = (1 << 56 | size).to_bytes(8, "big")
    return [*out, new, (hi, len(b))]


def _start(b: bytes, lo: int, data: int) -> int:
    """Where the element whose data starts at `data` starts, among those from lo on."""
    at = lo
    for _, x, y in _elements(b, lo, len(b)):
        if x == data:
            return at
        at = y
    return data


def _retitle(b: bytes, at: int, x: int, y: int, kept: list) -> bytes:
    """The info element without its title, a void in its place, so that it keeps its size."""
    body = b"".join(b[p:q] for p, q in kept)
    gap = y - x - len(body)
    void = b"\xec" + (bytes([0x80 | gap - 2]) if gap < 129 else (1 << 56 | gap - 9).to_bytes(8, "big"))
    return b[at:x] + body + void + b"\0" * (gap - len(void))


WRITERS = {"FLAC": write_flac, "Ogg": write_ogg, "MP3": write_id3_front, "AAC": write_id3_front, "WAV": lambda b, t, s: _write_chunks(b, t, False, s), "AIFF": lambda b, t, s: _write_chunks(b, t, True, s), "MP4": write_mp4, "Matroska": write_matroska}


_KEY = re.compile(r"[\x20-\x3C\x3E-\x60\x7B-\x7E]+")


def plan(b: bytes, tags: dict[str, list[str]], m: Media | None = None, sets: Sets = KEEP, strip: bool = False) -> list[Segment]:
    """m: b, parsed, where that has been done; strip: old tags behind the audio go."""
    name, _ = detect(b)
    if not name:
        raise ValueError("unsupported format")
    if not any(hi > lo for lo, hi in (m or parse(b)).ranges):
        raise ValueError("no audio")
    for k, vs in tags.items():
        if not _KEY.fullmatch(k):
            raise ValueError(f"invalid key: {k!r}")
        if any("\0" in v for v in vs):
            raise ValueError(f"NUL in {k}")
    if any(not 0 <= p["type"] <= 20 or not p["data"] for p in sets.pictures or ()):
        raise ValueError("a picture without a known role, or without data")
    if len([p for p in sets.pictures or () if p["type"] == 1]) > 1 or len([p for p in sets.pictures or () if p["type"] == 2]) > 1:
        raise ValueError("several icons of one role")
    if any(c["start_ns"] < 0 or c["end_ns"] and c["end_ns"] < c["start_ns"] for c in sets.chapters or ()):
        raise ValueError("a chapter that ends before it starts")
    out = WRITERS[name](b, {k: v for k, v in tags.items() if v}, sets)
    if strip and name in ("MP3", "AAC", "FLAC") and isinstance(out[-1], tuple):
        out[-1] = (out[-1][0], max(out[-1][0], (m or parse(b)).ranges[-1][1]))
    return out


def write(b: bytes, tags: dict[str, list[str]], sets: Sets = KEEP, strip: bool = False) -> bytes:
    """The file with these tags. Checked: the new file parses, and its audio is the old one's."""
    return written(b, tags, sets, strip, parse(b))[0]


def written(b: bytes, tags: dict[str, list[str]], sets: Sets, strip: bool, old: Media) -> tuple[bytes, Media]:
    """As write, of a file that was parsed before; also the new file, parsed."""
    out = join(b, plan(b, tags, old, sets, strip))
    new = parse(out)
    if _audio(out, new) != _audio(b, old):
        raise ValueError("the audio would change")
    return out, new


def _audio(b: bytes, m: Media) -> bytes:
    return m.config + b"".join(b[lo:hi] for lo, hi in m.ranges)
