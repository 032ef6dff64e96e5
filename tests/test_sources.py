"""Readers over files built byte by byte."""

import builders as B
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagquarry.sources import media
from tagquarry.sources.containers import genres, sniff_image
from tagquarry.streaming.watch import watch_media


def read(b):
    r = media.row("x", b)
    assert r["error"] is None, r["error"]
    return r | {"t": {t["key"]: t["values"] for t in r["tags"]}, "codes": [w["code"] for w in r["warnings"]]}


def test_flac():
    r = read(B.flac([("TITLE", "T"), ("artist", "A"), ("artist", "B"), ("DATE", "2020"), ("TRACKNUMBER", "3/12"), ("CHAPTER001", "00:00:01.500"), ("CHAPTER001NAME", "one")], [(3,), (3, "image/png", "e")]))
    assert r["format"] == "FLAC" and r["t"] == {"TITLE": ["T"], "ARTIST": ["A", "B"], "RECORDINGDATE": ["2020"], "TRACKNUMBER": ["3"], "TRACKTOTAL": ["12"]}
    assert r["tracks"][0]["sample_rate"] == 44100 and r["tracks"][0]["channels"] == 2 and r["tracks"][0]["bits_per_sample"] == 16 and r["tracks"][0]["duration_ns"] == 10**9
    assert len(r["pictures"]) == 2 and r["pictures"][0]["width"] == 3 and r["chapters"][0]["start_ns"] == 1_500_000_000
    assert r["essence"] == read(B.flac([("TITLE", "other")]))["essence"] != read(B.flac(audio=b"else"))["essence"]
    assert "no-audio" in read(B.flac(audio=b""))["codes"] and "stray-leading-id3" in read(B.id3() + B.flac())["codes"]


@pytest.mark.parametrize("version", [3, 4])
def test_mp3(version):
    tag = B.id3(B.text("TIT2", "Tï", 1, version), B.text("TPE1", "A\0B", 3, version), B.text("TRCK", "4/9", 0, version), B.text("TCON", "(17)Hard", 0, version), B.frame("TXXX", b"\3MusicBrainz Album Id\0id", version), B.text("TYER", "1999", 0, version), B.text("TDAT", "3112", 0, version),
                B.frame("APIC", b"\0image/png\0\3d\0" + B.PNG, version), B.frame("CHAP", b"c1\0" + b"\0\0\0\0" + (5000).to_bytes(4, "big") + b"\xff" * 8 + B.text("TIT2", "Intro", 3, version), version), version=version)
    r = read(tag + B.mpeg() + B.id3v1() + B.ape([("Title", b"Ape"), ("Foo", b"x\0y")]))
    assert r["t"] == {"TITLE": ["Tï"], "ARTIST": ["A", "B"], "TRACKNUMBER": ["4"], "TRACKTOTAL": ["9"], "GENRE": ["Rock", "Hard"], "MUSICBRAINZ_ALBUMID": ["id"], "RECORDINGDATE": ["1999-12-31"]}
    assert {"legacy-ape", "trailing-id3v1", "numeric-genre"} <= set(r["codes"])
    legacy = {(f["key"], f["family"]): f["values"] for f in r["families"] if f["legacy"]}
    assert legacy["TITLE", "ape"] == ["Ape"] and legacy["FOO", "ape"] == ["x", "y"] and legacy["TITLE", "id3v1"] == ["Old"] and legacy["GENRE", "id3v1"] == ["Rock"]
    assert r["chapters"] == [{"start_ns": 0, "end_ns": 5_000_000_000, "title": "Intro", "language": "", "hidden": False, "disabled": False}]
    assert r["tracks"][0]["codec"] == "MP3" and r["tracks"][0]["bitrate"] == 128000 and r["essence_ranges"] == [{"lo": len(tag), "hi": len(tag) + len(B.mpeg())}]
    assert read(B.id3() + B.xing(100) + B.mpeg())["tracks"][0]["duration_ns"] == int(100 * 1152 / 44100 * 1e9)


def test_other_formats():
    r = read(B.id3(B.text("TIT2", "A")) + B.adts())
    assert r["format"] == "AAC" and r["t"] == {"TITLE": ["A"]} and r["tracks"][0]["total_samples"] == 5 * 1024 and r["tracks"][0]["codec_profile"] == "LC"
    r = read(B.wav([(b"INAM", b"Name\0"), (b"IART", b"Art"), (b"IPRT", b"2/3")], B.id3(B.text("TIT2", "Id"))))
    assert r["t"] == {"TITLE": ["Id"], "ARTIST": ["Art"], "TRACKNUMBER": ["2"], "TRACKTOTAL": ["3"]} and r["tracks"][0]["duration_ns"] == 10**9
    assert [f for f in r["families"] if f["legacy"]][0]["selected"] is False
    r = read(B.aiff([(b"NAME", b"N"), (b"ANNO", b"c1"), (b"ANNO", b"c2")]))
    assert r["t"] == {"TITLE": ["N"], "COMMENT": ["c1", "c2"]} and r["tracks"][0]["sample_rate"] == 44100 and r["tracks"][0]["duration_ns"] == 10**9
    r = read(B.opus([("title", "O"), ("YEAR", "2001")]))
    assert r["format"] == "Opus" and r["t"] == {"TITLE": ["O"], "RECORDINGDATE": ["2001"]} and r["tracks"][0]["duration_ns"] == 10**9
    r = read(B.vorbis([("GENRE", "x" * 300)]))
    assert r["format"] == "Ogg Vorbis" and r["t"]["GENRE"] == ["x" * 300] and r["tracks"][0]["duration_ns"] == 2 * 10**9
    r = read(B.mp4([(b"\xa9nam", 1, b"M"), (b"trkn", 0, b"\0\0\0\3\0\7\0\0"), (b"gnre", 0, b"\0\x12"), (b"cpil", 21, b"\1"), (b"----", "MusicBrainz Album Id", b"id"), (b"covr", 14, B.PNG)], [(0, b"c0"), (1500, b"c1")]))
    assert r["t"] == {"TITLE": ["M"], "TRACKNUMBER": ["3"], "TRACKTOTAL": ["7"], "GENRE": ["Rock"], "COMPILATION": ["1"], "MUSICBRAINZ_ALBUMID": ["id"]}
    assert r["tracks"][0]["duration_ns"] == 2_500_000_000 and [c["start_ns"] for c in r["chapters"]] == [0, 1_500_000_000] and r["pictures"][0]["mime"] == "image/png"
    r = read(B.matroska([(50, b"TITLE", b"Album"), (30, b"TITLE", b"Song"), (30, b"PART_NUMBER", b"2"), (30, b"BPS", b"1")], chapters=[(0, 5, b"a"), (10, 3, b"b")]))
    assert r["format"] == "Matroska" and r["t"] == {"ALBUM": ["Album"], "TITLE": ["Song"], "TRACKNUMBER": ["2"]} and r["tracks"][0]["duration_ns"] == 1_500_000_000
    assert [(c["end_ns"], c["language"]) for c in r["chapters"]] == [(5, ""), (0, "")] and read(B.matroska(doc=b"webm"))["format"] == "WebM"


ALL = [B.flac([("A", "b")], [(3,)]), B.id3(B.text("TIT2", "x")) + B.mpeg() + B.id3v1(), B.adts(), B.wav([(b"INAM", b"n")]), B.aiff([(b"NAME", b"N")]), B.opus([("a", "b")]), B.vorbis(), B.mp4([(b"\xa9nam", 1, b"M")], [(0, b"c")]), B.matroska([(50, b"TITLE", b"x")])]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(ALL), st.integers(0, 10**6), st.binary(max_size=6), st.booleans())
def test_broken_bytes_give_a_row(b, at, junk, cut):
    at %= len(b)
    media.row("x", b[:at] if cut else b[:at] + junk + b[at + len(junk) :])


def test_genres_and_images():
    assert [genres(x) for x in ("17", "(51)(39)", "(17)Hard", "RX", "+7", "007", "08", "(999)", "((x)")] == [["Rock"], ["Techno-Industrial", "Noise"], ["Rock", "Hard"], ["Remix"], ["+7"], ["007"], ["08"], ["(999)"], ["(x)"]]
    assert sniff_image(B.PNG) == ("image/png", 3, 2, 24) and sniff_image(b"GIF89a\5\0\6\0\x87")[:3] == ("image/gif", 5, 6) and sniff_image(b"nothing")[0] == ""
    assert sniff_image(b"\xff\xd8\xff\xe0\0\4xx\xff\xc0\0\x11\x08\0\x07\0\x09\3")[:3] == ("image/jpeg", 9, 7)


def test_read_folder_and_stream(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.FLAC": B.flac([("TITLE", "a")]), "sub/b.flac": B.flac([("TITLE", "b")]), "c.mp3": B.mpeg(), "bad.ogg": b"nope", "note.txt": b"x"}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    m = media.read_media(spark, str(tmp_path)).cache()
    rows = {r.path.rsplit("/", 1)[1]: r for r in m.collect()}
    assert sorted(rows) == ["a.FLAC", "b.flac", "bad.ogg", "c.mp3"] and rows["bad.ogg"].error.code == "unsupported-format" and rows["a.FLAC"].error is None
    assert [(r.n, len(r.paths)) for r in media.duplicates(m).collect()] == [(2, 2)]
    s = {r.path.rsplit("/", 1)[1]: r for r in media.inspect(m).collect()}
    assert s["a.FLAC"].padding == 10 and s["a.FLAC"].duration_ns == 10**9
    assert media.parse_media(m.select("path", m["essence"].cast("binary").alias("content")).where("false")).count() == 0
    q = watch_media(spark, str(tmp_path)).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "_cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("watched").count() == 4
