"""Operators over media rows, display functions and commands."""

import zlib

import builders as B
from pyspark.sql import functions as F

from tagquarry.__main__ import main
from tagquarry.functions import display as D
from tagquarry.operators import media as M
from tagquarry.sources import media


def test_display(spark):
    assert [D.human_size(n) for n in (5, 1024, 1536, 1024**2 - 1, 1024**2)] == ["5 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "1.0 MiB"]
    assert D.repair_text(b"a\xff\xffb\xe9") == "a�b�" and D.repair_text("é".encode()) == "é" and D.repair_text(None) is None
    long = "é" * 3000
    assert D.elide_text("x") == "x" and D.elide_text(long).startswith("é" * 2048 + "…") and D.elide_text(long).endswith("(5.9 KiB)")
    rows = spark.createDataFrame([(long, bytearray(b"\xff\xff")), (None, None)], "a string, b binary").select(D.elide("a"), D.repair_utf8("b")).collect()
    assert rows[0][0] == D.elide_text(long) and rows[0][1] == "�" and rows[1][:] == (None, None)
    t = F.struct(F.lit("FLAC").alias("codec"), F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"), F.lit(16).alias("bits_per_sample"), F.lit(1_500_000_000).alias("duration_ns"))
    assert spark.range(1).select(D.audio_line(t), D.file_name(F.lit("/a/b.c")), D.is_cover_name(F.lit("Cover.JPG")), D.is_cover_name(F.lit("x.jpg"))).first()[:] == ("FLAC, 44100 Hz, 2 ch, 16 bit, 0:00:01.500", "b.c", True, False)


def test_rows(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert spark.range(1).select(M.subtract_fold(arr("a", "A ", "b"), arr("a")), M.subtract_fold(arr("a"), arr("b"))).first()[:] == (["A ", "b"], ["a"])
    codes = spark.createDataFrame([("ok",), ("malformed",), ("no-audio",)], "c string")
    assert codes.agg(M.worst_error(F.col("c"))).first()[0] == "malformed"
    ident = lambda s, t, f: F.struct(F.lit(s).alias("size"), F.lit(t).alias("mtime_ns"), F.lit(f).alias("fingerprint"))
    assert spark.range(1).select(M.same_identity(ident(1, 2, "x"), ident(1, 0, "x")), M.same_identity(ident(1, 2, "x"), ident(1, 3, "x"))).first()[:] == (True, False)
    pics = F.array(*(F.struct(F.lit(k).alias("type")) for k in (0, 3, 4, 4)))
    pick = [M.select_picture(pics, s)["type"] for s in ("", "1", "back-cover", "front-cover", "9", "nonsense")]
    assert list(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(pick))).first()) == [3, 0, None, 3, None, None]
    assert spark.range(1).select(F.size(M.remove_pictures(pics, lambda p: p["type"] == 4))).first()[0] == 2


def test_commands(spark, tmp_path, capsys):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    (a / "x.flac").write_bytes(B.flac([("TITLE", "x"), ("RECORDINGDATE", "2021-13")], [(3,)]))
    (a / "y.mp3").write_bytes(B.mpeg())
    assert main(["set", str(a), str(b), "--set", "title=new", "--clear", "DATE", "--add", "artist=A"]) == 0
    assert main(["diff", str(a), str(b)]) == 1 and main(["diff", str(a), str(a)]) == 0
    assert main(["lint", str(a)]) == 1 and main(["lint", str(b)]) == 0
    assert main(["verify", str(a)]) == 0 and main(["dump", str(a)]) == 0 and main(["keys"]) == 0 and main(["caps"]) == 0
    assert main(["export-picture", str(a / "x.flac"), str(tmp_path / "p.png")]) == 0 and (tmp_path / "p.png").read_bytes() == B.PNG
    assert main(["export-picture", str(a / "y.mp3"), str(tmp_path / "q.png")]) == 2
    said = capsys.readouterr().out
    assert "~ TITLE: x -> new" in said and "malformed-date" in said and '"schemaVersion":1' in said and "ACOUSTID_ID" in said
    m = media.read_media(spark, str(a))
    assert {r[0] for r in m.select(M.duration_ns(F.col("tracks")) > 0).collect()} == {True} and m.select(F.max(M.padding(F.col("native")))).first()[0] == 10


def test_sets(spark, tmp_path):
    from tagquarry.operators.transfer import grade_sets

    (tmp_path / "x.flac").write_bytes(B.flac([("TITLE", "x"), ("CHAPTER001", "00:00:01.000")], [(3, "image/png", ""), (4, "image/png", "d"), (3, "image/gif", "", b"GIF89a\5\0\6\0\x87" + b"\0" * 20)]))
    m = media.read_media(spark, str(tmp_path))
    got = lambda to: {r.dimension: (r.carried, r.lossy, r.dropped) for r in grade_sets(m, F.lit(to), "path").collect()}
    assert got("MP4") == {"pictures": (1, 1, 1), "chapters": (1, 0, 0), "lyrics": (0, 0, 0)}
    assert got("WebM")["pictures"] == (0, 0, 3) and got("FLAC")["pictures"] == (3, 0, 0) and got("Matroska")["pictures"] == (2, 1, 0)


def test_plan_copy_and_fix(spark, tmp_path, capsys):
    from tagquarry.sources.containers import parse

    a, b, out = tmp_path / "a", tmp_path / "b", tmp_path / "out"
    a.mkdir()
    b.mkdir()
    (a / "x.flac").write_bytes(B.flac([("TITLE", "x"), ("ARTIST", "A"), ("ENCODER", "Lavf58")]))
    (b / "x.mp3").write_bytes(B.id3(B.text("TIT2", "old"), B.text("TALB", "L")) + B.mpeg() + B.id3v1("old", 255, 0))
    tags = lambda p: {t["key"]: t["values"] for t in parse(p.read_bytes()).tags()}
    assert main(["plan", str(a), "--set", "TITLE=y", "--clear", "ARTIST"]) == 0
    assert sorted(x.split("\t")[1] for x in capsys.readouterr().out.splitlines()) == ["- ARTIST: A", "~ TITLE: x -> y"] and tags(a / "x.flac")["TITLE"] == ["x"]
    assert main(["copy", str(a), str(b), str(out)]) == 0
    assert {k: v for k, v in tags(out / "x.mp3").items() if k != "ENCODER"} == {"TITLE": ["x"], "ARTIST": ["A"], "ALBUM": ["L"]}
    assert main(["lint", str(a), "--fix", str(out)]) == 0 and "ENCODER" not in tags(out / "x.flac") and tags(out / "x.flac")["ARTIST"] == ["A"]


def test_files_beyond_the_limits_are_rows(spark, tmp_path):
    (tmp_path / "big.flac").write_bytes(B.flac(padding=5000))
    (tmp_path / "many.wav").write_bytes(B.wav()[:12] + B.chunk(b"junk", b"") * 100_001)
    rows = {r.path.rsplit("/")[-1]: r for r in media.read_media(spark, str(tmp_path), max_size=1 << 20).collect()}
    assert rows["many.wav"].error.code == "too-large" and rows["big.flac"].error is None
    rows = {r.path.rsplit("/")[-1]: r for r in media.read_media(spark, str(tmp_path), max_size=2000).collect()}
    assert rows["big.flac"].error.code == "too-large" and rows["big.flac"].size > 5000 and len(rows) == 2


def test_frames_and_lyrics():
    from tagquarry.sources.containers import lrc, parse

    zipped = b"\0\0\0\7" + zlib.compress(b"\3packed")
    packed = b"TIT2" + B.safe(len(zipped)) + bytes([0, 9]) + zipped
    secret = b"TPE1" + B.safe(6) + bytes([0, 4]) + b"\0\3abcd"
    m = parse(B.id3(packed, secret) + B.mpeg())
    assert m.tags() == [{"key": "TITLE", "values": ["packed"]}] and ("tag-structure-dropped", "TPE1") in m.warnings
    assert lrc("[offset:-500]\n[00:01.5][00:00.25]a\nno stamp\n[01:00] b") == [{"time_ns": 750_000_000, "text": "a"}, {"time_ns": 2_000_000_000, "text": "a"}, {"time_ns": 60_500_000_000, "text": "b"}]
    many = B.flac([("SYNCEDLYRICS", "\n".join(["[00:00.00]x"] * 65_537))])
    m = parse(many)
    assert ("synced-lyrics-truncated", "65537") in m.warnings and len(m.lyrics[0]["lines"]) == 65_536
