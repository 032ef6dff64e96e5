"""The key vocabulary: what is known of each canonical tag key, and the spellings that lead to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KEYS = """TITLE ARTIST ALBUM ALBUMARTIST COMPOSER LYRICIST GENRE TRACKNUMBER TRACKTOTAL DISCNUMBER DISCTOTAL RECORDINGDATE RELEASEDATE
ORIGINALDATE COMMENT LYRICS GROUPING COPYRIGHT TITLESORT ARTISTSORT ALBUMSORT ALBUMARTISTSORT COMPOSERSORT ISRC BARCODE CATALOGNUMBER
LABEL MEDIA DISCSUBTITLE RELEASECOUNTRY RELEASESTATUS RELEASETYPE CONDUCTOR REMIXER PERFORMER ENCODEDBY ENCODER PRODUCER ENGINEER MIXER
ARRANGER WRITER DJMIXER ACOUSTID_ID ACOUSTID_FINGERPRINT COMPILATION MUSICBRAINZ_ALBUMID MUSICBRAINZ_RELEASEGROUPID MUSICBRAINZ_TRACKID
MUSICBRAINZ_RELEASETRACKID MUSICBRAINZ_WORKID MUSICBRAINZ_DISCID MUSICBRAINZ_ARTISTID MUSICBRAINZ_ALBUMARTISTID REPLAYGAIN_TRACK_GAIN
REPLAYGAIN_TRACK_PEAK REPLAYGAIN_ALBUM_GAIN REPLAYGAIN_ALBUM_PEAK RATING PLAYCOUNT SOURCE_URL SOURCE_ID ACQUISITION_DATE
ENCODING_HISTORY MEDIATYPE DESCRIPTION LONGDESCRIPTION NARRATOR""".split()
KEYS = tuple(_KEYS)
MULTIVALUED = tuple("ARTIST COMPOSER LYRICIST GENRE COMMENT PERFORMER PRODUCER ENGINEER MIXER ARRANGER WRITER DJMIXER RELEASETYPE MUSICBRAINZ_ARTISTID MUSICBRAINZ_ALBUMARTISTID".split())
NUMBER_PAIR = ("TRACKNUMBER", "TRACKTOTAL", "DISCNUMBER", "DISCTOTAL")
NUMERIC = (*NUMBER_PAIR, "PLAYCOUNT")
DATES = ("RECORDINGDATE", "RELEASEDATE", "ORIGINALDATE", "ACQUISITION_DATE")
PEAKS = ("REPLAYGAIN_TRACK_PEAK", "REPLAYGAIN_ALBUM_PEAK")
GAINS = ("REPLAYGAIN_TRACK_GAIN", "REPLAYGAIN_ALBUM_GAIN", *PEAKS)
OWN_AUDIO = ("ENCODER", "ENCODEDBY", "ENCODING_HISTORY", "ACOUSTID_FINGERPRINT", *GAINS)
TRIMMABLE = (*NUMERIC, *DATES, "MEDIATYPE", *GAINS, "RELEASECOUNTRY")
#: Compared by number where a side's format keeps them as numbers.
CANONICAL_NUMBERS = (*NUMBER_PAIR, "MEDIATYPE")
ALIASES = {
    "DATE": "RECORDINGDATE", "YEAR": "RECORDINGDATE", "ORIGINALYEAR": "ORIGINALDATE", "TOTALTRACKS": "TRACKTOTAL", "TRACKTOTAL": "TRACKTOTAL",
    "TOTALDISCS": "DISCTOTAL", "DISCTOTAL": "DISCTOTAL", "ORGANIZATION": "LABEL", "UNSYNCEDLYRICS": "LYRICS", "DISC": "DISCNUMBER", "TRACK": "TRACKNUMBER",
    "ALBUM ARTIST": "ALBUMARTIST", "ALBUM_ARTIST": "ALBUMARTIST", "DJ MIXER": "DJMIXER", "DJ_MIXER": "DJMIXER", "DJ-MIXER": "DJMIXER",
    "MUSICBRAINZ_ALBUMSTATUS": "RELEASESTATUS", "MUSICBRAINZ_ALBUMTYPE": "RELEASETYPE",
}

#: Native name -> canonical key, by family. Where two names lead to one key, the first is written.
ID3_FRAMES = dict(x.split(":") for x in "TIT2:TITLE TPE1:ARTIST TALB:ALBUM TPE2:ALBUMARTIST TCOM:COMPOSER TEXT:LYRICIST TPE3:CONDUCTOR TPE4:REMIXER TCOP:COPYRIGHT TPUB:LABEL TMED:MEDIA TIT1:GROUPING TSST:DISCSUBTITLE TSRC:ISRC TENC:ENCODEDBY TSSE:ENCODER TSOT:TITLESORT TSOP:ARTISTSORT TSOA:ALBUMSORT TSO2:ALBUMARTISTSORT TSOC:COMPOSERSORT TCMP:COMPILATION".split())
ID3_V22 = dict(x.split(":") for x in "TT2:TIT2 TP1:TPE1 TAL:TALB TP2:TPE2 TCM:TCOM TXT:TEXT TP3:TPE3 TP4:TPE4 TCR:TCOP TPB:TPUB TMT:TMED TT1:TIT1 TRC:TSRC TEN:TENC TSS:TSSE TCP:TCMP TCO:TCON TRK:TRCK TPA:TPOS TYE:TYER TDA:TDAT TIM:TIME TOR:TORY TXX:TXXX COM:COMM ULT:USLT PIC:APIC UFI:UFID TST:TSOT TSP:TSOP TSA:TSOA TS2:TSO2 TSC:TSOC".split())
ID3_TXXX = {
    "MUSICBRAINZ ALBUM ID": "MUSICBRAINZ_ALBUMID", "MUSICBRAINZ ARTIST ID": "MUSICBRAINZ_ARTISTID", "MUSICBRAINZ ALBUM ARTIST ID": "MUSICBRAINZ_ALBUMARTISTID",
    "MUSICBRAINZ RELEASE GROUP ID": "MUSICBRAINZ_RELEASEGROUPID", "MUSICBRAINZ RELEASE TRACK ID": "MUSICBRAINZ_RELEASETRACKID", "MUSICBRAINZ WORK ID": "MUSICBRAINZ_WORKID",
    "MUSICBRAINZ DISC ID": "MUSICBRAINZ_DISCID", "ACOUSTID ID": "ACOUSTID_ID", "ACOUSTID FINGERPRINT": "ACOUSTID_FINGERPRINT",
    "MUSICBRAINZ ALBUM RELEASE COUNTRY": "RELEASECOUNTRY", "MUSICBRAINZ ALBUM STATUS": "RELEASESTATUS", "MUSICBRAINZ ALBUM TYPE": "RELEASETYPE",
}
ID3_ROLES = {"producer": "PRODUCER", "engineer": "ENGINEER", "mix": "MIXER", "arranger": "ARRANGER", "dj-mix": "DJMIXER", "mixer": "MIXER", "djmixer": "DJMIXER", "dj-mixer": "DJMIXER", "dj mix": "DJMIXER", "dj mixer": "DJMIXER", "dj_mixer": "DJMIXER"}
RIFF_INFO = dict(x.split(":") for x in "INAM:TITLE IART:ARTIST IPRD:ALBUM ICRD:RECORDINGDATE IGNR:GENRE ICMT:COMMENT ICOP:COPYRIGHT IPRT:TRACKNUMBER ITRK:TRACKNUMBER".split())
AIFF_TEXT = {"NAME": "TITLE", "AUTH": "ARTIST", "(c) ": "COPYRIGHT", "ANNO": "COMMENT"}
MP4_TEXT = {
    "\xa9nam": "TITLE", "\xa9ART": "ARTIST", "aART": "ALBUMARTIST", "\xa9alb": "ALBUM", "\xa9wrt": "COMPOSER", "\xa9day": "RECORDINGDATE", "\xa9cmt": "COMMENT", "\xa9gen": "GENRE",
    "\xa9too": "ENCODER", "cprt": "COPYRIGHT", "\xa9grp": "GROUPING", "\xa9lyr": "LYRICS", "desc": "DESCRIPTION", "ldes": "LONGDESCRIPTION", "soal": "ALBUMSORT", "soaa": "ALBUMARTISTSORT",
    "soar": "ARTISTSORT", "sonm": "TITLESORT", "soco": "COMPOSERSORT",
}
MP4_FREEFORM = {**{k: v for k, v in ID3_TXXX.items()}, "MUSICBRAINZ TRACK ID": "MUSICBRAINZ_TRACKID"}
MATROSKA = {
    "LEAD_PERFORMER": "ARTIST", "DATE_RELEASED": "RELEASEDATE", "DATE_RELEASE": "RELEASEDATE", "DATE_ORIGINAL": "ORIGINALDATE", "ORIGINAL_DATE": "ORIGINALDATE", "DATE_RECORDED": "RECORDINGDATE",
    "PART_NUMBER": "TRACKNUMBER", "TOTAL_PARTS": "TRACKTOTAL", "TOTAL_DISCS": "DISCTOTAL", "CATALOG_NUMBER": "CATALOGNUMBER", "PUBLISHER": "LABEL", "REMIXED_BY": "REMIXER", "CONTENT_GROUP": "GROUPING",
    "ENCODED_BY": "ENCODEDBY",
}
MATROSKA_TECHNICAL = ("DURATION", "BPS", "NUMBER_OF_FRAMES", "NUMBER_OF_BYTES", "NUMBER_OF_BYTES_UNCOMPRESSED", "NUMBER_OF_FRAMES_UNCOMPRESSED")


def category(key: str) -> str:
    """The value contract of a key, as the lint code's tail; text has none."""
    for name, keys in (("number", NUMERIC), ("date", DATES), ("boolean", ("COMPILATION",)), ("mediatype", ("MEDIATYPE",)), ("replaygain", GAINS), ("country", ("RELEASECOUNTRY",))):
        if key in keys:
            return name
    return "text"


def key_rows() -> list[tuple]:
    names: dict[str, list[str]] = {}
    for a, k in ALIASES.items():
        names.setdefault(k, []).append(a)
    return [(k, k in MULTIVALUED, k in NUMBER_PAIR, k in OWN_AUDIO, k in TRIMMABLE, category(k), ",".join(sorted(names.get(k, [])))) for k in sorted(KEYS)]


def keys_catalog(spark: SparkSession) -> DataFrame:
    """One row for each known key."""
    return spark.createDataFrame(key_rows(), "key string, multivalued boolean, number_pair boolean, own_audio boolean, trimmable boolean, category string, aliases string")


def native_rows() -> list[tuple]:
    """family, native name, key."""
    out = [("vorbis", a, k) for a, k in ALIASES.items()]
    for family, table in (("id3", ID3_FRAMES), ("id3-txxx", ID3_TXXX), ("id3-role", ID3_ROLES), ("riff", RIFF_INFO), ("aiff", AIFF_TEXT), ("mp4", MP4_TEXT), ("mp4-freeform", MP4_FREEFORM), ("matroska", MATROSKA)):
        out += [(family, n, k) for n, k in table.items()]
    return out


def native_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(native_rows(), "family string, native_name string, key string")
