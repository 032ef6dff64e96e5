"""Transfers: what of a source's tags, pictures, chapters and lyrics a destination format can hold.

Capabilities are a small dimension table (formats x dimensions); grading is an ordered CASE over a join with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import integer
from ..functions.vocabulary import NUMBER_PAIR, OWN_AUDIO
from . import tags as T
from .chapters import loses_metadata

#: format, dimension, write (full, partial, none), max_items (0: no bound), loss, mimes.
CAPABILITIES = [
    *((f, "fields", "full", 0, "", "") for f in ("FLAC", "Ogg Vorbis", "Opus", "MP3", "AAC", "WAV", "AIFF", "MP4", "Matroska", "WebM")),
    *((f, "chapters", "partial", m, loss, "") for f, m, loss in (("FLAC", 0, "start-title"), ("Ogg Vorbis", 0, "start-title"), ("Opus", 0, "start-title"), ("MP3", 255, "flags"), ("AAC", 255, "flags"), ("WAV", 255, "flags"), ("AIFF", 255, "flags"), ("MP4", 255, "start-title"))),
    *((f, "chapters", "full", 0, "none", "") for f in ("Matroska", "WebM")),
    *((f, "pictures", "full", 0, "", "") for f in ("FLAC", "Ogg Vorbis", "Opus", "MP3", "AAC", "WAV", "AIFF")),
    ("MP4", "pictures", "partial", 0, "role", "image/jpeg,image/png,image/bmp"), ("Matroska", "pictures", "partial", 0, "role", "image/"), ("WebM", "pictures", "none", 0, "", ""),
    *((f, "lyrics", "partial", 1, "language", "") for f in ("FLAC", "Ogg Vorbis", "Opus")),
    *((f, "lyrics", "full", 0, "", "") for f in ("MP3", "AAC", "WAV", "AIFF")),
    *((f, "lyrics", "none", 0, "", "") for f in ("MP4", "Matroska", "WebM")),
    *((f, "padding", w, 0, "", "") for f, w in (("FLAC", "full"), ("Ogg Vorbis", "none"), ("Opus", "none"), ("MP3", "partial"), ("AAC", "partial"), ("WAV", "none"), ("AIFF", "none"), ("MP4", "partial"), ("Matroska", "none"), ("WebM", "none"))),
]
EXTENSIONS = {"FLAC": "flac", "Ogg Vorbis": "ogg,oga", "Opus": "opus", "MP3": "mp3", "AAC": "aac", "WAV": "wav,wave", "AIFF": "aiff,aif,aifc", "MP4": "m4a,m4b,mp4", "Matroska": "mka,mkv", "WebM": "webm"}
ID3_BASED = ("MP3", "AAC", "WAV", "AIFF")
VORBIS_BASED = ("FLAC", "Ogg Vorbis", "Opus")


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "format string, dimension string, write string, max_items int, loss string, mimes string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(EXTENSIONS.items()), "format string, extensions string")


def dispose(write: Column, read_only: Column, count: Column, max_items: Column, drops: Column, reduces: Column | None, classifier: Column | None = None) -> Column:
    """dropped, lossy or carried, by the first rule that holds: read-only, none, too many items, a value dropped, a value reduced (which decides), partial, carried. A classifier may lower carried only."""
    carried = classifier if classifier is not None else F.lit("carried")
    out = F.when(read_only | (write == "none") | ((max_items > 0) & (count > max_items)) | drops, "dropped")
    if reduces is not None:
        out = out.when(reduces.isNotNull(), F.when(reduces, "lossy").otherwise(carried))
    return out.when(write == "partial", "lossy").otherwise(carried)


def field_classifier(format_: Column, key: Column, values: Column, tags: Column) -> Column:
    """What the formats do to single fields beyond the table: ID3 drops a total without a number, Vorbis drops names of its own use, Matroska keeps one title."""
    number = F.when(key == "TRACKTOTAL", T.first(tags, "TRACKNUMBER")).when(key == "DISCTOTAL", T.first(tags, "DISCNUMBER"))
    bad_total = key.isin("TRACKTOTAL", "DISCTOTAL") & number.isNotNull() & integer(number).isNull()
    reserved = key.rlike(r"^CHAPTER[0-9]{3}(NAME|URL)?$") | key.isin("SYNCEDLYRICS", "METADATA_BLOCK_PICTURE", "COVERART")
    return (
        F.when(format_.isin(*ID3_BASED) & bad_total, "dropped").when(format_.isin(*VORBIS_BASED) & reserved, "dropped")
        .when(format_.isin("Matroska", "WebM") & (key == "TITLE") & (F.size(values) > 1), "lossy").otherwise("carried")
    )


def numeric_drop(format_: Column, key: Column, values: Column) -> Column:
    """MP4 keeps number pairs, media type and compilation as numbers: values without one are dropped."""
    loses = F.forall(values, lambda v: integer(v).isNull())
    return (format_ == "MP4") & key.isin(*NUMBER_PAIR, "MEDIATYPE") & loses


def grade_fields(df: DataFrame, to: Column, read_only: Column | None = None, doc: str = "doc_id", tags: str = "tags") -> DataFrame:
    """doc, format, key, n_values, disposition for each field of each document."""
    caps = capabilities(df.sparkSession).where("dimension = 'fields'").select(F.col("format").alias("_f"), "write", "max_items")
    rows = df.select(F.col(doc).alias("doc_id"), to.alias("format"), (read_only if read_only is not None else F.lit(False)).alias("_ro"), F.col(tags).alias("_tags"))
    # The capability table has ten rows.
    rows = rows.join(F.broadcast(caps), F.col("format") == F.col("_f"), "left").select("*", F.explode("_tags").alias("t"))
    key, vals = F.col("t.key"), F.col("t.values")
    d = dispose(F.coalesce("write", F.lit("none")), F.col("_ro"), F.lit(1), F.coalesce("max_items", F.lit(0)), numeric_drop(F.col("format"), key, vals), None, field_classifier(F.col("format"), key, vals, F.col("_tags")))
    return rows.select("doc_id", "format", key.alias("key"), F.size(vals).alias("n_values"), F.when(key.isin(*OWN_AUDIO), "excluded").otherwise(d).alias("disposition"))


def tally(graded: DataFrame, by: list[str]) -> DataFrame:
    """carried, lossy, dropped and lossless by group; excluded items don't count."""
    n = lambda d: F.count(F.when(F.col("disposition") == d, 1)).alias(d)
    return graded.groupBy(by).agg(n("carried"), n("lossy"), n("dropped")).withColumn("lossless", (F.col("lossy") + F.col("dropped")) == 0)


def transfer(source: Column, destination: Column, dispositions: Column) -> Column:
    """The destination's tags afterwards: source keys that are carried or lossy replace, dropped and excluded ones don't. dispositions: map key -> disposition."""
    # Each is bound once: a lambda's body would make the map and the list anew for every entry.
    kept = lambda d: F.filter(source, lambda t: F.try_element_at(d, t["key"]).isin("carried", "lossy"))
    replaced = lambda ks: F.transform(destination, lambda t: F.when(T.has(ks, t["key"]), F.get(ks, F.array_position(ks["key"], t["key"]) - 1)).otherwise(t))
    outcome = lambda x: F.concat(replaced(x["kept"]), F.filter(x["kept"], lambda k: ~F.array_contains(x["own"], k["key"])))
    return T.let(dispositions, lambda d: T.let(F.struct(kept(d).alias("kept"), T.keys(destination).alias("own")), outcome))


def partition_pictures(pics: Column, mimes: Column) -> tuple[Column, Column]:
    """Pictures whose MIME the format takes, and the others. mimes: a list by commas; an entry that ends in a slash takes all below it; empty takes all."""
    ok = lambda p: (mimes == "") | F.exists(F.split(mimes, ","), lambda m: F.when(F.endswith(m, F.lit("/")), F.startswith(p["mime"], m)).otherwise(p["mime"] == m))
    return F.filter(pics, ok), F.filter(pics, lambda p: ~ok(p))


def split_set(write: Column, max_items: Column, items: Column, drops: Column, loses: Column) -> Column:
    """carried, lossy, dropped of a set of items. A set that can't be written, or is beyond the bound, is dropped whole. drops, loses: a boolean for each item."""
    n = F.size(items)
    count = lambda flags: F.size(F.filter(flags, lambda x: x))
    out, less = count(drops), count(F.zip_with(drops, loses, lambda d, x: ~d & x))
    counts = lambda c, x, d: F.struct(c.cast("long").alias("carried"), x.cast("long").alias("lossy"), d.cast("long").alias("dropped"))
    return F.when((write == "none") | ((max_items > 0) & (n > max_items)), counts(F.lit(0), F.lit(0), n)).otherwise(counts(n - out - less, less, out))


def grade_sets(df: DataFrame, to: Column, doc: str = "doc_id") -> DataFrame:
    """doc, format, dimension, carried, lossy, dropped for the pictures, chapters and lyrics that df has as columns."""
    per = F.map_from_entries(F.collect_list(F.struct("dimension", F.struct("write", "max_items", "loss", "mimes"))))
    # A row for each of the ten formats.
    caps = capabilities(df.sparkSession).groupBy(F.col("format").alias("_f")).agg(per.alias("_caps"))
    rows = df.withColumn("_to", to).join(F.broadcast(caps), F.col("_to") == F.col("_f"))
    cap = lambda d: F.try_element_at(F.col("_caps"), F.lit(d))
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    never = lambda items: F.transform(items, lambda x: F.lit(False))
    out = []
    if "pictures" in df.columns:
        c, pics = cap("pictures"), F.col("pictures")
        fits = lambda p: (c["mimes"] == "") | F.exists(F.split(c["mimes"], ","), lambda m: F.when(F.endswith(m, F.lit("/")), F.startswith(p["mime"], m)).otherwise(p["mime"] == m))
        out.append(("pictures", split_set(c["write"], c["max_items"], pics, F.transform(pics, lambda p: ~fits(p)), F.transform(pics, lambda p: (c["loss"] == "role") & (~p["type"].isin(0, 3) | text(p["description"]))))))
    if "chapters" in df.columns:
        c, ch = cap("chapters"), F.col("chapters")
        loses = F.when(c["loss"] == "flags", loses_metadata(ch, "flags")).when(c["loss"] == "start-title", loses_metadata(ch, "start-title")).otherwise(never(ch))
        out.append(("chapters", split_set(c["write"], c["max_items"], ch, never(ch), loses)))
    if "synced_lyrics" in df.columns:
        c, ly = cap("lyrics"), F.col("synced_lyrics")
        out.append(("lyrics", split_set(c["write"], c["max_items"], ly, never(ly), F.transform(ly, lambda x: (c["loss"] == "language") & (text(x["language"]) | text(x["description"]))))))
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), x.alias("n")) for d, x in out))
    return rows.select(doc, F.col("_to").alias("format"), F.explode(each).alias("e")).select(doc, "format", "e.dimension", "e.n.*")
