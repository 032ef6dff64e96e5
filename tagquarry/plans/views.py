"""Tag views over the driver's tables, in one text for two SQL dialects.

None of the tables holds audio, so the operators run over views that give each order, part or document a tag
multimap. `spark()` gives the Spark expression, `duck()` the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: key, condition, values; both dialects read these expressions alike.
ORDERS = [
    ("RECORDINGDATE", "true", ["CASE WHEN o_orderkey % 97 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 4) || '-13' WHEN o_orderkey % 3 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 4) WHEN o_orderkey % 3 = 1 THEN substr(CAST(o_orderdate AS STRING), 1, 7) ELSE ' ' || substr(CAST(o_orderdate AS STRING), 1, 10) END"]),
    ("COMMENT", "o_orderkey % 5 <> 0", ["o_orderpriority", "lower(o_orderpriority)", "'  ' || o_orderstatus || ' '"]),
    ("COMPILATION", "true", ["CASE o_orderstatus WHEN 'O' THEN 'Yes' WHEN 'F' THEN '0' ELSE 'perhaps' END"]),
    ("TRACKNUMBER", "o_orderkey % 7 <> 0", ["CASE WHEN o_orderkey % 2 = 0 THEN '0' || CAST(o_orderkey % 30 AS STRING) || '/' || CAST(o_orderkey % 40 AS STRING) WHEN o_orderkey % 29 = 0 THEN 'x/3' WHEN o_orderkey % 31 = 0 THEN '/12' ELSE CAST(o_orderkey % 30 - 2 AS STRING) END"]),
    ("TRACKTOTAL", "o_orderkey % 6 = 0", ["CAST(o_orderkey % 40 AS STRING)"]),
    ("DISCNUMBER", "o_orderkey % 4 = 0", ["' 1 '"]),
    ("PLAYCOUNT", "o_orderkey % 3 = 0", ["CAST(o_custkey % 50 - 5 AS STRING)"]),
    ("REPLAYGAIN_TRACK_GAIN", "o_orderkey % 4 = 1", ["CAST(o_orderkey % 20 - 10 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) || ' dB'"]),
    ("REPLAYGAIN_TRACK_PEAK", "o_orderkey % 8 = 1", ["CASE WHEN o_orderkey % 16 = 1 THEN '-0.5' ELSE '0.98' END"]),
    ("RELEASECOUNTRY", "o_orderkey % 9 < 4", ["substr(o_orderpriority, 1 + CAST(o_orderkey % 4 AS INT), 2)"]),
    ("MEDIATYPE", "o_orderkey % 10 = 3", ["CAST(o_custkey % 300 AS STRING)"]),
    ("ENCODER", "o_orderkey % 11 = 0", ["'Lavf58.1'", "CASE WHEN o_orderkey % 22 = 0 THEN ' lavf58.1' ELSE 'Other' END"]),
    ("TITLE", "true", ["'Order ' || CAST(o_orderkey AS STRING)"]),
    ("GENRE", "o_orderkey % 17 = 0", []),
    ("X-CLERK", "o_orderkey % 13 = 0", ["CAST(o_custkey AS STRING)", "'clerk'"]),
]
#: The same documents as another collection has them: keys changed, dropped and added.
ORDERS_B = [
    ("TITLE", "o_orderkey % 19 <> 0", ["'Order ' || CAST(o_orderkey AS STRING)"]),
    ("COMMENT", "o_orderkey % 3 <> 0", ["' ' || lower(o_orderpriority)", "'new'", "o_orderstatus"]),
    ("TRACKNUMBER", "true", ["CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 30 AS STRING) || '/' || CAST(o_orderkey % 40 AS STRING) ELSE '+' || CAST(abs(o_orderkey % 30 - 2) AS STRING) END"]),
    ("COMPILATION", "o_orderkey % 2 = 0", ["CASE o_orderstatus WHEN 'O' THEN 'Yes' ELSE '1' END"]),
    ("GENRE", "o_orderkey % 4 = 0", ["'Rock'", "'rock '"]),
    ("MEDIATYPE", "o_orderkey % 10 = 3", ["'0' || CAST(o_custkey % 300 AS STRING)"]),
    ("ENCODER", "o_orderkey % 11 = 0", ["'B'"]),
    ("LABEL", "o_orderkey % 23 = 0", ["''", "'  '"]),
    ("ARTIST", "true", ["'Customer ' || CAST(o_custkey AS STRING)"]),
]


def spark(view: list) -> str:
    one = lambda k, c, v: f"CASE WHEN {c} THEN named_struct('key', '{k}', 'values', cast(array({', '.join(v)}) AS array<string>)) END"
    return f"array_compact(array({', '.join(one(*x) for x in view)}))"


def duck(view: list) -> str:
    one = lambda k, c, v: f"CASE WHEN {c} THEN {{'key': '{k}', 'values': [{', '.join(v)}]::VARCHAR[]}} END"
    return f"list_filter([{', '.join(one(*x) for x in view)}], lambda x: x IS NOT NULL)"


#: Rows that one task takes of a table that is dealt out.
ROWS_A_TASK = 25_000


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out by the hash of their columns, at least one task a core and at most about ROWS_A_TASK rows a task. A scan's own partitions follow its row groups, so one large row group would be one task however many splits its file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_A_TASK)), *df.columns)


def orders_tags(s: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tags, tags_b."""
    return spread(s.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")).select(F.col("o_orderkey").alias("doc_id"), F.expr(spark(ORDERS)).alias("tags"), F.expr(spark(ORDERS_B)).alias("tags_b"))


#: The long relation in DuckDB: a (doc_id, tags, tags_b), k (a row a key) and v (a row a value) of tags; kb and vb of tags_b.
DUCK = f"""a AS (SELECT o_orderkey AS doc_id, {duck(ORDERS)} AS tags, {duck(ORDERS_B)} AS tags_b FROM orders),
k AS (SELECT doc_id, t.key AS key, t."values" AS vals, pos FROM (SELECT doc_id, unnest(tags) AS t, generate_subscripts(tags, 1) AS pos FROM a)),
v AS (SELECT doc_id, key, pos, unnest(vals) AS v, generate_subscripts(vals, 1) AS vpos FROM k),
kb AS (SELECT doc_id, t.key AS key, t."values" AS vals, pos FROM (SELECT doc_id, unnest(tags_b) AS t, generate_subscripts(tags_b, 1) AS pos FROM a)),
vb AS (SELECT doc_id, key, pos, unnest(vals) AS v, generate_subscripts(vals, 1) AS vpos FROM kb)"""


def contributions(s: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, key, value, source, scope: each line item of an order as what a native field says of it."""
    li = s.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"), F.expr(CONTRIBUTION_KEY).alias("key"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE lower(l_returnflag) || ' ' END").alias("value"), F.col("l_linestatus").alias("source"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'album' ELSE 'track' END").alias("scope"),
    )


CONTRIBUTION_KEY = "CASE WHEN l_partkey % 3 = 0 THEN 'ARTIST' WHEN l_partkey % 3 = 1 THEN 'DISCNUMBER' ELSE 'TITLE' END"
DUCK_CONTRIBUTIONS = f"c AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS pos, {CONTRIBUTION_KEY} AS key, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE lower(l_returnflag) || ' ' END AS value, l_linestatus AS source, CASE WHEN l_suppkey % 2 = 0 THEN 'album' ELSE 'track' END AS scope FROM lineitem)"


def event_chapters(s: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the user), pos, start_ns, end_ns, title, is_new: a user's events as chapters, whole days since the user's first, in order of time and id; every third has an end."""
    e = s.read.parquet(f"{sf_dir}/events.parquet")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', cast(ts AS timestamp_ntz))")
    e = e.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("s", F.floor((at - F.min(at).over(w)) / 86400) * F.lit(86_400_000_000_000)).withColumn("pos", F.row_number().over(w.orderBy(at, "event_id")).cast("long"))
    return e.select(F.col("user_id").alias("doc_id"), "pos", F.col("s").alias("start_ns"), F.expr("CASE WHEN event_id % 3 = 0 THEN s + (event_id % 100000) * 1000000000 ELSE 0L END").alias("end_ns"), F.col("event_type").alias("title"), F.expr("event_id % 2 = 0").alias("is_new"))


DUCK_CHAPTERS = """e AS (SELECT event_id, user_id AS doc_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS title FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t, event_id) AS pos, (t - min(t) OVER (PARTITION BY doc_id)) // 86400 * 86400000000000 AS start_ns, title, event_id,
  CASE WHEN event_id % 3 = 0 THEN (t - min(t) OVER (PARTITION BY doc_id)) // 86400 * 86400000000000 + (event_id % 100000) * 1000000000 ELSE 0 END AS end_ns, event_id % 2 = 0 AS is_new FROM e)"""


def chapter_arrays(s: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chapters."""
    c = F.struct("pos", "start_ns", "end_ns", "title", F.lit("").alias("language"), F.expr("pos % 5 = 0").alias("hidden"), F.lit(False).alias("disabled"))
    return event_chapters(s, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(c)).alias("chapters"))


def silent_flac() -> bytes:
    """The smallest FLAC file that is taken as one: stream info, no comments, one stand-in for a frame."""
    info = bytes.fromhex("10001000000000000000") + (44100 << 44 | 1 << 41 | 15 << 36 | 44100).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\0\0\x22" + info + b"\xff\xf8frame"
