"""Commands over folders: dump, plan, set, copy, lint (--fix), verify, diff, keys, caps, export-picture."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _ops(sets: list[str], clears: list[str], adds: list[str]):
    from .operators.tags import OPS

    one = lambda kind, key, values: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), (F.array(*map(F.lit, values)) if values else F.array()).cast("array<string>").alias("values"))
    from .functions.vocabulary import ALIASES

    name = lambda k: ALIASES.get(k.strip().upper(), k.strip().upper())
    ops = [one("clear", name(k), []) for k in clears]
    for kind, pairs in (("set", sets), ("add", adds)):
        for p in pairs:
            k, _, v = p.partition("=")
            ops.append(one(kind, name(k), [v]))
    return F.array(*ops).cast(OPS)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tagquarry")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("dump", "lint", "verify"):
        q = sub.add_parser(name)
        q.add_argument("folder")
        if name == "lint":
            q.add_argument("--fix", metavar="OUT", help="write files without transcoder stamps and covered legacy tags below OUT")
    q = sub.add_parser("copy", help="tags of A's files onto those of B with the same name up to the extension, written below OUT")
    for name in ("a", "b", "out"):
        q.add_argument(name)
    d = sub.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    q = sub.add_parser("plan")
    q.add_argument("folder")
    s = sub.add_parser("set")
    s.add_argument("folder")
    s.add_argument("out")
    for s, o in [(x, o) for x in (q, s) for o in ("--set", "--clear", "--add")]:
        s.add_argument(o, action="append", default=[])
    x = sub.add_parser("export-picture")
    x.add_argument("file")
    x.add_argument("out")
    x.add_argument("--which", default="")
    sub.add_parser("keys")
    sub.add_parser("caps")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from .functions.display import file_name
    from .functions.vocabulary import keys_catalog
    from .operators import lint as L
    from .operators import media as M
    from .operators import tags as T
    from .operators import transfer as R
    from .sources import edit, media

    say = lambda rows: [print("\t".join("" if v is None else str(v) for v in r)) for r in rows]

    def write(done, source: str, out: str) -> int:
        done = done.cache()
        say(edit.save(done, os.path.abspath(source), os.path.abspath(out)).toLocalIterator())
        bad = False
        for r in done.where("error IS NOT NULL").select("path", "error").toLocalIterator():
            bad = True
            print("\t".join(r))
        return 2 if bad else 0

    if a.command in ("keys", "caps"):
        say((keys_catalog(spark) if a.command == "keys" else R.capabilities(spark)).toLocalIterator())
    elif a.command == "dump":
        say(M.to_json(media.read_media(spark, a.folder)).orderBy("path").select("json").toLocalIterator())
    elif a.command == "verify":
        say(media.read_media(spark, a.folder).orderBy("path").select("essence", "path").toLocalIterator())
    elif a.command == "lint":
        m = media.read_media(spark, a.folder).where("error IS NULL")
        f = m.select("path", F.explode(L.lint(F.col("tags"), F.col("warnings"), F.col("families"), M.opaque(F.col("native")), F.col("pictures"))).alias("f")).select("path", "f.*").cache()
        say(f.orderBy("path", "code").toLocalIterator())
        if a.fix:
            fix = m.select(F.col("path").alias("_path"), L.safe_fix(F.col("tags"), F.col("families"), M.opaque(F.col("native"))).alias("fix"))
            files = media.list_files(spark, a.folder)
            files = files.join(fix.where("fix.drop_encoder OR fix.strip_legacy"), files["path"] == fix["_path"])
            return write(edit.rewrite(files, F.when(F.col("fix.drop_encoder"), _ops([], ["ENCODER"], [])).otherwise(F.array()).cast(T.OPS), strip=F.col("fix.strip_legacy")), a.folder, a.fix)
        worst = f.agg(F.max(F.when(F.col("severity") == "error", 4).when(F.col("severity") == "warning", 1).otherwise(0))).first()[0]
        return worst or 0
    elif a.command == "diff":
        left, right = (media.read_media(spark, x).withColumn("name", file_name(F.col("path"))) for x in (a.a, a.b))
        out = M.diff_media(left, right).where("presence <> 'both' OR size(changes) > 0 OR pictures OR chapters OR lyrics").select("name", "presence", F.array_join(F.transform("changes", T.change_line), "; "), "pictures", "chapters", "lyrics")
        return int(bool(say(out.toLocalIterator())))
    elif a.command == "set":
        return write(edit.rewrite(media.list_files(spark, a.folder), _ops(a.set, a.clear, a.add)), a.folder, a.out)
    elif a.command == "plan":
        old = media.read_media(spark, a.folder).where("error IS NULL").select("path", "tags")
        line = F.explode(F.transform(T.diff(F.col("tags"), T.prepare(F.col("tags"), _ops(a.set, a.clear, a.add))), T.change_line)).alias("line")
        say(old.select("path", line).orderBy("path", "line").toLocalIterator())
    elif a.command == "copy":
        stem = lambda c: F.regexp_replace(file_name(c), r"\.[^.]*$", "")
        source = media.read_media(spark, a.a).where("error IS NULL").select(stem(F.col("path")).alias("name"), F.col("path").alias("from"), F.col("tags").alias("source"))
        to = media.read_media(spark, a.b).where("error IS NULL").select(stem(F.col("path")).alias("name"), F.col("path").alias("_path"), "format", "tags")
        both = source.join(to, "name")
        grades = R.grade_fields(both.select(F.col("_path").alias("doc_id"), F.col("source").alias("tags"), "format"), F.col("format"), F.lit(False))
        how = grades.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "disposition"))).alias("how"))
        result = both.join(how, both["_path"] == how["doc_id"]).select("_path", R.transfer(F.col("source"), F.col("tags"), F.col("how")).alias("result"))
        files = media.list_files(spark, a.b)
        ops = F.transform("result", lambda t: F.struct(F.lit("set").alias("kind"), t["key"].alias("key"), t["values"].alias("values")))
        return write(edit.rewrite(files.join(result, files["path"] == result["_path"]), ops), a.b, a.out)
    elif a.command == "export-picture":
        r = media.read_media(spark, a.file).select(M.select_picture(F.col("pictures"), a.which).alias("p")).first()
        if r is None or r.p is None:
            print("no such picture, or several", file=sys.stderr)
            return 2
        with open(a.out, "wb") as f:
            f.write(bytes(r.p.data))
    return 0


if __name__ == "__main__":
    sys.exit(main())
