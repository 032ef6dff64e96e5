"""URL filters: empirical-Bayes reputation of hosts.

A labelled page is a success or a failure: a failure if its quality is 0, or if its url names one of `BLOCKED`.
Each host's success rate is shrunk towards that of its registered domain, the domain's towards that of its
suffix, the suffix's towards that of all pages: the posterior mean of one level times the level's strength is
the beta prior of the next. The strengths are estimated from the data, level by level, by the moments of the
beta-binomial distribution. A page goes if even the upper posterior bound of its host is below the threshold.

Suffixes are those of the public suffix list (with its wildcards and exceptions) that lies in one of Spark's own
jars, and `SUFFIXES`. They are looked up once for each distinct host.

Defined results:
- a url without a host, or a null one: all such pages are one host with an empty name, domain and suffix;
- an IP address (IPv6 in its brackets), a host of one label, or one that is a suffix, is its own domain and suffix;
- a host's closing dots don't count; a label may be empty, and is then a label like others;
- a host without labelled pages has its domain's posterior mean, at the hosts' strength;
- labels: a doc_id's outcome is the least quality of its non-null rows; null ids match nothing;
- repeated pages each count, in the outcomes and in the result; a null page_id has no outcome;
- no labelled page at all: every rate is 1/2, at strength `STRENGTH`, and every page stays;
- nothing is counted in doubles, so ties and order don't matter; urls of any length are read whole;
- empty tables give empty results; further columns are left out, whatever their names.
"""

from __future__ import annotations

import os
import zipfile
from functools import lru_cache
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut

#: The list's name within Spark's jars.
LIST = "mozilla/public-suffix-list.txt"
#: Names reserved for examples, under which the tables register their hosts.
SUFFIXES = ("example.com", "example.net", "example.org")
#: Parts of a host or path that make a labelled page a failure.
BLOCKED = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
Z, THRESHOLD = 1.645, 0.5
#: Of a level that has too few nodes, or no spread, to tell.
STRENGTH = 10.0

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
_BAD = rf"(?i)[/.-]({'|'.join(BLOCKED)})([/.?#:-]|$)"


@lru_cache(maxsize=None)
def suffix_rules(jars: str | None = None) -> dict[str, str]:
    """Each rule of the public suffix list, in lower case and in both spellings, and its kind: n, w (a wildcard's base) or x (an exception)."""
    folders = [jars] if jars else [os.path.join(os.environ.get("SPARK_HOME", ""), "jars"), os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    for jar in sorted(x for f in folders for x in Path(f).glob("*httpclient*.jar")):
        with zipfile.ZipFile(jar) as z:
            if LIST in z.namelist():
                lines = z.read(LIST).decode().splitlines()
                break
    else:
        raise FileNotFoundError(f"no jar with {LIST} in {folders}")
    rules = {}
    for x in (*lines, *SUFFIXES):
        name = x.split()[0].lower() if x.strip() and not x.startswith("//") else ""
        kind, name = ("w", name[2:]) if name.startswith("*.") else ("x", name[1:]) if name.startswith("!") else ("n", name)
        # One name may have a rule of its own and be a wildcard's base.
        for spelt in {name, name.encode("idna").decode()} if name else ():
            rules[spelt] = "".join(sorted({*rules.get(spelt, ""), kind}))
    return rules


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def places(hosts: DataFrame) -> DataFrame:
    """Adds `_domain` and `_suffix` to a table of distinct hosts, `_host`."""
    rules = hosts.sparkSession.createDataFrame(sorted(suffix_rules().items()), "_rule string, _kind string")
    parts = hosts.withColumn("_p", F.split("_host", r"\.")).withColumn("_m", F.size("_p"))
    ends = parts.select("_host", "_m", F.posexplode(F.expr("transform(sequence(0, _m - 1), i -> array_join(slice(_p, i + 1, _m), '.'))")).alias("_i", "_end"))
    # Some ten thousand rules, whatever the input.
    met = ends.join(F.broadcast(rules), F.col("_end") == F.col("_rule"))
    kind = lambda k: F.col("_kind").contains(k)
    own = F.max(F.greatest(F.when(kind("n"), F.expr("_m - _i")), F.when(kind("w") & (F.col("_i") > 0), F.expr("_m - _i + 1"))))
    labels = met.groupBy(F.col("_host").alias("_h")).agg(F.coalesce(F.max(F.when(kind("x"), F.expr("_m - _i - 1"))), own).alias("_n"))
    known = parts.join(labels, F.col("_host") == F.col("_h"), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    alone = F.col("_host").rlike(r"^\[|^[0-9.]*$") | (F.col("_n") >= F.col("_m"))
    last = lambda n: F.when(alone, F.col("_host")).otherwise(F.expr(f"array_join(slice(_p, greatest(_m - ({n}) + 1, 1), _m), '.')"))
    return known.withColumns({"_domain": last("_n + 1"), "_suffix": last("_n")}).drop("_p", "_m", "_n", "_h")


def _strength(level: DataFrame, name: str) -> DataFrame:
    """One row: the level's strength, from whole numbers of millionths, which no number of labels overflows."""
    wide = lambda c: f"cast({c} AS decimal(19, 0)) * {c}"
    s = level.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum(F.expr(wide("n"))).cast("double").alias("nn"), F.sum(F.expr(f"({wide('y')} * 1000000) div n")).alias("yy"))
    s = s.select("*", F.expr("y / nullif(cast(n AS double), 0)").alias("p"))
    spread = "(yy / 1000000D - p * y - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - nn / n - (k - 1)), 0)"
    return s.selectExpr(f"coalesce(least(greatest({spread}, 0.001D), 0.999D), 1 / ({STRENGTH}D + 1)) AS rho").selectExpr(f"(1 - rho) / rho AS {name}")


def reputations(pages: DataFrame, labels: DataFrame, z: float = Z) -> DataFrame:
    """_host, labelled, good, mean, lower, upper of each host among the pages."""
    outcome = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("long").alias("_q"))
    own = pages.select("page_id", host_of(F.col("url")).alias("_host"), F.coalesce(F.col("url").rlike(_BAD), F.lit(False)).alias("_bad"))
    seen = own.join(outcome, F.col("page_id") == F.col("_id"), "left").withColumn("_q", F.when(F.col("_bad") & F.col("_q").isNotNull(), F.lit(0)).otherwise(F.col("_q")))
    hosts = cut(places(seen.groupBy("_host").agg(F.count("_q").alias("n"), F.coalesce(F.sum("_q"), F.lit(0)).alias("y"))))
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    every = suffixes.agg(F.expr("(coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2D)").alias("m0"))
    # Four single rows.
    once = every.crossJoin(_strength(suffixes, "ks")).crossJoin(_strength(domains, "kd")).crossJoin(_strength(hosts, "kh"))
    s = suffixes.crossJoin(once).selectExpr("_suffix", "kd", "kh", "(ks * m0 + y) / (ks + n) AS ms")
    d = domains.join(s, "_suffix").selectExpr("_domain", "_suffix", "kh", "(kd * ms + y) / (kd + n) AS md")
    h = hosts.join(d, ["_domain", "_suffix"]).selectExpr("_host", "_domain", "_suffix", "n AS labelled", "y AS good", "kh * md + y AS a", "kh * (1 - md) + n - y AS b")
    h = h.selectExpr("*", "a / (a + b) AS m", "sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd")
    return h.selectExpr("_host", "_domain", "_suffix", "labelled", "good", "round(m, 6) AS mean", f"round(greatest(m - {z}D * sd, 0D), 6) AS lower", f"round(least(m + {z}D * sd, 1D), 6) AS upper")


def judge_pages(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """page_id, url, host, domain, suffix, labelled, good, mean, lower, upper, keep of each page. Spark picks the join by the measured size of the hosts."""
    r = reputations(pages, labels, z).withColumnRenamed("_host", "_of").withColumnsRenamed({"_domain": "domain", "_suffix": "suffix"})
    own = pages.select("page_id", "url").withColumn("host", host_of(F.col("url")))
    out = own.join(r, F.col("host") == F.col("_of"))
    return out.select("page_id", "url", "host", "domain", "suffix", "labelled", "good", "mean", "lower", "upper", (F.col("upper") >= threshold).alias("keep"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _words(kind: str) -> str:
    return "unnest(string_split('" + " ".join(sorted(n for n, k in suffix_rules().items() if kind in k)) + "', ' '))"


_K = lambda t: f"""(SELECT (1 - rho) / rho AS k FROM (SELECT coalesce(least(greatest((yy / 1000000e0 - p * y - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - nn / n - (k - 1)), 0), 0.001e0), 0.999e0), 1 / ({STRENGTH}e0 + 1)) AS rho
  FROM (SELECT *, y / nullif(n::DOUBLE, 0) AS p FROM (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, sum(n::HUGEINT * n)::DOUBLE AS nn, sum(((y::HUGEINT * y * 1000000) // n)::BIGINT)::BIGINT AS yy FROM {t} WHERE n > 0))))"""  # noqa: E731
_ALONE = r"(regexp_matches(host, '^\[|^[0-9.]*$') OR n >= m)"
SQL = rf"""
WITH l AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
p AS (SELECT page_id, url, coalesce(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') AS host, coalesce(regexp_matches(url, '{_BAD}'), false) AS bad FROM pages),
h0 AS (SELECT host, count(q) AS n, coalesce(sum(CASE WHEN bad THEN 0 ELSE q END) FILTER (q IS NOT NULL), 0)::BIGINT AS y FROM p LEFT JOIN l ON page_id = doc_id GROUP BY 1),
parts AS (SELECT host, string_split(host, '.') AS p, len(string_split(host, '.')) AS m FROM h0),
ends AS (SELECT host, m, i, array_to_string(p[i + 1:], '.') AS e FROM (SELECT host, p, m, unnest(range(0, m)) AS i FROM parts)),
rules AS (SELECT {_words("n")} AS r, 'n' AS k UNION ALL SELECT {_words("w")}, 'w' UNION ALL SELECT {_words("x")}, 'x'),
met AS (SELECT host, coalesce(max(m - i - 1) FILTER (k = 'x'), max(CASE WHEN k = 'n' THEN m - i WHEN k = 'w' AND i > 0 THEN m - i + 1 END)) AS n FROM ends JOIN rules ON e = r GROUP BY 1),
known AS (SELECT host, p, m, coalesce(n, 1) AS n FROM parts LEFT JOIN met USING (host)),
named AS (SELECT host, CASE WHEN {_ALONE} THEN host ELSE array_to_string(p[greatest(m - n, 1):], '.') END AS domain, CASE WHEN {_ALONE} THEN host ELSE array_to_string(p[greatest(m - n + 1, 1):], '.') END AS suffix FROM known),
h AS (SELECT host, domain, suffix, n, y FROM h0 JOIN named USING (host)),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y FROM d GROUP BY 1),
g AS (SELECT (coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2e0) AS m0 FROM s),
ks AS {_K("s")}, kd AS {_K("d")}, kh AS {_K("h")},
sm AS (SELECT suffix, (ks.k * m0 + y) / (ks.k + n) AS ms FROM s, g, ks),
dm AS (SELECT d.domain, d.suffix, (kd.k * ms + y) / (kd.k + n) AS md FROM d JOIN sm USING (suffix), kd),
ab AS (SELECT h.*, kh.k * md + y AS a, kh.k * (1 - md) + n - y AS b FROM h JOIN dm USING (domain, suffix), kh),
r AS (SELECT *, a / (a + b) AS m, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd FROM ab)
SELECT p.page_id, p.url, p.host, r.domain, r.suffix, n AS labelled, y AS good, round(m, 6) AS mean, round(greatest(m - {Z}e0 * sd, 0e0), 6) AS lower, round(least(m + {Z}e0 * sd, 1e0), 6) AS upper,
  round(least(m + {Z}e0 * sd, 1e0), 6) >= {THRESHOLD} AS keep
FROM p JOIN r ON p.host = r.host
"""
