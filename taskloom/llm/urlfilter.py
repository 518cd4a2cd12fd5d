"""URL filter by rules on host and path, in DataFrame operations only.

A rule is a host and a beginning of a path. A URL is expanded into its host suffixes (whole labels)
and into the beginnings of its path at the lengths that rules have; every pair is an expression.
Expressions meet rules in an equi-join on a short prefix of their digest, and are confirmed by the
full digest. Of the rules that fit, the longest wins; of equally long ones that with the longer
host, then a block before an allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

PREFIX_BITS = 32
#: Up to so many rules are sent to every executor (under 100 bytes each); more are joined by shuffle.
BROADCAST_RULES = 200_000

# The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, deepest: int) -> Column:
    """The host's endings of 1 to ``deepest`` labels: c, b.c, a.b.c of a.b.c."""
    n = F.regexp_count(host, F.lit(r"\.")) + 1
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(deepest))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_BITS // 4), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_limit: int = BROADCAST_RULES) -> DataFrame:
    """``urls`` (id, url) with host, path, rule (host and path, or null) and verdict.

    rules: (host, path, verdict) with lower-case hosts; verdict is allow or block. URLs that are
    null or have no ``://`` have an empty host and path, fit no rule and get ``default``. Rules with
    a null field are left out; repeated rules count once; of equally long rules for one place a block wins.
    Every row of ``urls`` stays, repeated ids and URLs included; columns other than id and url are not read,
    and an empty table stays empty. A URL of any length is expanded at the rules' path lengths, and into as
    many host endings as the deepest rule has labels. Distinct places meet the rules; a URL that very many
    rows share is one row there, and the join back splits it if it is skewed.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict")
    # of rules for the same place, a block wins
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("full", _digest(F.col("host"), F.col("path"))).withColumn("short", _short(F.col("full")))
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("n"), F.count("*").alias("c"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    pages = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths.c:
        return pages.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # the lengths that rule paths have; no more than a URL is long
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths.n]), lambda n: n <= F.length("path"))
    places = pages.select("host", "path").where("host <> ''").distinct()
    tried = places.select("host", "path", F.explode(host_suffixes(F.col("host"), lengths.labels)).alias("h"), cuts.alias("cuts"))
    tried = tried.select("host", "path", "h", F.explode("cuts").alias("n")).select("host", "path", "h", F.substring("path", F.lit(1), F.col("n")).alias("p"))
    tried = tried.withColumn("full", _digest(F.col("h"), F.col("p"))).withColumn("short", _short(F.col("full")))
    known = rules.select("short", F.col("full").alias("sure"), "verdict")
    known = F.broadcast(known) if lengths.c <= broadcast_limit else known
    size = F.length("h") + F.length("p")
    rank = F.struct(size.alias("size"), F.length("h").alias("host"), F.concat("h", "p").alias("rule"), "verdict")
    best = tried.join(known, "short").where("full = sure").groupBy("host", "path").agg(F.max(rank).alias("best"))
    # rows without a host fit no rule, and would all be one key
    a, b = pages.where("host <> ''").alias("a"), best.alias("b")
    both = a.join(b, (F.col("a.host") == F.col("b.host")) & (F.col("a.path") == F.col("b.path")), "left")
    both = both.select("a.id", "a.host", "a.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return both.unionByName(pages.where("host = ''").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op3_url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS r(host, path, verdict)")
    return judge(pages, rules).withColumnRenamed("id", "page_id")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages),
q AS (
  SELECT page_id, CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*') ELSE '' END AS raw,
    CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM p),
r AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
rules(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT r.page_id, r.host, r.path, rules.h || rules.s AS rule, v,
    row_number() OVER (PARTITION BY r.page_id, r.host, r.path ORDER BY length(h || s) DESC, length(h) DESC) AS k
  FROM r JOIN rules ON (r.host = h OR r.host LIKE '%.' || h) AND starts_with(r.path, s)),
best AS (SELECT * FROM fits WHERE k = 1)
SELECT r.page_id, r.host, r.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM r LEFT JOIN best b ON r.page_id IS NOT DISTINCT FROM b.page_id AND r.host = b.host AND r.path = b.path
"""
