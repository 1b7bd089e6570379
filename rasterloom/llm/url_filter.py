"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

JVM functions only. Every url is expanded into (host suffix, directory prefix) expressions; their
digests' short prefixes meet the rules' in an equi-join, the full digest confirms, and the longest
confirmed rule decides. A url is expanded only as far as some rule reaches, in labels and in directories,
so a url of very many directories is not expanded further than the longest rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import LOWER_AZ, UPPER_AZ, written

#: Host and path of a url: after the first "://" up to "/", "?", "#" or the end, then up to "?", "#" or the end.
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Leading hexadecimal digits of the digest that the join compares first.
PREFIX_DIGITS = 8
#: Rules whose table is at most this many rows may be broadcast; larger tables meet the urls in a shuffled join.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER_AZ, LOWER_AZ)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def _directory(path: Column) -> Column:
    """A path up to its last slash, that slash included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def host_suffixes(host: Column, most: int) -> Column:
    """The host's ends of up to `most` labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column, most: int) -> Column:
    """Every prefix of the path that ends in a slash, of up to `most` slashes, and the empty one."""
    parts = F.split(path, "/", most + 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of the longest fitting rule for each url.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with
    the rule's path. Longest: most characters of host, then of path; of equal ones the smaller verdict
    ("allow" before "block"). Urls that no rule fits get `default` and a null rule. Null urls and urls
    without "://" have empty host and path and fit no rule but one of empty host and path. Rows whose key
    repeats or is null are judged one by one and all returned. Urls of any length are read whole. Other columns are ignored, whatever their names.

    Returns key, host, path, rule, verdict.
    """
    base = pages.select(F.col(key).alias("u_key"), url_host(F.col(url)).alias("u_host"), url_path(F.col(url)).alias("u_path"))
    wanted = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    wanted = wanted.withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", _directory(F.col("r_path"))), 256))
    wanted = wanted.withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    slashes = F.length("r_path") - F.length(F.translate("r_path", "/", ""))
    n, labels, directories = wanted.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)), F.coalesce(F.max(slashes), F.lit(0))).first()
    if n <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    # Equal (host, directory) pairs are judged once, so a hot host is expanded once and not once a page.
    places = base.select("u_host", _directory(F.col("u_path")).alias("u_dir")).distinct()
    expressions = places.select("u_host", "u_dir", F.explode(host_suffixes(F.col("u_host"), labels)).alias("e_host")).select("u_host", "u_dir", "e_host", F.explode(path_prefixes(F.col("u_dir"), directories)).alias("e_dir"))
    expressions = expressions.withColumn("e_digest", F.sha2(F.concat_ws("\n", "e_host", "e_dir"), 256))
    found = expressions.join(wanted, F.substring("e_digest", 1, PREFIX_DIGITS) == F.col("r_prefix")).where(F.col("e_digest") == F.col("r_digest"))
    fitting = found.groupBy("u_host", "u_dir").agg(F.collect_set(F.struct((-F.length("r_host")).alias("a"), (-F.length("r_path")).alias("b"), "r_verdict", "r_host", "r_path")).alias("fits"))
    # Written, so that the join below has plain exchanges on both sides and Spark can split a hot host's pages.
    fitting = written(fitting)
    # Rules that end inside a directory's next name are settled here, against the whole path.
    judged = base.withColumn("u_dir", _directory(F.col("u_path"))).join(fitting, ["u_host", "u_dir"], "left")
    best = F.array_min(F.filter("fits", lambda r: F.startswith(F.col("u_path"), r["r_path"])))
    judged = judged.withColumn("best", best)
    return judged.select(
        F.col("u_key").alias(key),
        F.col("u_host").alias("host"),
        F.col("u_path").alias("path"),
        F.concat(F.col("best.r_host"), F.col("best.r_path")).alias("rule"),
        F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )


#: The rules that the registered query applies: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules_table(spark))


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""
