"""URL filter: a blocked Bloom filter of listed canonical URL expressions, then an exact hash join.

A list holds expressions: rules (host suffix and path prefix, like "example.net/en/") and whole
canonical URLs. Each distinct url is expanded into the few expressions that could list it. The
filter is a table of 512-bit blocks (eight longs); an expression's hash picks one block and one
bit in each long. Expressions that pass join the list exactly, so false positives go.

The filter is broadcast while its size, known from the list's count, is at most MAX_BLOCKS blocks.
The filter of a longer list is joined by block in a shuffle, with each distinct expression once. Verdicts are found once per distinct url
and joined back, so a hot url costs its rows one shuffle and nothing more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, nested, table, unnested, written

BITS_PER_KEY = 16
#: 2^17 blocks of 64 bytes are 8 MB; four million listed expressions keep 16 bits each.
MAX_BLOCKS = 1 << 17

#: The rules of the production list: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*+", 0)
    return ascii_lower(host), path


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www. or m. and a default port, then the path without slashes at its end."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", ""), F.regexp_replace(path, r"/+$", ""))


def filter_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The blocked Bloom filter of keys.key: one row (block, w0..w7) for each block that is not empty."""
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key"), i))).alias(f"w{i}") for i in range(8)]
    return keys.groupBy(_block(F.col("key"), n_blocks).alias("block")).agg(*words)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def _bit(key: Column, i: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit("bits")), 7 * i).bitwiseAND(63).cast("int")


def possible(found: DataFrame, blocks: DataFrame, n_blocks: int, *, broadcast: bool = True) -> DataFrame:
    """Rows of found whose key passes the filter, which is broadcast or else joined by block in a shuffle."""
    passes = reduce(lambda a, b: a & b, (F.call_function("bit_get", F.col(f"w{i}"), _bit(F.col("key"), i)) == 1 for i in range(8)))
    kept = found.withColumn("block", _block(F.col("key"), n_blocks)).join(F.broadcast(blocks) if broadcast else blocks.hint("shuffle_hash"), "block")
    return kept.filter(passes).select(*found.columns)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, *, url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts
    with the rule's; the longest wins (ties: the smaller text). listed: one column of canonical URLs
    to block; a url that no rule fits is blocked if its canonical form is listed, else allowed.
    Null urls and those without :// have an empty host and path, no rule, and are allowed. Repeated
    rows are kept; columns of pages that bear a result's name are replaced, all others carried along,
    whatever their names. Very long urls are judged whole; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "says", "rule")])
    rule_rows = spark.createDataFrame([(h + p, v, h + p) for v, h, p in rules], schema)
    exact = listed.select(F.concat(F.lit("="), F.col(listed.columns[0])).alias("key")).filter("key is not null").distinct().select("key", F.lit("block").alias("says"), F.lit(None).cast("string").alias("rule"))
    keys = written(rule_rows.unionByName(exact), "url-keys")  # read to be counted, filtered and joined

    urls = pages.select(F.col(url_col).alias("url")).filter(F.instr("url", "://") > 0).distinct()
    urls = urls.select("url", *(c.alias(n) for c, n in zip(host_path(F.col("url")), ("host", "path"), strict=True)))
    depths = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    candidates = [F.concat(F.substring_index("host", ".", -d), F.substring("path", 1, n)) for d in depths for n in lengths]
    candidates.append(F.concat(F.lit("="), canonical(F.col("host"), F.col("path"))))
    found = urls.select("url", F.explode(F.array_distinct(F.array(*candidates))).alias("key"))

    n_blocks = max(16, -(-keys.count() * BITS_PER_KEY // 512))
    blocks = filter_blocks(keys, n_blocks)
    if n_blocks <= max_blocks:
        found = possible(found, blocks, n_blocks)
    else:  # an expression of very many urls meets its block once
        keys = possible(found.select("key").distinct(), blocks, n_blocks, broadcast=False).join(keys, "key")
    hits = found.join(keys.hint("shuffle_hash"), "key")
    # The longest rule, then the smaller text; a whole-url entry has no rule and loses to any.
    best = hits.groupBy("url").agg(F.min(F.struct((-F.coalesce(F.length("rule"), F.lit(0))).alias("order"), "rule", "says")).alias("best"))
    verdicts = best.select("url", F.col("best.rule").alias("rule"), F.col("best.says").alias("says"))
    out = nested(pages, F.col(url_col).alias("url")).join(verdicts, "url", "left")
    host, path = host_path(F.col("url"))
    return unnested(out.withColumns({"host": host, "path": path, "verdict": F.coalesce("says", F.lit("allow"))}), pages, "host", "path", "rule", "verdict")


def shared_canonicals(pages: DataFrame, *, url_col: str = "url", least: int = 2) -> DataFrame:
    """Canonical URLs that at least `least` different raw urls resolve to: the mirrors and traps that the production list blocks."""
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(url_col)).filter(F.instr(url_col, "://") > 0).distinct()
    return urls.select(canonical(host, path).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("canonical")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES, shared_canonicals(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
  FROM (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), c AS (
  SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') AS canonical FROM p
), listed AS (
  SELECT canonical FROM (SELECT DISTINCT url, canonical FROM c WHERE instr(url, '://') > 0) GROUP BY canonical HAVING count(*) >= 2
), rules(says, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
  SELECT url, arg_min(rhost || rpath, (-length(rhost || rpath), rhost || rpath)) AS rule, arg_min(says, (-length(rhost || rpath), rhost || rpath)) AS says
  FROM (SELECT DISTINCT url, host, path FROM c) u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url
)
SELECT page_id, host, path, best.rule, coalesce(best.says, CASE WHEN listed.canonical IS NOT NULL AND instr(c.url, '://') > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON best.url = c.url LEFT JOIN listed ON listed.canonical = c.canonical
"""
