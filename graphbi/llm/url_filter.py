"""URL filters: longest host/path rule, then a list of canonical URLs.

The list is probed through a blocked Bloom filter; only possible hits go to
the exact hash join that removes false positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm import bloom
from graphbi.llm.common import arrow_map, table

#: (verdict, rule): the rule's host up to the first slash, then its path. Fixed by the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A page on a host with this label is on the list of the query (advertising hosts).
LISTED_LABEL = "ads-track"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ://, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host/path without a leading www. or m., a trailing slash, /index or .html: spellings of one page."""
    h = F.regexp_replace(host, r"^(www\.|m\.)+", "")
    return F.concat(h, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null; of equally long ones the first given."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
                max_filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; ``listed`` has a column ``canonical``.

    verdict: the rule's, else block if the canonical URL is listed, else allow.
    A null or malformed url has empty host and path, fits no rule and is allowed.
    Repeated rows each get a row; null and repeated list entries change nothing.
    """
    hits = F.xxhash64("canonical")
    keys = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    words = bloom.build(keys, hits, keys.count(), max_filter_bytes)
    shared = pages.sparkSession.sparkContext.broadcast(words)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("hash", F.xxhash64("canonical"))
    kind = dict(rows.dtypes)["page_id"]

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: batch.column(n) for n in ("page_id", "host", "path", "rule", "canonical")}
            may = bloom.probe(shared.value, batch.column("hash").to_numpy(zero_copy_only=False))
            undecided = np.asarray(batch.column("rule").is_null())
            return out | {"may": (may & undecided).tolist()}
        return work

    probed = arrow_map(rows, f"page_id {kind}, host string, path string, rule string, canonical string, may boolean", start)
    # only possible hits are shuffled; all other rows pass beside the join
    exact = (probed.where("may").join(keys.withColumn("hit", F.lit(True)), "canonical", "left")
             .unionByName(probed.where(~F.col("may")).withColumn("hit", F.lit(None).cast("boolean"))))
    verdict = F.lit("allow")
    for kind_of, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(kind_of)).otherwise(verdict)
    verdict = F.when(F.col("rule").isNull() & F.col("hit"), F.lit("block")).otherwise(verdict)
    return exact.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the rules and the list of canonical URLs on advertising hosts, derived from ``pages``."""
    pages = table(spark, sf_dir, "pages")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ads = pages.where(F.concat(F.lit("."), host, F.lit(".")).contains(f".{LISTED_LABEL}."))
    return filter_urls(pages, ads.select(canonical(host, path).alias("canonical")))


_PARTS = r"""SELECT page_id, url,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages"""
SQL = rf"""WITH p AS ({_PARTS}),
c AS (SELECT page_id, host, path,
  regexp_replace(host, '^(www\.|m\.)+', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS canonical,
  CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE contains('.' || host || '.', '.{LISTED_LABEL}.'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM c"""
