"""The page cache (S22): which links to fetch, what to keep of what came back, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import looks_blocked
from ..operators.windows import first_by

# Hosts that carry no product text
NO_TEXT_HOSTS = (
    r"(?i)^cdn[.\-]|\.googletagmanager\.com$|\.doubleclick\.net$|\.google-analytics\.com$|\.facebook\.com$|\.fbcdn\.net$|\.instagram\.com$|\.twitter\.com$|\.t\.co$|\.vk\.com$|\.mc\.yandex\.ru$|"
    r"\.yandex-team\.ru$|\.adnxs\.com$|\.criteo\.com$|\.akamaized\.net$|\.cloudfront\.net$|\.fastly\.net$|\.gstatic\.com$|\.googleapis\.com$|\.ajax\.googleapis\.com$"
)
#: Attempts for a page, and the wait before attempt n: BACKOFF * 2**(n - 1) seconds.
ATTEMPTS, BACKOFF = 3, 1.0


def page_key(url: Column) -> Column:
    return F.sha2(url, 256)


def url_host(url: Column) -> Column:
    """The host of a link, lower-cased, without scheme, path and port."""
    return F.regexp_extract(F.regexp_replace(F.lower(url), "^https?://", ""), "^([^/:]*)", 1)


def to_fetch(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, key, state, text) of the distinct links: hit with the cached text, skip for hosts without text, else miss.

    ``cache`` has (key, text).
    """
    asked = urls.select("url").where("url is not null").distinct().withColumn("key", page_key(F.col("url")))
    kept = cache.where("text <> ''").select("key", F.col("text").alias("_text"))
    joined = asked.join(kept, "key", "left")
    state = F.when(url_host(F.col("url")).rlike(NO_TEXT_HOSTS), "skip").when(F.col("_text").isNotNull(), "hit").otherwise("miss")
    return joined.select("url", "key", state.alias("state"), F.when(state == "hit", F.col("_text")).alias("text"))


def remembered(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache (key, url, text, fetched_at) after fetches (url, text, fetched_at): texts that are empty or a blocker's page are
    not kept; of a link's texts the last stays."""
    good = fetched.where("url is not null").where(~looks_blocked(F.col("text"))).select(page_key(F.col("url")).alias("key"), "url", "text", "fetched_at")
    return first_by(cache.select("key", "url", "text", "fetched_at").unionByName(good), ["key"], [F.desc("fetched_at"), F.col("text")])


def retries(fetched: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(url, attempt, wait) of links whose fetches (url, attempt, text) all failed and that have attempts left: the next
    attempt and the seconds to wait."""
    per = fetched.groupBy("url").agg(F.max("attempt").alias("_last"), F.max((~looks_blocked(F.col("text"))).cast("int")).alias("_good"))
    left = per.where((F.col("_good") == 0) & (F.col("_last") < attempts))
    return left.select("url", (F.col("_last") + 1).alias("attempt"), (F.lit(BACKOFF) * F.pow(F.lit(2.0), F.col("_last") - 1)).alias("wait"))
