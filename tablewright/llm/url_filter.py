"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join, and host rules.

The filter has a fixed number of blocks of eight 32-bit words, one bit a word and URL; one row per used block, so
the broadcast table never exceeds ``BLOCKS`` rows whatever the length of the list. A longer list means more false hits,
which the exact join with the list removes; URLs that the filter rules out take no part in that join. A URL that
very many pages share is one row on the list's side, so a skew join can split the pages' side.

Host, path and canonical form of a null URL or one without ``://`` are empty or null, and such pages are allowed
unless a rule says otherwise. Pages keep their rows, repeated ones too; an empty list blocks nothing. Columns besides id
and URL are not carried along.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 16
WORDS = 8


@dataclass(frozen=True)
class Rule:
    """Holds for a host and all below it, if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without the last ``/``, sorted parameters without trackers; null if there is no ``://``."""
    name = F.regexp_replace(host(url), "^www[.]", "")
    query = F.regexp_extract(url, "://[^?#]*[?]([^#]*)", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.rlike("^(utm_[a-z]+|ref)=") & (x != "")))
    asked = F.concat_ws("&", wanted)
    whole = F.concat(name, F.regexp_replace(path(url), "/$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(url.contains("://"), whole)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bits(url: Column) -> list[Column]:
    """The URL's bit in each word of its block."""
    bits = F.xxhash64(url, F.lit("bits"))
    places = [F.shiftrightunsigned(bits, 5 * w).bitwiseAND(31).cast("int") for w in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1), place) for place in places]


def bloom_filter(listed: DataFrame, url_col: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """(block, w0 .. w7): one row per block in use, ``blocks`` at most."""
    words = [bit.alias(f"w{w}") for w, bit in enumerate(_bits(F.col(url_col)))]
    rows = listed.where(F.col(url_col).isNotNull()).select(_block(F.col(url_col), blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))


def on_list(pages: DataFrame, listed: DataFrame, url_col: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """``pages`` with ``maybe`` (the Bloom filter's answer) and ``listed`` (the exact one)."""
    table = F.broadcast(bloom_filter(listed, url_col, blocks))  # at most ``blocks`` rows of 36 bytes
    hit = F.lit(True)
    for w, bit in enumerate(_bits(F.col(url_col))):
        hit &= F.col(f"w{w}").bitwiseAND(bit) != 0
    probed = pages.withColumn("block", _block(F.col(url_col), blocks)).join(table, "block", "left")
    probed = probed.withColumn("maybe", F.coalesce(hit & F.col(url_col).isNotNull(), F.lit(False))).drop("block", *(f"w{w}" for w in range(WORDS)))
    exact = listed.where(F.col(url_col).isNotNull()).select(url_col).distinct().withColumn("listed", F.lit(True))
    hits = probed.where("maybe").join(exact, url_col, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hits.unionByName(probed.where("NOT maybe").withColumn("listed", F.lit(False)))


def matching_rule(rules: list[Rule], host_col: Column, path_col: Column) -> Column:
    """(rule, verdict) of the longest fitting rule, or null."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host_col == rule.host) | host_col.endswith("." + rule.host)) & path_col.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict, maybe, listed): a rule's verdict, else block for listed URLs and allow for others.

    ``listed`` has the column ``canonical``; ``rules`` is a setting of a few rules.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(id_col, host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    chosen = matching_rule(rules, F.col("host"), F.col("path"))
    return on_list(rows, listed, blocks=blocks).withColumn("_chosen", chosen).select(
        id_col, "host", "path", F.col("_chosen.rule").alias("rule"),
        F.coalesce(F.col("_chosen.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "maybe", "listed",
    )
