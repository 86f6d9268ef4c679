"""URL filter: rules first, then a list of blocked canonical URLs.

A blocked Bloom filter of the listed URLs is asked about each page; only possible hits go into the
exact join with the list, which removes the filter's false positives. The other pages pass without
a shuffle. Hosts and paths come from built-in functions, so nothing here runs Python.

Defined cases: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
lower case; path is what follows up to ``?``, ``#`` or the end. A null url or one without ``://``
has an empty host and path, fits no rule, is not listed and is allowed. Repeated pages stay
separate rows; an empty list allows everything the rules do not block. Columns of the pages named host,
path, rule or verdict, or one of __rest, __host, __action, __key, __possible, are replaced; others stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm import bloom
from caselake.session import materialize

# The rules, action and host with path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; columns of that name are replaced."""
    rest = F.coalesce(_after_scheme(url_col), F.lit(""))
    out = pages.withColumn("__rest", rest).withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(
        F.substr(F.col("__rest"), F.length("__host") + 1, F.length("__rest")), r"^[^?#]*", 0))
    return out.withColumn("host", F.translate("__host", UPPER, LOWER)).drop("__rest", "__host")


def canonical(url: str) -> Column:
    """Canonical form of a url with parts: host without "www." and port, path without closing
    slashes, query without the parameters that only track (``utm_...``) and none if nothing is left of it; no scheme
    and no fragment. Null without a host."""
    host = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r":[0-9]*$", "")
    query = F.regexp_extract(F.col(url), r"^[^#?]*\?([^#]*)", 1)
    others = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_")), "&")
    query = F.when(query.rlike("(^|&)utm_"), others).otherwise(query)
    return F.when(F.col("host") != "", F.concat(host, F.regexp_replace("path", r"/+$", ""),
                                                F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and action of the longest rule that fits; null where none does. Of two equal rules the
    first counts."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(
            F.col("path"), F.lit(slash + path))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None,
          bits_per_key: int = 16) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``listed`` has a column ``canonical_url``."""
    rule, action = rule_of(RULES if rules is None else rules)
    keys = materialize(listed.filter("canonical_url is not null").select(
        F.sha2("canonical_url", 256).alias("__key")).distinct(), "op5-list")
    n_blocks = bloom.blocks_for(keys.count(), bits_per_key)
    built = materialize(bloom.build(keys, "__key", n_blocks), "op5-filter")
    judged = with_parts(pages, url_col).withColumns({"rule": rule, "__action": action})
    judged = judged.withColumn("__key", F.when(F.col("__action").isNull(), F.sha2(canonical(url_col), 256)))
    asked = bloom.ask(judged, "__key", n_blocks, built, "__possible")
    passed = asked.filter("not __possible").withColumn("verdict", F.coalesce("__action", F.lit("allow")))
    checked = asked.filter("__possible").join(keys.withColumn("__listed", F.lit(True)), "__key", "left").withColumn(
        "verdict", F.when(F.col("__listed"), "block").otherwise("allow")).drop("__listed")
    return passed.unionByName(checked).drop("__action", "__key", "__possible")


def pages_to_list(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """A list made from the pages: canonical URLs of hosts with one of the words as a label's part."""
    return with_parts(pages, url_col).filter(F.col("host").rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")).select(
        canonical(url_col).alias("canonical_url"))
