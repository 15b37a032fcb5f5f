"""URL filter: host-suffix and path-prefix expressions joined on short digests.

Every URL is split into a host and a path. Each rule is an expression
``host + path``. A URL is expanded into the expressions whose shape (labels in
the host, length of the path) occurs among the rules, the expressions meet the
rules in an equi-join on the first eight hex digits of their SHA-256, and a
match counts only if the full digests agree. The best rule is the one of the
lowest tier, then the longest, then the one with the longer host, then block
before allow.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; repeated rows each get their verdict; empty tables give empty
results; extra columns pass through, except that input columns named like an
output column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUT = ("host", "path", "rule", "verdict", "method_rule")
KEY_DIGITS = 8


def host_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule, verdict and method_rule to ``pages``.

    ``rules`` has host, path, verdict and tier (0: named in ``rule``; higher
    tiers belong to the method itself and are named in ``method_rule``). Its
    size is not limited: Spark picks the join.
    """
    keep = [c for c in pages.columns if c.lower() not in OUTPUT]
    pages = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), F.col("tier").cast("int").alias("tier")
    ).filter("r_host is not null and r_path is not null")
    # A shape is a pair of small numbers; all of them are one literal array, whatever their count.
    shapes = sorted(tuple(r) for r in rules.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect())
    rules = rules.withColumn("expr", F.concat("r_host", "r_path"))
    rules = rules.withColumn("digest", F.sha2("expr", 256)).withColumn("key", F.substring("digest", 1, KEY_DIGITS))

    # Each distinct host and path is judged once, however often it occurs.
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    listed = F.from_json(F.lit(json.dumps([{"n": n, "length": length} for n, length in shapes])), "array<struct<n:int,length:int>>")
    fits = F.filter(listed, lambda s: (F.size(labels) >= s["n"]) & (F.length("path") >= s["length"]) & (F.col("host") != ""))
    exprs = F.transform(
        fits,
        lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s["n"] + 1, s["n"]), "."), F.substring(F.col("path"), F.lit(1), s["length"])),
    )
    expanded = urls.select("host", "path", F.explode(exprs).alias("seen"))
    expanded = expanded.withColumn("seen_digest", F.sha2("seen", 256)).withColumn("key", F.substring("seen_digest", 1, KEY_DIGITS))
    hits = expanded.join(rules, "key").filter("seen_digest = digest")
    order = F.struct(
        (-F.col("tier")).alias("a"), F.length("expr").alias("b"), F.length("r_host").alias("c"), (F.col("r_verdict") == "block").alias("d"), F.col("expr").alias("e"), F.col("r_verdict").alias("f"), F.col("tier").alias("g")
    )
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(
        *keep,
        "host",
        "path",
        F.when(F.col("best.g") == 0, F.col("best.e")).alias("rule"),
        F.coalesce("best.f", F.lit(default)).alias("verdict"),
        F.when(F.col("best.g") > 0, F.col("best.e")).alias("method_rule"),
    )
