"""Digests of keyed tables as trees over ranges of hashed keys.

An entry falls into the range of its key's SHA-256, and a range's digest is made from the number
and the sums of its entries' digests, so that it does not depend on order or partitioning
and combines before the shuffle. Ranges of one more hexadecimal digit combine, in order, to
one range of theirs, up to the root. Two trees that differ say where: only ranges
whose digests differ have to be read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a leaf's range: 16**DEPTH leaves at most, whatever the number of entries.
DEPTH = 3


def range_of(key: Column, depth: int = DEPTH) -> Column:
    """The range that a key falls into."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, depth)


def leaves(entries: DataFrame, key: str, content: str, depth: int = DEPTH) -> DataFrame:
    """(range, n, digest) of the ranges that have entries. Equal entries count as often as they occur; a null is unlike the empty string."""

    def stated(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(text.isNull(), "-").otherwise(F.sha2(text, 256))

    own = F.sha2(F.concat(stated(key), F.lit(":"), stated(content)), 256)
    rows = entries.select(F.coalesce(range_of(F.col(key), depth), F.lit("0" * depth)).alias("range"), own.alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(p).cast("string").alias(f"s{k}") for k, p in enumerate(parts)])
    return sums.select("range", "n", F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """The ranges of one digit less: each from at most sixteen of ``nodes``, in order."""
    up = F.substring(F.col("range"), F.lit(1), F.length("range") - 1)
    listed = F.array_sort(F.collect_list(F.struct("range", "digest")))
    joined = F.array_join(F.transform(listed, lambda x: F.concat(x["range"], F.lit(":"), x["digest"])), "\n")
    return nodes.groupBy(up.alias("range")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def tree(entries: DataFrame, key: str, content: str, depth: int = DEPTH) -> DataFrame:
    """(range, n, digest) of all ranges; the root's is the empty string, absent for an empty table."""
    levels = [leaves(entries, key, content, depth)]
    for _ in range(depth):
        levels.append(parents(levels[-1]))
    return reduce(DataFrame.unionByName, levels)


def root(entries: DataFrame, key: str, content: str, depth: int = DEPTH) -> DataFrame:
    """One row: digest (of no entries: that of the empty string) and entries."""
    top = leaves(entries, key, content, depth)
    for _ in range(depth):
        top = parents(top)
    return top.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(range): leaves of two trees (of one depth) that differ, or that only one has.

    The trees are walked down: ranges under equal ones are not looked at.
    """
    depth = F.length("range")
    both = before.select("range", F.col("digest").alias("a")).join(after.select("range", F.col("digest").alias("b")), "range", "full")
    unlike = both.filter("not (a <=> b)").select("range", depth.alias("depth"))
    return unlike.filter(F.col("depth") == unlike.agg(F.max("depth")).scalar()).select("range")
