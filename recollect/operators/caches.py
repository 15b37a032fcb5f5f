"""Content-addressed caches as keyed tables: joins instead of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import merkle

EXPANSIONS = 3


class FrozenMiss(LookupError):
    """A frozen cache lacks an entry."""


def json_string(text: Column, ascii_only: bool = True) -> Column:
    """A JSON string literal; other than ASCII as \\uXXXX escapes if asked for."""
    raw = F.to_json(F.struct(text.alias("v")))
    body = F.substring(raw, F.lit(6), F.length(raw) - 6)
    if not ascii_only:
        return body
    chars = F.split(body, "")

    def escaped(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10)
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        pair = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) == 8, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
        return F.when((c == "") | (code < 128), c).otherwise(pair)

    return F.when(body.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(chars, escaped), "")).otherwise(body)


def _object(fields: dict[str, Column], item: str, colon: str, ascii_only: bool) -> Column:
    parts = []
    for name in sorted(fields):
        parts.append(F.concat(F.lit(f'"{name}"{colon}'), json_string(fields[name], ascii_only)))
    return F.concat(F.lit("{"), F.concat_ws(item, *parts), F.lit("}"))


def expansion_key(query: Column, model: str, version: str) -> Column:
    """SHA-256 of compact, sorted, ASCII-escaped JSON."""
    fields = {"model": F.lit(model), "normalized_query": T.normalize_query(query), "prompt_version": F.lit(version)}
    return F.sha2(_object(fields, ",", ":", True), 256)


def response_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of sorted JSON with spaces after separators; null is the empty string."""
    return F.sha2(_object({k: F.coalesce(v, F.lit("")) for k, v in fields.items()}, ", ", ": ", False), 256)


def lookup(requests: DataFrame, cache: DataFrame, key: str, frozen: bool = False) -> DataFrame:
    """Left join on the key. A frozen cache must hold every request."""
    if frozen:
        lost = requests.join(cache.select(key), key, "left_anti").select(key).head(1)
        if lost:
            raise FrozenMiss(f"no cache entry for {lost[0][0]}")
    return requests.join(cache, key, "left")


def misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def tampered(cache: DataFrame, key: str, recomputed: Column) -> DataFrame:
    """Entries whose stored key is not the hash of what they say."""
    return cache.filter(~F.col(key).eqNullSafe(recomputed))


def populate(requests: DataFrame, cache: DataFrame, key: str, answer, path: str) -> DataFrame:
    """Append answers for the misses and return the whole cache. ``answer`` maps a
    DataFrame of missing requests to cache rows (an external batch job)."""
    answer(misses(requests, cache, key).dropDuplicates([key])).select(*cache.columns).write.mode("append").parquet(path)
    return cache.sparkSession.read.schema(cache.schema).parquet(path)


def valid_expansions(alternatives: Column, query: Column) -> Column:
    """Exactly three, not empty, unlike each other and the query after normalisation."""
    normal = F.transform(alternatives, lambda a: T.normalize_query(F.trim(a)))
    return (F.size(normal) == EXPANSIONS) & (F.size(F.array_distinct(normal)) == EXPANSIONS) & ~F.exists(
        normal,
        lambda a: a.isNull() | (a == ""),
    ) & ~F.array_contains(normal, T.normalize_query(query))


def used_digest(entries: DataFrame, name: str, content: str) -> DataFrame:
    """One SHA-256 over the entries used (digest, entries): the root of a tree over ranges of names, so that
    no task sees more than its ranges' sums."""
    return merkle.root(entries, name, content)
