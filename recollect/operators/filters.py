"""Bounded filters of keys, tested where rows are made: what is no key never reaches a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest filter (bits): 4 MiB. Past this it lets more rows through to the exact join behind it.
MOST_BITS = 1 << 25
#: Bits for each key, up to MOST_BITS.
BITS = 16


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for every long of the one column of ``keys`` and for few others.

    The filter is an array of 64-bit words of BITS bits a key (MOST_BITS at most), made by one small
    query; the test reads a word of the hashed number. A null passes no filter.
    """
    name = keys.columns[0]
    n = keys.count()
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), key), F.lit(bits))

    set_ = keys.filter(F.col(name).isNotNull()).select(place(F.col(name)).alias("bit"))
    words = set_.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("word"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "at").join(words, "at", "left")
    row = F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))))
    held = every.agg(F.transform(row, lambda x: x["word"]).alias("words")).scalar()

    def test(key: Column) -> Column:
        bit = place(key)
        return key.isNotNull() & (F.getbit(F.get(held, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1)

    return test
