"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is

    rate = (weight / sum of weights) * (size of all sources) / (size of the source)

where a size counts characters and the weights of the sources present count.
Each document's own copy count is the Poisson quantile, at that rate, of a
uniform number hashed from the seed and its id: counts do not depend on
partitioning, order or retries. Documents are repeated that often and dealt
out by a hash of id, copy and seed.

Defined results: null sources form a source of their own; a source that the
weights do not name has weight 1; a source with no characters at all has rate
0 if no source has any; null texts count 0 characters; repeated rows are
separate documents with equal draws; an empty table gives no rows; other columns pass
through under any name, except that input columns named copy, n_copies or mix_key are
replaced. A source may be as small as a character beside all others: a rate above
CHUNK * PIECE is drawn in chunks of CHUNK pieces, each a row of its own, dealt
over all tasks, and no row holds an array of more than a chunk's copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import cut, free, partitions

OUTPUT = ("copy", "n_copies", "mix_key")
#: Largest rate inverted in one piece; a larger rate is a sum of independent draws at most this large.
PIECE = 16.0
#: Most pieces that one row draws.
CHUNK = 1024


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def quantile(rate: Column, u: Column) -> Column:
    """Smallest k with P(X <= k) > u for X ~ Poisson(rate), rate <= PIECE.

    The cumulative sum stops growing long before the last term taken, so that
    u below 1 always finds its k.
    """
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda s, i: F.when(s["cdf"] > u, s).otherwise(
            F.struct((s["p"] * rate / i).alias("p"), (s["cdf"] + s["p"] * rate / i).alias("cdf"), (s["k"] + F.lit(1)).alias("k"))
        ),
    )
    return step["k"]


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate) for every source present. One row a source, summed before any shuffle."""
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("size"))
    if weights:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(F.try_element_at(named, F.coalesce("mix_source", F.lit(""))), F.lit(float(default)))
    else:
        weight = F.lit(float(default))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).withColumn("one", F.lit(1))
    rate = F.when(F.col("size") > 0, F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(F.lit(0.0))
    return sizes.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("mix_source", rate.alias("mix_rate"))  # total is one row


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    seed: int = 17,
    default: float = 1.0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Repeat documents to the target weights and deal the copies out globally.

    Returns the columns of ``docs`` with copy (from 0), n_copies and mix_key;
    rows are hash-partitioned and sorted by mix_key.
    """
    keep = [c for c in docs.columns if c.lower() not in OUTPUT]
    docs = docs.select(*keep)
    # Written first, so that Spark knows its size when it plans the join: broadcast while
    # small, else a shuffled join whose hot sources adaptive execution splits.
    of, mean_rate = free("mix_source", docs), free("mix_rate", docs)
    mean = cut(rates(docs, weights, default, source, text), "rates").toDF(of, mean_rate)
    drawn = docs.join(mean, F.col(source).eqNullSafe(F.col(of)), "left")
    rate = F.coalesce(mean_rate, F.lit(0.0))
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    few = F.col(mean_rate) <= CHUNK * PIECE
    small = drawn.filter(F.coalesce(few, F.lit(True)))
    count = drawn_count(rate, ident, seed, F.lit(0), F.floor(rate / PIECE).cast("bigint"))
    rows = small.select(*keep, F.lit(0).cast("bigint").alias("first"), count.alias("here"), count.alias("n_copies"))
    if not mean.filter(~few).isEmpty():
        rows = rows.unionByName(_in_chunks(drawn.filter(~few), keep, mean_rate, ident, seed))
    copies = rows.filter("here > 0").select(*keep, "n_copies", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("here") - 1)).alias("copy"))
    copies = copies.select(*keep, "copy", "n_copies")
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"deal-{seed}"), ident, F.col("copy").cast("string"))))
    return copies.repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


def drawn_count(rate: Column, ident: Column, seed: int, first: Column, pieces: Column) -> Column:
    """Copies of a document from ``pieces`` full pieces behind ``first`` of them, and from the part of a piece (number 0) where first is 0."""

    def draw(of: Column, i: Column) -> Column:
        return quantile(of, uniform(F.lit(f"draw-{seed}"), ident, i.cast("string"))).cast("bigint")

    numbers = F.when(pieces > 0, F.sequence(first + 1, first + pieces)).otherwise(F.array().cast("array<bigint>"))
    full = F.aggregate(F.transform(numbers, lambda i: draw(F.lit(PIECE), i)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    part = draw(rate - F.floor(rate / PIECE).cast("double") * F.lit(PIECE), F.lit(0))
    return full + F.when(first == 0, part).otherwise(F.lit(0).cast("bigint"))


def _in_chunks(drawn: DataFrame, keep: list[str], mean_rate: str, ident: Column, seed: int) -> DataFrame:
    """keep, first, here and n_copies of rows with a high rate, a row a chunk of pieces.

    Rows of one id and rate draw the same, so that counts are drawn once for each: chunks are dealt over
    all tasks, and each learns the copies before it and in all from the others' counts.
    """
    n = partitions(drawn.sparkSession)
    id_, rate_ = free("ident", drawn), free("rate", drawn)
    one = drawn.select(ident.alias("i"), F.col(mean_rate).alias("r")).distinct()
    whole = F.floor(F.col("r") / PIECE).cast("bigint")
    cut_ = one.select("i", "r", whole.alias("whole"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / CHUNK).cast("bigint"))).alias("c"))
    dealt = cut_.repartition(n, "i", "c")
    own = drawn_count(F.col("r"), F.col("i"), seed, F.col("c") * CHUNK, F.least(F.col("whole") - F.col("c") * CHUNK, F.lit(CHUNK).cast("bigint")))
    counted = cut(dealt.select("i", "r", "c", own.alias("here")), "chunks")
    by = W.partitionBy("i", "r").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.select("i", "r", "here", F.coalesce(F.sum("here").over(by), F.lit(0)).alias("first"))
    total = counted.groupBy("i", "r").agg(F.sum("here").alias("n_copies"))
    placed = placed.join(total, ["i", "r"]).withColumnRenamed("i", id_).withColumnRenamed("r", rate_)
    met = drawn.join(placed, (ident == F.col(id_)) & (F.col(mean_rate) == F.col(rate_)))
    # Dealt again, so that the chunks of one document are unpacked by many tasks.
    return met.select(*keep, "first", "here", "n_copies").repartition(n, F.col("first"), F.xxhash64(ident))
