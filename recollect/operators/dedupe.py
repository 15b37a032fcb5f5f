"""Order-preserving deduplication of hits and the merging of retrieval passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(hits: DataFrame, by: str, item: str, order: list[str]) -> DataFrame:
    """Keep an item's first row within ``by`` and number what is left from 1."""
    seen = hits.withColumn("_n", F.row_number().over(W.partitionBy(by, item).orderBy(*order))).filter("_n = 1").drop("_n")
    return seen.withColumn("new_rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def best_hits(hits: DataFrame, by: str = "case_id") -> DataFrame:
    """hits: (by, page_id, rank, score, seed_id). One row a page, the smallest by
    (rank, score descending), with its contributors, numbered again."""
    picked = hits.groupBy(by, "page_id").agg(
        F.min(F.struct("rank", (-F.col("score")).alias("s"))).alias("b"), F.array_sort(
            F.collect_list(F.struct("seed_id", "rank", "score")),
        ).alias("contributors")
    )
    flat = picked.select(by, "page_id", F.col("b.rank").alias("best_rank"), (-F.col("b.s")).alias("best_score"), "contributors")
    return flat.withColumn("new_rank", F.row_number().over(W.partitionBy(by).orderBy("best_rank", F.desc("best_score"), "page_id")))


def admitted_only(hits: DataFrame, admitted: DataFrame, by: str, item: str, order: list[str]) -> DataFrame:
    """Keep admitted items; a group for which nothing was admitted keeps all."""
    some = admitted.select(by).distinct().withColumn("_some", F.lit(True))
    listed = admitted.select(by, item).distinct().withColumn("_in", F.lit(True))
    kept = hits.join(some, by, "left").join(listed, [by, item], "left").filter("_some is null or _in").drop("_some", "_in")
    return first_seen(kept, by, item, order)


def in_admitted_order(hits: DataFrame, admitted: DataFrame, by: str, item: str) -> DataFrame:
    """admitted: (by, items array). Hits follow the order in which items were admitted."""
    listed = admitted.select(by, F.posexplode("items").alias("_at", item))
    return hits.join(listed, [by, item]).withColumn("new_rank", F.row_number().over(W.partitionBy(by).orderBy("_at", "rank"))).drop("_at")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The row of the largest position for each key, without a window."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, position).alias("_r")).select("_r.*")
