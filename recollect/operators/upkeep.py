"""A postings index kept up by differences.

An index is a list of segments that never change: of the documents that were new or changed at an update
their lengths, digests and term counts, and the ids of those that it replaces or removes. The
newest segment that names a document holds for it. An update compares the digests that rows carry
with those of the index, so that only texts of added and changed documents are read, and adds a
segment; the number of documents, their whole length and the documents of every term follow by adding and
subtracting what changed. Unchanged segments are read where they lie.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, temporary
from . import postings


def changes(before: DataFrame, after: DataFrame, key: str = "doc", digest: str = "digest", digests: bool = False) -> DataFrame:
    """(key, change), with ``digests`` also the new digest: added, changed or removed; what agrees in its digest is left out. Keys are
    unique on either side.

    Rows of ``after`` that are marked as deleted (``deleted_at``) count as absent.
    """
    now = after.filter("deleted_at is null") if "deleted_at" in after.columns else after
    old = before.select(key, F.col(digest).alias("old"), F.lit(True).alias("was"))
    both = old.join(now.select(key, F.col(digest).alias("new"), F.lit(True).alias("is")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(key, change.alias("change"), *([F.col("new").alias(digest)] if digests else [])).filter("change is not null")


class Upkeep:
    """The index under ``path``. ``key_type`` is the type of the documents' ids."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long") -> None:
        self.spark, self.path, self.key_type = spark, path.rstrip("/"), key_type
        self._log = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self._files = self._log.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._log)

    def segments(self) -> list[str]:
        """Names of the segments, oldest first: as many as there were updates since the last compaction."""
        names = sorted(s.getPath().getName() for s in self._files.listStatus(self._log) if not s.getPath().getName().startswith("."))
        return [n.split("-", 1)[1] for n in names]

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of a part of all segments, with the number of the segment (at)."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{name}").withColumn("at", F.lit(i)) for i, s in enumerate(self.segments())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, at int")

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (doc, at, ...) that no later segment replaces or removes."""
        gone = self._read("gone", f"doc {self.key_type}").groupBy(F.col("doc").alias("of")).agg(F.max("at").alias("last"))
        return rows.join(gone, rows["doc"].eqNullSafe(gone["of"]) & (gone["last"] > rows["at"]), "left_anti").drop("at")

    def documents(self) -> DataFrame:
        """(doc, len, digest)."""
        return self._live(self._read("documents", f"doc {self.key_type}, len int, digest string"))

    def counts(self) -> DataFrame:
        """(doc, term, tf, len)."""
        return self._live(self._read("counts", f"doc {self.key_type}, term string, tf int, len int"))

    def statistics(self) -> tuple[int, float]:
        """(documents, mean length), from what each update added and took away."""
        row = self._read("totals", "n bigint, length bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return row[0], row[1] / row[0] if row[0] else 0.0

    def frequencies(self) -> DataFrame:
        """(term, df), from what each update added and took away."""
        return self._read("frequencies", "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")

    def update(self, docs: DataFrame, key: str, text: str, digest: str) -> dict[str, int]:
        """Bring the index to the state of ``docs`` (deleted_at, where they have it, marks what is gone). Texts are read of
        documents whose digest is new. How many were added, changed and removed."""
        now = docs.withColumnRenamed(key, "doc").withColumnRenamed(digest, "digest")
        with temporary(self.spark):
            found = settled(changes(self.documents(), now, digests=True))
            counted = {r.change: r["count"] for r in found.groupBy("change").count().collect()}  # three rows at most
            if not counted:
                return {"added": 0, "changed": 0, "removed": 0}
            name = f"segment-{uuid.uuid4().hex}"
            path = f"{self.path}/{name}"
            fresh = found.filter("change <> 'removed'").select(F.col("doc").alias("key"))
            texts = now.filter("deleted_at is null") if "deleted_at" in now.columns else now
            texts = texts.join(fresh, texts["doc"].eqNullSafe(fresh["key"]), "left_semi").select("doc", F.col(text).alias("text"))
            tokens = settled(postings.token_rows(texts, "doc", "text"))
            # Digests meet lengths alone: lists of terms are never sorted or shuffled.
            stated = found.select("doc", F.col("digest").cast("string").alias("digest"))
            tokens.select("doc", "len").join(stated, "doc").write.parquet(f"{path}/documents")
            postings.count_rows(tokens).write.parquet(f"{path}/counts")
            gone = settled(found.filter("change <> 'added'").select("doc"))
            gone.write.parquet(f"{path}/gone")
            old = self.documents().join(gone, "doc", "left_semi")
            new = self.spark.read.parquet(f"{path}/documents").select("len", F.lit(1).alias("sign"))
            both = new.unionByName(old.select("len", F.lit(-1).alias("sign")))
            both.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum(F.col("len") * F.col("sign")), F.lit(0)).cast("bigint").alias("length")).write.parquet(f"{path}/totals")
            lost = self.counts().join(gone, "doc", "left_semi").select("term", F.lit(-1).alias("sign"))
            terms = self.spark.read.parquet(f"{path}/counts").select("term", F.lit(1).alias("sign")).unionByName(lost)
            terms.groupBy("term").agg(F.sum("sign").cast("bigint").alias("df")).filter("df <> 0").write.parquet(f"{path}/frequencies")
        # The segment counts from here on.
        self._files.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._log.toString()}/{len(self.segments()):012d}-{name}"), False).close()
        return {c: counted.get(c, 0) for c in ("added", "changed", "removed")}

    def postings(self, path: str) -> postings.Postings:
        """The searchable index of the present state, made of stored counts; no text is read."""
        n_docs, avg_len = self.statistics()
        self.counts().write.parquet(f"{path}/counts")
        postings.write_blocks(self.spark, path, n_docs, avg_len)
        return postings.read(self.spark, path)
