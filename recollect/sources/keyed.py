"""A keyed table that several jobs fill at once: each key is written once, by the first to commit.

Rows lie in folders of their own; a commit is a numbered entry of the log that names one. An entry
is created exclusively, so that of two jobs that saw the same state one comes too late: it leaves out
what the other has written meanwhile and tries the next number. Readers see committed
folders only. Jobs that are run again find their keys there and write nothing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import erase


class KeyedTable:
    """Rows of ``schema`` under ``path``, of which no two have the same ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        jvm = spark._jvm
        self._log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self._files = self._log.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._log)

    def commits(self) -> list[str]:
        """Names of committed folders in order: one small file for each populating job."""
        found = sorted(s.getPath().getName() for s in self._files.listStatus(self._log) if not s.getPath().getName().startswith("."))
        return [name.split("-", 1)[1] for name in found]

    def read(self, commits: list[str] | None = None) -> DataFrame:
        folders = self.commits() if commits is None else commits
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _claim(self, number: int, folder: str) -> bool:
        """Whether this job has made entry ``number`` of the log. The entry's name is the number alone
        until it is taken: a marker is created exclusively, by the operating system for local paths and by the
        file system otherwise (which HDFS does in one step), and the named entry follows."""
        taken = f"{self._log.toString()}/.{number:012d}"
        if self._files.getScheme() == "file":
            try:
                os.close(os.open(self._files.makeQualified(self._log).toUri().getPath() + f"/.{number:012d}", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
        else:
            try:
                self._files.create(self.spark._jvm.org.apache.hadoop.fs.Path(taken), False).close()
            except Exception as error:
                if "AlreadyExists" in str(error):
                    return False
                raise
        self._files.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._log.toString()}/{number:012d}-{folder}"), False).close()
        return True

    def upsert(self, rows: DataFrame) -> int:
        """Add the rows whose key is new, one for each key; how many they were."""
        seen = self.commits()
        fresh = rows.join(self.read(seen).select(self.key), self.key, "left_anti").dropDuplicates([self.key])
        columns = [c.strip().split()[0] for c in self.schema.split(",")]
        while True:
            folder = uuid.uuid4().hex
            path = f"{self.path}/data/{folder}"
            fresh.select(*columns).write.parquet(path)
            made = self.spark.read.schema(self.schema).parquet(path)
            n = made.count()
            if n == 0:
                erase(self.spark, path)
                return 0
            now = self.commits()
            if now == seen and self._claim(len(seen), folder):
                return n
            # Another job was first: what it wrote is left out, and only that is read again.
            seen, before = self.commits(), seen
            fresh = made.join(self.read(seen[len(before) :]).select(self.key), self.key, "left_anti") if len(seen) > len(before) else made
