"""Shared plumbing: scratch tables, bounded Bloom filters, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Largest Bloom filter that is ever broadcast (bytes). Past this the filter
#: only lets more rows through to the exact join behind it.
BLOOM_MAX_BYTES = 16 << 20
SEGMENT = 1 << 12
_open: list[list[DataFrame]] = []
#: Bytes of text that a Python worker holds in working form at a time.
SLICE_BYTES = 2 << 20
#: Nodes of a forest that a worker holds before it writes them.
FOREST = 300_000


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/recollect-{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files
    that survive any executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._recollect_path = path
    for written in _open:
        written.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables made by ``cut`` that no plan reads any more."""
    for table in tables:
        path = getattr(table, "_recollect_path", None)
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch():
    """Scratch tables written inside are deleted on leaving, but for those handed to the function that is given."""
    written: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(written)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _open.remove(written)
        paths = {t._recollect_path for t in kept}
        drop(*(t for t in written if t._recollect_path not in paths))


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it has run, not when the driver's garbage is
    collected. For steps whose lineage ends in written tables: no plan inside runs twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def tuned(spark: SparkSession) -> SparkSession:
    """Keep Arrow and Parquet batches small, so that memory stays flat with long texts and
    binary columns, and give executors this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_recollect_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="recollect-")) / "recollect_package.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(file))
    sc._recollect_shipped = True


def settle() -> None:
    """Hand a worker's freed memory back to the system at the end of a task, as the
    worker lives on for other stages. Modules are looked through once a worker, not once a task."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def free(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one, that none of the tables has as a column in any case."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unlike(keep: list[str], output: tuple[str, ...]) -> None:
    """Refuse columns that an operator would write twice."""
    clash = sorted({c.lower() for c in keep} & {c.lower() for c in output})
    if clash:
        raise ValueError(f"columns {clash} are named like output columns; rename them or leave them out")


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of rows that agree in the first ``keys`` columns."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes at most
    (one longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


# -- Bloom filters -----------------------------------------------------------


def _bits(keys: np.ndarray, size: int) -> list[np.ndarray]:
    h = keys.astype(np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        x = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        out.append(x % np.uint64(size))
    return out


def bloom_of(ids: DataFrame, column: str):
    """A broadcast Bloom filter of a long column.

    Its size follows the row count and never passes ``BLOOM_MAX_BYTES``. Tasks
    cut their own filters into segments, empty ones left out; each segment is
    merged in one task, and the driver gets every segment once.
    """
    spark = ids.sparkSession
    n = ids.count()
    size = 8 * int(min(BLOOM_MAX_BYTES, max(SEGMENT, 2 * n)) // SEGMENT * SEGMENT)

    def build(batches):
        bits = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _bits(keys, size):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        parts = bits.reshape(-1, SEGMENT)
        filled = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([parts[k].tobytes() for k in filled], pa.binary())], names=["k", "bits"])

    def merge(batches):
        for (k,), rows in runs(batches):
            own = np.zeros(SEGMENT, dtype=np.uint8)
            for (part,) in rows:
                own |= np.frombuffer(part, dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["k", "bits"])

    parts = ids.select(column).mapInArrow(build, "k long, bits binary").repartition(partitions(spark), "k").sortWithinPartitions("k")
    bits = np.zeros((size // 8 // SEGMENT, SEGMENT), dtype=np.uint8)
    for row in parts.mapInArrow(merge, "k long, bits binary").collect():  # BLOOM_MAX_BYTES at most
        bits[row.k] = np.frombuffer(row.bits, dtype=np.uint8)
    return spark.sparkContext.broadcast(bits.ravel())


def bloom_hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size = 8 * len(bits)
    hit = np.ones(len(keys), dtype=bool)
    for at in _bits(keys, size):
        hit &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


# -- connected components ----------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's pairs (u, v) those that form a spanning forest of them, so that links
    inside a component that a task sees cost one row a node from here on. Pairs of one u
    that stand together stay together."""
    parent: dict[int, int] = {}
    last = None

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        made = [(x, root(x)) for x in list(parent) if root(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int64()) for c in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if u != last and len(parent) > FOREST:
                yield out()
            last = u
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield out()
    settle()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected long pairs (u, v).

    Tasks first thin their own edges to forests. Then large-star and small-star
    steps alternate, each round written to the shared folder, until each node is
    linked with one smaller node that has none itself. A large-star step moves the
    links to nodes that have smaller neighbours, as a rule few; in a small-star step
    all smaller neighbours of a node meet in one task, which thins what it holds to a
    forest, so that no node has more rows than there are tasks and flushes of theirs.
    Returns (node, component), where component is the smallest node reachable; nodes
    without edges are absent.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    pairs = cut(pairs.mapInArrow(_forest, "u long, v long"), "cc")
    for _ in range(max_rounds):
        ends = pairs.select(F.col("u").alias("node"), "v").unionByName(pairs.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
        ends = cut(ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.isnull("v")).alias("named")), "cc")
        moving = cut(ends.filter("least <> most or least is not null and named").select("node", "least"), "moving")
        if moving.isEmpty():
            drop(pairs, moving)
            break
        large = pairs.join(moving, F.col("v") == F.col("node"), "left").select("u", F.coalesce("least", "v").alias("v"))
        small = large.repartition(partitions(spark), "u").sortWithinPartitions("u")
        after = cut(small.mapInArrow(_forest, "u long, v long"), "cc")
        drop(pairs, ends, moving)
        pairs = after
    else:
        raise RuntimeError("components did not settle")
    found = ends.select("node", F.coalesce("least", "node").alias("component"))
    found._recollect_path = ends._recollect_path
    return found
