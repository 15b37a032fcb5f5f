"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on seeded Gaussian directions; the projections,
shifted and cut into cells of WIDTH, form one bucket key a table. Vectors that
share a bucket are compared by cosine in double precision. The number of
projections grows with the logarithm of the number of vectors and the number of
tables follows from the recall asked for at the threshold, so that buckets stay
small at every size.

Equal vectors are one class before hashing. A bucket of more than BLOCK classes
is cut into blocks by hash, and pairs of blocks are compared in separate tasks.
A pair counts in the first table where it meets. Tasks return link counts and a
spanning forest of what they linked, not the pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components link with nothing; vectors of unlike lengths do not link; rows that repeat a
vec_id and its vector (up to its length) are one, rows of one id with unlike vectors are
compared and returned each for itself; a null vec_id links with nothing and has null
component and kept; an empty table gives no rows; columns other than the id and the
vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, cut, drop, partitions, settle

WIDTH = 2.0
BLOCK = 96
SEED = 11


def meet(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points at this distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    apart, near = meet(math.sqrt(2)), meet(math.sqrt(2 * (1 - cosine)))
    k = max(10, math.ceil(math.log(max(n, 2)) / -math.log(apart)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, dtype="<f8")
    return x / np.sqrt(x @ x)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vector (little-endian doubles; null where it links with nothing)."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = None
            if v.is_valid and len(v) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                top = np.abs(x).max()
                x = (x / top if top else x) if np.isfinite(x).all() else None
                x = None if x is None or not x.any() else x
            out.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])
    settle()


def keys_of(units: np.ndarray, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Bucket keys, one column a table."""
    rng = np.random.default_rng([seed, units.shape[1]])
    directions = rng.standard_normal((units.shape[1], k * tables))
    shifts = rng.uniform(0, WIDTH, k * tables)
    cells = np.floor((units @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(units), tables, k)
    mixed = np.full(cells.shape[:2], units.shape[1], dtype=np.uint64)
    for j in range(k):
        mixed = (mixed ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (larger, smaller id) that join what the mask of links joins."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(links)):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def _compare(rows, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link counts and forest of one pair of blocks of one bucket; rows: (side, id, weight, vector, keys of earlier tables, table)."""
    side = np.array([r[0] for r in rows])
    ids = np.array([r[1] for r in rows], dtype=np.int64)
    weight = np.array([r[2] for r in rows], dtype=np.int64)
    units = np.stack([_unit(r[3]) for r in rows])
    keys = np.stack([np.frombuffer(r[4] or b"", dtype="<i8") for r in rows])
    table = rows[0][5]
    one_block = (side == 2).all()
    a = np.arange(len(rows)) if one_block else np.flatnonzero(side == 0)
    b = a if one_block else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return {}, []
    links = units[a] @ units[b].T >= cosine
    if one_block:
        np.fill_diagonal(links, False)
    for t in range(table):
        if not links.any():
            return {}, []
        links &= keys[a, t][:, None] != keys[b, t][None, :]
    counts: dict[int, int] = {}
    for of, number in ((a, links @ weight[b]),) if one_block else ((a, links @ weight[b]), (b, links.T @ weight[a])):
        for i, n in zip(ids[of].tolist(), number.tolist()):
            if n:
                counts[i] = counts.get(i, 0) + n
    return counts, _forest(np.triu(links) if one_block else links, ids[a], ids[b])


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    n_parts = partitions(spark)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_checked, "vec_id long, vector binary")
    rows = rows.withColumn("class", F.sha2("vector", 256))
    named = rows.filter("vec_id is not null").groupBy("vec_id", "class").agg(F.first("vector").alias("vector"))
    nameless = rows.filter("vec_id is null").select("vec_id", F.lit(None).cast("string").alias("class"), F.lit(None).cast("binary").alias("vector"))
    members = cut(named.unionByName(nameless), "vectors")
    classes = members.filter("vector is not null").groupBy("class").agg(
        F.min("vec_id").alias("least"),
        F.count("*").alias("weight"),
        F.first("vector").alias("vector"),
    )
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so that numbers stay
    k, tables = plan(classes.count(), cosine, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys: list = [None] * len(raw)
            for size in {len(r) for r in raw}:
                which = [i for i, r in enumerate(raw) if len(r) == size]
                for i, own in zip(which, keys_of(np.stack([_unit(raw[i]) for i in which]), k, tables)):
                    keys[i] = own.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["id", "keys"])

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8").reshape(-1, tables)
            ids = np.repeat(batch.column(0).to_numpy(), tables)
            yield pa.RecordBatch.from_pydict({"id": ids, "t": np.tile(np.arange(tables, dtype=np.int32), len(keys)), "bucket": keys.ravel()})

    signed = cut(classes.select("id", "vector").mapInArrow(sign, "id long, keys binary"), "keys")
    spots = signed.mapInArrow(unfold, "id long, t int, bucket long")
    sizes = spots.groupBy("t", "bucket").count().filter("count > 1")
    crowded = spots.join(sizes, ["t", "bucket"])
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    crowded = crowded.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int"))
    dealt = crowded.select("id", "t", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "id", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    )
    # A row carries the keys of earlier tables only: a pair counts where it meets first.
    loaded = dealt.join(classes.select("id", "weight", "vector"), "id").join(signed, "id")
    loaded = loaded.withColumn("earlier", F.substring("keys", F.lit(1), 8 * F.col("t"))).drop("keys")
    grouped = loaded.repartition(n_parts, "t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    grouped = grouped.select("t", "bucket", "i", "j", "side", "id", "weight", "vector", "earlier")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def finish() -> None:
            if len(held) > 1:
                found, forest = _compare(held, cosine)
                for x, n in found.items():
                    counts[x] = counts.get(x, 0) + n
                edges.extend(forest)

        def out() -> pa.RecordBatch:
            made = [(x, None, n) for x, n in counts.items()] + [(u, v, None) for u, v in set(edges)]
            counts.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int64()) for c in range(3)], names=["u", "v", "n"])

        for batch in batches:
            for t, bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, bucket, i, j) != at:
                    finish()
                    held, at = [], (t, bucket, i, j)
                held.append((*row, t))
            if len(counts) + len(edges) > 50_000:
                yield out()
        finish()
        yield out()
        settle()

    found = cut(grouped.mapInArrow(work, "u long, v long, n long"), "links")
    linked = found.filter("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    linked_up = components(found.filter("v is not null").select("u", "v"))
    named_classes = classes.select("class", "id", "weight", "least").join(linked, "id", "left").join(linked_up.withColumnRenamed("node", "id"), "id", "left")
    named_classes = named_classes.withColumn("component", F.coalesce("component", "id"))
    least = named_classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named_classes = named_classes.join(least, "component").select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    result = members.select("vec_id", "class").join(named_classes, "class", "left")
    result = result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    result = cut(result.withColumn("kept", F.col("vec_id") == F.col("component_id")), "near")
    drop(members, classes, signed, found, linked_up)
    return result
