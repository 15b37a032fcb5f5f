"""Centroid clustering (Lloyd's rounds) in exact whole numbers.

Components become floor(SCALE * x). A block of vectors meets all centroids in one
matrix product of doubles, |x|^2 - 2 x.c + |c|^2. Where no component of either passes a
bound, every number on the way stays below 2^53, so that the product is exact
whatever the order of its sums; vectors and centroids beyond it are compared in
64-bit or Python integers. Sums by cluster are a second product of the block, exact under
the same bound, and treeAggregate adds them over all blocks in Python integers: what
reaches the driver is one sum a centroid, whatever the number of vectors.

Defined results: vectors of another size, null ones and those with null or non-finite components
are left out; repeated ids each get a row, and among seeds are ordered by their components; vectors
with a null id are clustered but seed no centroid; with fewer vectors than centroids each
vector seeds one; without any seed, cluster and distance are null; a distance or an inertia past a
64-bit integer is null; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .util import drop, settle

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5


class Nearest:
    """Assigns blocks of whole-number vectors to the nearest of some centres; ties go to the smaller number."""

    def __init__(self, centers: list[list[int]], size: int) -> None:
        self.centers, self.size, self.reach = centers, size, V.reach(size, 53)
        self.small = [j for j, c in enumerate(centers) if max(map(abs, c)) <= self.reach]
        self.large = [j for j in range(len(centers)) if j not in set(self.small)]
        self.table = np.array([centers[j] for j in self.small], dtype=np.float64).reshape(-1, size)
        self.squares = (self.table * self.table).sum(axis=1)

    def __call__(self, block: V.Whole) -> tuple[np.ndarray, list[int]]:
        """(number of the centre, squared distance) of every vector of the block."""
        index, distance = np.zeros(block.n, dtype=np.int64), [0] * block.n
        x = block.near
        if len(x):
            if self.small:
                expanded = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ self.table.T) + self.squares[None, :]
                best = expanded.argmin(axis=1)
                found = expanded[np.arange(len(x)), best].astype(np.int64).tolist()
                best = np.array(self.small)[best]
            else:
                best, found = np.full(len(x), self.large[0]), V.exact_distance(x, self.centers[self.large[0]])
            for j in self.large:
                for i, d in enumerate(V.exact_distance(x, self.centers[j])):
                    if (d, j) < (found[i], best[i]):
                        best[i], found[i] = j, d
            index[block.at] = best
            for at, d in zip(block.at.tolist(), found):
                distance[at] = d
        for at, row in zip(block.far_at.tolist(), block.far):
            d, j = min((V.exact_distance(np.array([row], dtype=object), c)[0], j) for j, c in enumerate(self.centers))
            index[at], distance[at] = j, d
        return index, distance


def _step(state: tuple, block: V.Whole, nearest: Nearest) -> tuple:
    """state: (counts, sums, inertias), each in Python integers."""
    counts, sums, inertias = state
    index, distance = nearest(block)
    k = len(counts)
    members = np.zeros((k, len(block.at)))
    members[index[block.at], np.arange(len(block.at))] = 1
    for j, (n, row) in enumerate(zip(np.bincount(index, minlength=k).tolist(), (members @ block.near).astype(np.int64).tolist())):
        if n:
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], row)]
    for at, row in zip(block.far_at.tolist(), block.far):
        sums[index[at]] = [a + b for a, b in zip(sums[index[at]], row)]
    for j, d in zip(index.tolist(), distance):
        inertias[j] += d
    return counts, sums, inertias


def _merge(a: tuple, b: tuple) -> tuple:
    return [x + y for x, y in zip(a[0], b[0])], [[x + y for x, y in zip(s, t)] for s, t in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]


def _pass(blocks: DataFrame, centers: list[list[int]], size: int, scale: int) -> tuple:
    nearest = Nearest(centers, size)
    zero = ([0] * len(centers), [[0] * size for _ in centers], [0] * len(centers))

    def add(state: tuple, row) -> tuple:
        return _step(state, V.Whole(V.unpacked(row, size), scale, nearest.reach), nearest)

    return V.summed(blocks, zero, add, _merge)


def cluster(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, n_centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector
    of ``size`` components. ``scale`` is a power of two.

    The centroids start as the vectors with the smallest hex SHA-256 of ``seed:id``.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    kept = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter((F.size("vector") == size) & V.finite(F.col("vector")))
    named = kept.filter("vec_id is not null").withColumn("mark", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("mark", "vector").limit(n_centroids).select("vector").collect()
    centers = []
    if first:
        whole = V.Whole(np.array([r.vector for r in first], dtype=np.float64), scale, 0)  # reach 0: Python integers, but for zero vectors
        far = dict(zip(whole.far_at.tolist(), whole.far))
        centers = [far.get(i, [0] * size) for i in range(len(first))]
    inertias: list[int] = []
    if centers:
        blocks = V.packed(kept, "vector", size)
        for _ in range(rounds):
            counts, sums, _ = _pass(blocks, centers, size, scale)
            centers = V.floor_means(centers, counts, sums)
        inertias = _pass(blocks, centers, size, scale)[2]
        drop(blocks)
    of_all = V.long_or_null(sum(inertias))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    nearest = Nearest(centers, size) if centers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if nearest is None:
                index, distance = [None] * n, [None] * n
            else:
                index, distance = nearest(V.Whole(V.matrix(batch.column(1), size), scale, nearest.reach))
                index = index.tolist()
            known = nearest is not None
            columns = [
                batch.column(0),
                pa.array(index, pa.int32()),
                pa.array([V.long_or_null(d) for d in distance], pa.int64()),
                pa.array([V.long_or_null(inertias[j]) if known else None for j in index], pa.int64()),
                pa.array([of_all if known else None] * n, pa.int64()),
                pa.array([digests[j] if known else None for j in index], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        settle()

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
