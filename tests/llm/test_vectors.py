"""Clustering and vector codes against brute force in Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from recollect.llm import centroids, vector_codes, vectors
from recollect.llm.util import tuned

NAN, INF = float("nan"), float("inf")


def whole(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, centers):
    return min((gap(v, c), j) for j, c in enumerate(centers))


def means(centers, members):
    return [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(centers, members)]


def long_(x):
    return x if x < 1 << 63 else None


def brute_clusters(rows, size, scale, k, rounds):
    kept = [(i, v, whole(v, scale)) for i, v in rows if v is not None and len(v) == size and usable(v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, w) for i, v, w in kept if i is not None)
    centers = [w for _, _, w in seeds[:k]]
    for _ in range(rounds):
        members = [[] for _ in centers]
        for _, _, w in kept:
            members[nearest(w, centers)[1]].append(w)
        centers = means(centers, members)
    found = [(i, *nearest(w, centers)) for i, _, w in kept]
    own = {j: sum(d for _, d, c in found if c == j) for j in range(len(centers))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, c, long_(d), long_(own[c]), long_(sum(own.values())), digest[c]) for i, d, c in found]


def brute_codes(rows, scale, parts, entries, rounds):
    kept = [(i, v, whole(v, scale), lab) for i, v, lab in rows if usable(v)]
    size = next(len(v) for i, v, _, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])) if v and len(v) % parts == 0)
    width = size // parts
    fit = [r for r in kept if len(r[1]) == size]
    first = [w for _, _, w, _ in sorted((r for r in fit if r[0] is not None), key=lambda r: (r[0], r[1]))][:entries]
    books = [[w[p * width : (p + 1) * width] for w in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in first]
            for _, _, w, _ in fit:
                own = w[p * width : (p + 1) * width]
                members[nearest(own, books[p])[1]].append(own)
            books[p] = means(books[p], members)
    coded = []
    for i, v, w, lab in kept:
        if len(v) != size:
            coded.append((i, None, None, lab))
            continue
        found = [nearest(w[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{j:02x}" for _, j in found), long_(sum(d for d, _ in found)), lab))
    total = {}
    for _, _, e, lab in coded:
        if e is not None:
            total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {k: long_(x) for k, x in total.items()}
    return [(i, c, e, total.get(lab), digest) for i, c, e, lab in coded]


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple((x is None, x) for x in r))


def sample(kind, size):
    r = random.Random(f"{kind}{size}")
    spread = {"small": 1.0, "ties": 0.01, "wide": 3e5, "huge": 1e30, "top": 1.7e308}[kind]
    rows = []
    for i in range(90):
        v = [r.uniform(-1, 1) for _ in range(size)]
        if kind == "ties":
            v = [round(x) * spread for x in v]
        if kind in ("wide", "huge", "top") and i % 5 == 0:
            v = [x * spread for x in v]
        rows.append((i - 3, v, r.choice([1, 2, None])))
    rows += [(5, rows[7][1], 1), (None, rows[9][1], 2), (700, None, 1), (701, [NAN] * size, 1), (702, [0.5] * (size - 1) + [None], 1), (703, [INF] + [0.0] * (size - 1), 1)]
    return rows + [(704, [0.25] * (size + 1), 1), (705, [], 2), (706, [0.0] * size, None)]


@pytest.mark.parametrize("kind", ["small", "ties", "wide", "huge", "top"])
def test_clusters_and_codes(spark, kind):
    rows = sample(kind, 16)
    table = tuned(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = centroids.cluster(table, size=16, n_centroids=7, rounds=3)
    assert ordered(got.collect()) == ordered(brute_clusters([r[:2] for r in rows], 16, centroids.SCALE, 7, 3))
    got = vector_codes.encode(table, entries=6, rounds=3)
    assert ordered(got.collect()) == ordered(brute_codes(rows, vector_codes.SCALE, 8, 6, 3))


def test_empty_tables_and_other_columns(spark):
    table = tuned(spark).createDataFrame([(1, [0.5] * 64, 3, "a")], "vec_id long, embedding array<float>, label int, code string")
    assert [r.cluster for r in centroids.cluster(table).collect()] == [0]
    assert [(r.code, r.error) for r in vector_codes.encode(table).collect()] == [("00" * 8, 0)]
    for made in (centroids.cluster(table.limit(0)), vector_codes.encode(table.limit(0))):
        assert made.collect() == []
    lone = tuned(spark).createDataFrame([(None, [0.5] * 64, 3)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in centroids.cluster(lone).collect()] == [(None,) * 6]
    assert [tuple(r)[:4] for r in vector_codes.encode(lone).collect()] == [(None,) * 4]
    with pytest.raises(ValueError):
        centroids.cluster(table, scale=3)


def test_intervals_hold_the_exact_numbers():
    r = np.random.default_rng(4)
    for top in (3, 300, 1 << 20, 1 << 28):
        x, c = (r.integers(-top, top + 1, (50, 8)).astype(float) for _ in range(2))
        low, high = vector_codes.intervals(x, c)
        for i in range(50):
            for j in range(50):
                exact = sum(int(v) ** 2 for v in c[j]) - 2 * sum(int(a) * int(b) for a, b in zip(x[i], c[j]))
                assert low[i, j] <= exact <= high[i, j]


def test_bounds_keep_products_exact():
    for size in (1, 8, 64, 1000):
        for bits in (53, 63):
            top = vectors.reach(size, bits)
            assert size * (2 * top) ** 2 < 1 << bits
