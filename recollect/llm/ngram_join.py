"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Words are runs of other than ASCII white space, with A-Z lower-cased. A
document's set holds its distinct WORDS-word shingles as 64-bit hashes (fewer
words: the whole sequence as one). Documents with equal sets form one class.

The global order puts the most frequent shingles (exact counts over all
documents; a bounded number of them, ORDER_ENTRIES) last, by count, and all
others before them by hash. Two sets that reach the threshold share a shingle
in the prefixes that the threshold leaves them, so prefixes are dealt by
fragments of the order and classes meet where they share a shingle.

Classes that met are compared in cells: a few classes on either side. A parity
bitmap of each set bounds every overlap of a cell from above; classes without a
possible partner go. The sets of the rest are cut into fragments of the order,
the overlaps of a cell are counted in each fragment separately and summed per
pair, and a cell reports no more links than join what it holds: what it writes
grows with its classes, not with their pairs.

First each class of a group (the classes that share a shingle) meets the group's
leader, the class with the fewest rarer shingles, which among copies is the least
edited text; groups of up to SMALL classes give all their pairs. Then groups that
are not yet joined throughout are cut into blocks of BLOCK classes of like size
and blocks that share a shingle are compared, but for those joined already.

Defined results: null and empty texts and texts without words have an empty set
and link with nothing (component_id is their own doc_id); repeated rows each get
a row; a null doc_id takes part through its text, so that it can link others, and never
names a component (null if no row of the component has an id); columns other than
the key and the text are not read and may have any name; an empty table gives no
rows. Shingles and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import bloom_hits, bloom_of, brief_shuffles, components, cut, drop, free, partitions, runs, settle, slices

WORDS = 5
#: Similarity as a fraction: links need SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Shingles in at least FREQUENT documents can be put last; at most ORDER_ENTRIES of them, the most frequent.
FREQUENT = 32
ORDER_ENTRIES = 1 << 18
#: Groups of up to SMALL classes give all their pairs at once: at most SMALL / 2 for each class.
SMALL = 16
#: Classes, and shingles of their sets, on one side of a comparison; classes that meet one leader in a cell.
BLOCK, HEAVY, STAR = 256, 1 << 20, 64
#: Members of a group that one task may hold when groups meet their leaders.
SPREAD = 1024
#: Sizes of one block differ by less than this factor.
BAND = 1.15
#: Shingles gathered in a worker before they are sent on.
GATHER = 400_000
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 4
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_COUNT_SHIFT, _TOKEN_SHIFT = np.uint64(24), np.uint64(16)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + n]) * _MIX[k % 5]
        mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX[0]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n, share=SHARE):
    """Shingles of a set of n that a partner must meet at least one of."""
    return n - -(-share[0] * n // share[1]) + 1


# -- sorted integers as bytes: differences, by byte planes --------------------


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned integers below 2**48."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(gaps[:, :6].T).tobytes()


def planes(values: np.ndarray) -> bytes:
    """Integers below 2**32 by byte planes: the high ones are mostly zero."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(6, -1)
    gaps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    gaps[:, :6] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


# -- bitmaps ---------------------------------------------------------------------


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the hashes in each of 2 to 4 times as many cells (a power of two, 256 to 65536)."""
    cells = 1 << min(16, max(8, (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps, folded to ``size`` bytes: parities add up."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def can_link(n_a, n_b, differ, share=SHARE):
    """Whether sets of these sizes can reach the threshold if at least ``differ`` elements are in only one."""
    union2 = n_a + n_b + differ  # twice the smallest union; n_a + n_b - differ: twice the largest intersection
    return (share[1] * (n_a + n_b - differ) >= share[0] * union2) & (share[1] * np.minimum(n_a, n_b) >= share[0] * np.maximum(n_a, n_b))


# -- frequencies --------------------------------------------------------------


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(40-bit shingle codes, ascending; their place when ordered by count; parts of at most SPREAD documents).

    Every shingle of every document is counted; the ORDER_ENTRIES most frequent
    are returned. The choice only orders shingles: no result depends on it.
    """
    parts = 4 * partitions(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held) >> _COUNT_SHIFT)
            held.clear()
            part = (codes * np.uint64(parts) >> np.uint64(40)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            return pa.RecordBatch.from_pydict({"p": part[at].astype(np.int32), "codes": [pack(c) for c in np.split(codes, at[1:])]})

        for batch in slices(batches, text):
            for t in batch.column(0).to_pylist():
                if len(own := shingles(t)):
                    held.append(own)
            if sum(map(len, held)) > GATHER:
                yield out()
        if held:
            yield out()
        settle()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            codes = np.sort(np.concatenate([unpack(raw) for (raw,) in rows]))
            at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            n = np.diff(np.r_[at, len(codes)])
            yield pa.RecordBatch.from_pydict({"code": codes[at[n >= FREQUENT]].astype(np.int64), "n": n[n >= FREQUENT]})
        settle()

    blobs = docs.select(text).mapInArrow(emit, "p int, codes binary").repartition(parts // 4, "p").sortWithinPartitions("p")
    most = blobs.mapInArrow(count, "code long, n long").orderBy(F.desc("n"), "code").limit(ORDER_ENTRIES).toArrow()
    codes, n = most.column(0).to_numpy().astype(np.uint64), most.column(1).to_numpy()
    place = np.empty(len(codes), dtype=np.int64)
    place[np.lexsort((codes, n))] = np.arange(len(codes))
    order = np.argsort(codes)
    return codes[order], place[order], 1 + n[order] // SPREAD


# -- prefixes -----------------------------------------------------------------

_PREFIX = "kind int, doc_id long, n long, class long, p int, tokens binary, owners binary, places binary, classes binary, sizes binary, bits binary, spread int"


def _prefixes(docs: DataFrame, key: str, text: str, frequent, share) -> DataFrame:
    """Kind 0: a row a document, with its bitmap at the class's first in a task's batch. Kind 1: light prefix shingles of a fragment, packed.
    Kind 2: one frequent prefix shingle of a class of n shingles (its code in doc_id, its place in p)."""
    parts = 4 * partitions(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by ORDER_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, place, spread = shared.value
        sets: list[np.ndarray] = []
        names: list[int] = []
        seen: set[int] = set()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = list(rows)
            rows.clear()
            if sets:
                sizes = np.array([len(s) for s in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                late = np.zeros(len(flat), dtype=bool)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, flat >> _COUNT_SHIFT), len(codes) - 1)
                    late = codes[at] == flat >> _COUNT_SHIFT
                first = np.cumsum(sizes) - sizes
                early = np.cumsum(~late)
                base = np.repeat(early[first] - ~late[first], sizes)
                wanted = prefix_length(sizes, share)
                take = ~late & (early - base <= np.repeat(wanted, sizes))
                tokens, who, place_in = flat[take] >> _TOKEN_SHIFT, owner[take], (early - base)[take] - 1
                order = np.argsort(tokens, kind="stable")
                tokens, who, place_in = tokens[order], who[order], place_in[order]
                part = (tokens * np.uint64(parts) >> np.uint64(48)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[1:] if len(part) else []
                table = np.array(names, dtype="<i8")
                for p, t, w, i in zip(np.unique(part), np.split(tokens, cuts), np.split(who, cuts), np.split(place_in, cuts)):
                    present, local = np.unique(w, return_inverse=True)
                    made.append((1, None, None, None, int(p), pack(t), planes(local), planes(i), table[present].tobytes(), planes(sizes[present]), None, None))
                taken = np.bincount(owner[take], minlength=len(sets))
                left = wanted - taken
                for i in np.flatnonzero(left > 0):
                    span = slice(first[i], first[i] + sizes[i])
                    mine, where = flat[span][late[span]], at[span][late[span]]
                    for step, k in enumerate(np.lexsort((mine, place[where]))[: left[i]]):
                        made.append((2, int(mine[k].view(np.int64)), int(sizes[i]), names[i], int(taken[i]) + step, *[None] * 6, int(spread[where[k]])))
                sets.clear()
                names.clear()
                seen.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array([m[c] for m in made], k) for c, k in enumerate(kinds)],
                names=[f.split()[0] for f in _PREFIX.split(", ")],
            )

        gathered = 0
        for batch in slices(batches, text):
            for k, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(t)
                name = class_of(own)
                fresh = len(own) > 0 and name not in seen
                rows.append((0, k, len(own), name, *[None] * 6, bitmap(own) if fresh else None, None))
                if fresh:
                    seen.add(name)
                    sets.append(own)
                    names.append(name)
                    gathered += len(own)
            if gathered > GATHER:
                yield out()
                gathered = 0
        yield out()
        settle()

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _PREFIX)


def _can_start(n_a, n_b, i, j, share):
    """Whether sets of these sizes that share the shingles at places i and j of the order, and
    none before, can reach the threshold. Of the shingles a linking pair shares the first passes."""
    most = np.minimum(n_a - i, n_b - j)
    return ((share[0] + share[1]) * most >= share[0] * (n_a + n_b)) & (share[1] * np.minimum(n_a, n_b) >= share[0] * np.maximum(n_a, n_b))


_MET = "u long, v long, token long, n long, place long, size long, spread int, leader long, leader_n long, leader_place long"


def _meet(share):
    """Of the packed light shingles of a fragment: the pairs (u, v) of small groups that can link
    by sizes and places, each once; larger groups as members (token, u, n, place) with their leader."""

    def columns(**named) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(named.values())))
        kinds = {f.split()[0]: pa.int32() if f.endswith("int") else pa.int64() for f in _MET.split(", ")}
        for at in range(0, n, 10_000):
            size = min(n - at, 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(named[f][at : at + size], k) if f in named else pa.nulls(size, k) for f, k in kinds.items()],
                names=list(kinds),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            held = []
            for tokens, owners, places, classes, sizes in rows:
                own = unplaned(owners)
                held.append((unpack(tokens), np.frombuffer(classes, dtype="<i8")[own], unplaned(sizes)[own], unplaned(places)))
            tokens, classes, sizes, places = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((classes, tokens))
            tokens, classes, sizes, places = tokens[order], classes[order], sizes[order], places[order]
            fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])]
            tokens, classes, sizes, places = tokens[fresh], classes[fresh], sizes[fresh], places[fresh]
            at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            n = np.diff(np.r_[at, len(tokens)])
            us, vs = [], []
            for size in np.unique(n[(n > 1) & (n <= SMALL)]).tolist():
                starts = at[n == size]
                one, two = np.triu_indices(size, 1)
                step = max(1, 500_000 // len(one))
                for k in range(0, len(starts), step):
                    a, b = ((starts[k : k + step, None] + side[None, :]).ravel() for side in (one, two))
                    fine = _can_start(sizes[a], sizes[b], places[a], places[b], share)
                    us.append(classes[a[fine]])
                    vs.append(classes[b[fine]])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)  # u < v: classes ascend in a group
                order = np.lexsort((v, u))
                u, v = u[order], v[order]
                first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
                yield from columns(u=u[first], v=v[first])
            for start, size in zip(at[n > SMALL].tolist(), n[n > SMALL].tolist()):
                span = slice(start, start + size)
                head = start + int(np.lexsort((classes[span], places[span]))[0])
                same = {"size": size, "spread": 1 + size // SPREAD, "leader": classes[head], "leader_n": sizes[head], "leader_place": places[head]}
                yield from columns(
                    u=classes[span],
                    token=tokens[span].astype(np.int64),
                    n=sizes[span],
                    place=places[span],
                    **{k: np.full(size, x) for k, x in same.items()},
                )
        settle()

    return run


# -- cells ----------------------------------------------------------------------


def _differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Least number of elements in only one of two sets, for bitmaps side by side."""
    out = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)])
    for one, two in {tuple(x) for x in sizes.tolist()}:
        at = np.flatnonzero((sizes[:, 0] == one) & (sizes[:, 1] == two))
        left, right = (np.frombuffer(b"".join([side[i] for i in at]), dtype=np.uint8).reshape(len(at), -1) for side in (a, b))
        small = min(one, two)
        out[at] = np.bitwise_count(_folded(left, small) ^ _folded(right, small)).sum(axis=1, dtype=np.int64)
    return out


def _can_partner(rows: DataFrame, classes: DataFrame, share) -> DataFrame:
    """rows: (cell, side, node, component), side 2 standing on both sides. Those that can link, by
    their bitmaps, with a node of another component on the other side of their cell; with n."""
    loaded = rows.join(classes.select("node", "n", "bits"), "node").select("cell", "side", "node", "component", "n", "bits")
    dealt = loaded.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell,), held in runs(batches):
            a, b = [i for i, r in enumerate(held) if r[0] != 1], [i for i, r in enumerate(held) if r[0] != 0]
            keep = np.zeros(len(held), dtype=bool)
            if a and b:
                n_b, of_b = np.array([held[j][3] for j in b]), np.array([held[j][2] for j in b])
                for i in a:
                    _, _, component, size, bits = held[i]
                    at = np.flatnonzero((of_b != component) & can_link(size, n_b, 0, share))
                    if len(at):
                        near = at[can_link(size, n_b[at], _differ([bits] * len(at), [held[b[j]][4] for j in at]), share)]
                        keep[[b[j] for j in near]] = True
                        keep[i] |= len(near) > 0
            if keep.any():
                made = [(cell, *r[:4]) for r, k in zip(held, keep) if k]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[c] for m in made], k) for c, k in enumerate(kinds)],
                    names=["cell", "side", "node", "component", "n"],
                )
        settle()

    return dealt.mapInArrow(run, "cell long, side int, node long, component long, n long")


def _sets(docs: DataFrame, pool: DataFrame, key: str, text: str) -> DataFrame:
    """(node, fragment, part) of the classes in ``pool`` (node, rep): computed again from the
    texts of their representatives, which a bounded Bloom filter picks out, and of rows without
    a key. Written to the shared folder."""
    bits = bloom_of(pool, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            hit = bloom_hits(bits.value, batch.column(0).fill_null(0).to_numpy().astype(np.int64))
            batch = batch.filter(pa.array(hit | ~known))
            made = []
            for t in batch.column(1).to_pylist():
                own = shingles(t)
                name = class_of(own)
                where = (own >> np.uint64(62)).astype(np.int64) * FRAGMENTS // 4
                cuts = np.searchsorted(where, np.arange(1, FRAGMENTS))
                made += [(name, f, part.astype("<u8").tobytes()) for f, part in enumerate(np.split(own, cuts)) if len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[c] for m in made], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                names=["node", "fragment", "part"],
            )
        settle()

    made = docs.select(F.col(key).cast("long").alias("k"), F.col(text)).mapInArrow(run, "node long, fragment int, part binary")
    made = cut(made.join(pool.select("node"), "node", "left_semi").dropDuplicates(["node", "fragment"]), "sets")
    bits.unpersist()
    return made


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right set."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    own_l, own_r = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    if len(left) == 1:
        out[0] = np.bincount(own_r[np.isin(flat_r, flat_l)], minlength=len(right))
        return out
    both = np.intersect1d(flat_l, flat_r)
    if not len(both):
        return out
    at_l, at_r = np.minimum(np.searchsorted(both, flat_l), len(both) - 1), np.minimum(np.searchsorted(both, flat_r), len(both) - 1)
    in_l, in_r = both[at_l] == flat_l, both[at_r] == flat_r
    at_l, own_l, at_r, own_r = at_l[in_l], own_l[in_l], at_r[in_r], own_r[in_r]
    width = 4096
    for start in range(0, len(both), width):
        one, two = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        k = (at_l >= start) & (at_l < start + width)
        one[own_l[k], at_l[k] - start] = 1
        k = (at_r >= start) & (at_r < start + width)
        two[own_r[k], at_r[k] - start] = 1
        out += (one @ two.T).astype(np.int64)
    return out


def _linked(rows: DataFrame, sets: DataFrame, share) -> DataFrame:
    """rows: (cell, side, node, component, n). Links (u, v) of unlike components between the sides
    of a cell, as few as join what they join: overlaps are counted fragment by fragment."""
    met = rows.join(sets, "node").select("cell", "fragment", "side", "node", "component", "n", "part")
    dealt = met.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "fragment")

    class Cell:
        def __init__(self) -> None:
            self.sides: tuple[dict, dict] = ({}, {})
            self.counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(self, held: list[tuple]) -> None:
            picked = []
            for which in (0, 1):
                places, parts, names = [], [], self.sides[which]
                for side, node, component, n, part in held:
                    if side in (which, 2):
                        places.append(names.setdefault(node, (len(names), component, n))[0])
                        parts.append(np.frombuffer(part, dtype="<u8"))
                picked.append((np.array(places), parts))
            (a, left), (b, right) = picked
            if len(a) and len(b):
                self.counts.append((a, b, overlaps(left, right)))

        def links(self) -> list[tuple[int, int]]:
            left, right = ([(node, *rest) for node, rest in side.items()] for side in self.sides)
            if not self.counts:
                return []
            both = np.zeros((len(left), len(right)), dtype=np.int64)
            for a, b, counted in self.counts:
                both[np.ix_(a, b)] += counted
            n_a, n_b = np.array([x[3] for x in left])[:, None], np.array([x[3] for x in right])[None, :]
            of_a, of_b = np.array([x[2] for x in left])[:, None], np.array([x[2] for x in right])[None, :]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for i, j in np.argwhere((of_a != of_b) & (share[1] * both >= share[0] * (n_a + n_b - both))).tolist():
                one, two = root(left[i][2]), root(right[j][2])
                if one != two:
                    parent[max(one, two)] = min(one, two)
                    out.append((left[i][0], right[j][0]))
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell()
        for (name, _), held in runs(batches, 2):
            if name != at:
                yield _pairs(cell.links())
                at, cell = name, Cell()
            cell.add(held)
        yield _pairs(cell.links())
        settle()

    return dealt.mapInArrow(run, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], names=["u", "v"])


def _compared(rows: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, share) -> DataFrame:
    """Links (u, v) that the cells of ``rows`` (cell, side, node, component) hold."""
    near = cut(_can_partner(rows, classes, share), "near")
    pool = cut(near.select("node").distinct().join(classes.select("node", "rep"), "node"), "pool")
    sets = _sets(docs, pool, key, text)
    links = cut(_linked(near, sets, share), "links")
    drop(near, pool, sets)
    return links


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    return _components_of_rows(docs, key, text, share).select("doc_id", "n_shingles", "component_id")


def _groups(prefixes: DataFrame, light: DataFrame) -> DataFrame:
    """(late, token, salt, spread, node, n, place, size, leader, leader_n, leader_place) of the members of groups
    of frequent shingles and of large groups of light ones. Hot groups are dealt by token and salt."""
    salt = F.pmod(F.xxhash64("node"), F.col("spread")).cast("int").alias("salt")
    late = prefixes.filter("kind = 2").select(
        F.col("doc_id").alias("token"),
        F.col("class").alias("node"),
        "n",
        F.col("p").cast("long").alias("place"),
        "spread",
    )
    # Dealt once, for the copies that several tasks saw and for the join with the heads.
    late = late.withColumn("salt", salt).repartition("token", "salt").distinct()
    heads = late.groupBy("token").agg(
        F.max("spread").alias("spread"),
        F.min(F.struct("place", "node", "n")).alias("head"),
        F.count("*").alias("size"),
    ).filter("size > 1")
    salts = F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt")
    heads = heads.select(
        "token",
        salts,
        "spread",
        "size",
        F.col("head.node").alias("leader"),
        F.col("head.n").alias("leader_n"),
        F.col("head.place").alias("leader_place"),
    )
    late = late.select("token", "salt", "node", "n", "place")
    columns = ["late", "token", "salt", "spread", "node", "n", "place", "size", "leader", "leader_n", "leader_place"]
    late = late.join(heads, ["token", "salt"]).withColumn("late", F.lit(1)).select(*columns)
    large = light.filter("v is null").withColumnRenamed("u", "node").withColumn("salt", salt).withColumn("late", F.lit(0)).select(*columns)
    return late.unionByName(large)


def _first_cells(light: DataFrame, groups: DataFrame, share) -> DataFrame:
    """Cells of the first round: the pairs of small groups, and members of larger ones with their leader."""
    start = f"{share[0] + share[1]} * least(n - place, leader_n - leader_place) >= {share[0]} * (n + leader_n)"
    weight = F.col("size") * F.greatest(F.lit(1 / STAR), F.col("leader_n") * (share[1] / share[0] / HEAVY))  # no partner is larger than the leader allows
    stars = groups.filter("node <> leader").filter(start).select(
        F.col("leader").alias("u"),
        F.col("node").alias("v"),
        F.ceil(weight).cast("int").alias("parts"),
    )
    pairs = light.filter("v is not null").select("u", "v", F.lit(1).alias("parts")).unionByName(stars).groupBy("u", "v").agg(F.max("parts").alias("parts"))
    pairs = pairs.select("u", "v", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("cell"))
    return pairs.select("cell", F.lit(1).alias("side"), F.col("v").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select("cell", F.lit(0).alias("side"), F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


def _second_cells(groups: DataFrame, joined: DataFrame, share) -> DataFrame:
    """Cells of the second round: pairs of blocks of groups that the first round has not joined throughout."""
    larger = groups.filter("size > 2").join(joined, "node", "left").select(
        "late",
        "token",
        "salt",
        "spread",
        "node",
        "n",
        "size",
        "leader",
        F.coalesce("component", "node").alias("component"),
    )
    mixed = larger.groupBy("late", "token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("spread").alias("spread")).filter("a <> b")
    mixed = mixed.select("late", "token", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    open_ = cut(larger.join(mixed, ["late", "token", "salt"], "left_semi"), "open")
    band = F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int").alias("band")
    # Each step is written: tasks of the next then follow the size of what is left.
    homes = cut(open_.groupBy("node", "component", "n", band).agg(F.max(F.struct("size", "leader"))["leader"].alias("home")), "homes")
    filled = homes.groupBy("home", "component").count()
    kinds = homes.join(filled, ["home", "component"]).withColumn("pure", F.when(F.col("count") >= BLOCK, F.col("component")))
    kinds = cut(kinds.drop("count"), "kinds")
    counted = kinds.groupBy(F.col("home").alias("of"), F.col("pure").alias("kind"), F.col("band").alias("in_band")).agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HEAVY)).cast("int").alias("parts")
    )
    where = kinds.join(counted, (F.col("home") == F.col("of")) & F.col("pure").eqNullSafe(F.col("kind")) & (F.col("band") == F.col("in_band")))
    block = F.xxhash64("home", "pure", "band", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")
    where = cut(where.select("node", "component", "pure", "band", block), "blocks")
    held = open_.join(where.select("node", "block", "pure", "band"), "node").select("late", "token", "block", "pure", "band")
    held = cut(held.distinct(), "held")
    # Of shingles that the same blocks hold one stands for all.
    alike = held.groupBy("late", "token").agg(F.bit_xor(F.xxhash64("block")).alias("x"), F.count("*").alias("k"))
    alike = alike.groupBy("x", "k").agg(F.min(F.struct("late", "token")).alias("one")).select("one.late", "one.token")
    spots = cut(held.join(alike, ["late", "token"], "left_semi"), "spots")
    other = spots.select(
        F.col("late").alias("late2"),
        F.col("token").alias("token2"),
        F.col("block").alias("block2"),
        F.col("pure").alias("pure2"),
        F.col("band").alias("band2"),
    )
    reach = math.floor(math.log(share[1] / share[0]) / math.log(BAND)) + 2
    near = (F.col("block") <= F.col("block2")) & (F.abs(F.col("band") - F.col("band2")) <= reach)
    unlike = F.col("pure").isNull() | F.col("pure2").isNull() | (F.col("pure") != F.col("pure2"))
    met = spots.join(other, (F.col("late") == F.col("late2")) & (F.col("token") == F.col("token2")) & near & unlike)
    pairs = cut(met.select("block", "block2").distinct(), "pairs")
    cell = F.xxhash64("block", "block2").alias("cell")
    sides = pairs.select("block", cell, F.when(F.col("block") == F.col("block2"), 2).otherwise(0).alias("side")).unionByName(
        pairs.filter("block <> block2").select(F.col("block2").alias("block"), cell, F.lit(1).alias("side"))
    )
    rows = cut(sides.join(where.select("block", "node", "component"), "block").select("cell", "side", "node", "component"), "cells")
    drop(open_, homes, kinds, where, held, spots, pairs)
    return rows


def _components_of_rows(docs: DataFrame, key: str, text: str, share) -> DataFrame:
    """As jaccard_components, with each row's class and the component's own name, which unlike
    components that share an id do not share."""
    with brief_shuffles(docs.sparkSession):
        return _joined(docs, key, text, share)


def _joined(docs: DataFrame, key: str, text: str, share) -> DataFrame:
    frequent = frequent_shingles(docs, text)
    prefixes = cut(_prefixes(docs, key, text, frequent, share), "prefix")
    members = prefixes.filter("kind = 0").select("doc_id", "n", "class")
    by_class = prefixes.filter("kind = 0 and n > 0").groupBy(F.col("class").alias("node"))
    classes = cut(by_class.agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")), "classes")

    packed = prefixes.filter("kind = 1").select(
        "p",
        "tokens",
        "owners",
        "places",
        "classes",
        "sizes",
    ).repartition(partitions(docs.sparkSession), "p").sortWithinPartitions("p")
    light = cut(packed.mapInArrow(_meet(share), _MET), "light")
    groups = cut(_groups(prefixes, light), "groups")

    first = _compared(_first_cells(light, groups, share), classes, docs, key, text, share)
    joined = components(first)
    cells = _second_cells(groups, joined, share)
    links = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
    if cells.isEmpty():
        second, final = cells, joined
    else:
        second = _compared(cells, classes, docs, key, text, share)
        final = components(links.unionByName(second))
    # Only components of several classes are looked up: as a rule a small table, whatever their sizes.
    named = cut(classes.select("node", "rep").join(final, "node", "left"), "named")
    joint = named.filter("component is not null")
    least = joint.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = joint.join(least, "component").select(F.col("node").alias("class"), "component_id", "component")
    of_class = of_class.unionByName(
        named.filter("component is null").select(F.col("node").alias("class"), F.col("rep").alias("component_id"), F.col("node").alias("component")),
    )
    result = members.join(of_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", "component"
    )
    result = cut(result, "jaccard")
    drop(prefixes, light, classes, groups, first, joined, cells, second, final, named)
    return result


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one row of each component, the first by text of its rows with the smallest
    key (without any key: of all its rows); rows with an empty set all stay.

    Rows are told apart by key and set, so that unlike texts of one key, and rows without a key,
    are judged each by its own component. Columns may have any name.

    Rows that a bounded Bloom filter of the keys to look at clears pass straight
    through; only the rest meet the exact list.
    """
    found = _components_of_rows(docs, key, text, share)
    gone = (F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))
    of_key = found.filter("doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("many"), F.max(gone).alias("moved"))
    doubtful = cut(of_key.filter("moved or many").select("doc_id", "many"), "doubtful")
    bits = bloom_of(doubtful, "doc_id")
    doubt, id_, many_, class_, of, stays, component = (free(x, docs) for x in ("doubt", "id_of", "many", "class_of_row", "of", "stays", "component"))

    @F.pandas_udf("boolean")
    def doubted(keys):
        numbers = keys.fillna(0).to_numpy().astype(np.int64)
        return pd.Series(bloom_hits(bits.value, numbers) | keys.isna().to_numpy())

    @F.pandas_udf("long")
    def classed(texts):
        return pd.Series([class_of(shingles(t)) for t in texts], dtype="int64")

    marked = docs.withColumn(doubt, doubted(F.col(key).cast("long")))
    clear = marked.filter(~F.col(doubt)).select(*docs.columns)
    rest = cut(marked.filter(F.col(doubt)).drop(doubt), "rest")  # read several times below
    listed = doubtful.select(F.col("doc_id").alias(id_), F.col("many").alias(many_))
    keyed = rest.filter(F.col(key).isNotNull()).join(listed, F.col(key).cast("long") == F.col(id_), "left")
    single = keyed.filter(F.col(id_).isNull()).select(*docs.columns)

    # Rows of a repeated key, or without one, are told apart by their class.
    wanted = found.filter("n_shingles > 0").join(doubtful.filter("many").select("doc_id"), "doc_id", "left_semi")
    wanted = wanted.unionByName(found.filter("n_shingles > 0 and doc_id is null"))
    own = F.col("component_id").eqNullSafe(F.col("doc_id"))
    known = wanted.select(F.col("doc_id").alias(id_), F.col("class").alias(of), F.col("component").alias(component), own.alias(stays)).distinct()
    many = keyed.filter(F.col(many_)).drop(id_, many_).unionByName(rest.filter(F.col(key).isNull()))
    many = many.withColumn(class_, classed(F.col(text)))
    many = many.join(known, F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.col(class_) == F.col(of)), "left")
    bare = many.filter(F.col(of).isNull()).select(*docs.columns)
    rows = many.filter(F.col(stays)).groupBy(F.col(id_), F.col(component)).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.col(text)).alias("row"))
    return clear.unionByName(single).unionByName(bare).unionByName(rows.select("row.*"))
