"""Repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A text is its UTF-8 bytes. Every string of SPAN bytes that also starts earlier (at a
smaller document, or in the same one further left) is repeated, and the bytes that
repeated strings cover are removed.

Sorting all suffixes would move the corpus a hundred times, so two sorts of fewer
strings do it. Of the shorter grams inside a SPAN-byte string the one with the least hash
(the leftmost of them) is its anchor; the strings of one anchor are a piece, some
27 strings on average. Equal strings have equal anchors at equal places, so that

1. pieces are sorted, each as the suffix at its anchor followed by what stands before
   it. Of equal pieces all but the earliest are repeated throughout. The prefixes shared with
   the others of its anchor say how far to the right a piece can agree with any of them;
2. strings of the earliest pieces that can agree with another piece are sorted, and of
   equal ones all but the earliest are repeated.

Both sorts are the same job: a task sorts its strings (of equal ones only the earliest
goes on), cuts the sorted run at splitters, and sends front-coded parts: the length of the
prefix shared with the string before, and the rest. The task of a range merges its runs
with a loser tree that keeps, for every string in it, the prefix it is known to share
with the last one that left, and compares only what lies behind.

Pieces whose anchor occurs once leave before the first sort: all anchors are counted by
48-bit hashes, and a Bloom filter (BLOOM_MAX_BYTES at most) of those that occur again is
sent to the tasks. It only narrows; strings decide.

Defined results: a null or empty text has no bytes; null ids come after all others;
texts of one id are ordered by hash; rows that agree in id and text are one document and
each get its result; columns other than the key and the text are not read and may have
any name; an empty table gives no rows. What is kept may end inside a character: it is
bytes, not text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import pack, unpack
from .util import bloom_hits, bloom_of, cut, drop, partitions, runs, scratch, settle

SPAN = 100
#: Starts of strings that a task hashes at a time.
BLOCK = 1 << 19
#: Anchors, and strings, that a task gathers before it sends them on.
GATHER, RUN = 400_000, 150_000
#: Pieces of one anchor that are held against each other.
SMALL = 16
#: Sampled strings for each range; they choose the splitters and change no result.
SAMPLED = 100
#: Bytes of a splitter.
SPLITTER = 48
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACE, _LEAST = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
_KEY = [("d", "<i8"), ("h", "<i8"), ("at", "<i8")]


def gram_of(span: int) -> int:
    """Length of the grams that anchor strings of ``span`` bytes."""
    return max(1, 12 * span // 25)


# -- anchors ------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at every place, from hashes of runs of doubling length."""
    n = len(raw) - gram + 1
    with np.errstate(over="ignore"):
        run, power, size = _BYTES[raw], _MIX[0], 1
        out, done = np.zeros(n, dtype=np.uint64), 0
        while True:
            if gram & size:
                out = out * power + run[done : done + n]
                done += size
            if done == gram:
                break
            run, power, size = run[:-size] * power + run[size:], power * power, 2 * size
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return out


def pieces(raw: np.ndarray, valid: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, hash of the anchor) of the runs of valid starts
    whose strings have one anchor."""
    gram = gram_of(span)
    hashes = gram_hashes(raw, gram)
    least = (hashes & _LEAST) | np.arange(len(hashes), dtype=np.uint64)
    width, size = span - gram + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    anchor = (least & _PLACE).astype(np.int64)
    same = (anchor[1:] == anchor[:-1]) & valid[1:] & valid[:-1]
    first = np.flatnonzero(valid & np.r_[True, ~same])
    last = np.flatnonzero(valid & np.r_[~same, True])
    return first, last, anchor[first], hashes[anchor[first]]


def _blocks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple]:
    """For blocks of the texts of (text, ...) batches: the bytes, the row of each place, the
    places of rows, and pieces, all counted from the block's beginning."""
    for batch in batches:
        texts = batch.column(0).fill_null("").cast(pa.binary())
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[-1] - offsets[0] < span:
            continue
        raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        for start in range(0, len(raw) - span + 1, BLOCK):
            part = raw[start : start + BLOCK + span - 1]
            where = np.arange(start, start + len(part) - span + 1)
            row = np.searchsorted(offsets, where, side="right") - 1
            valid = where + span <= offsets[row + 1]
            first, last, anchor, hashes = pieces(part, valid, span)
            yield batch, part, row[first], start - offsets[row[first]], first, last, anchor, hashes


def _codes(hashes: np.ndarray) -> np.ndarray:
    """48 bits of an anchor's hash, mixed again: anchors are chosen for small hashes."""
    with np.errstate(over="ignore"):
        return (hashes * _MIX[2]) >> np.uint64(16)


def _repeated_anchors(docs: DataFrame, span: int) -> DataFrame:
    """(code): anchors that occur more than once."""
    parts = partitions(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            held.clear()
            codes = codes[np.r_[True, True, codes[2:] != codes[:-2]][: len(codes)]]  # two of a code say enough
            part = (codes * np.uint64(parts) >> np.uint64(48)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            return pa.RecordBatch.from_pydict({"p": part[at].astype(np.int32), "codes": [pack(c) for c in np.split(codes, at[1:])]})

        for *_, hashes in _blocks(batches, span):
            if len(hashes):
                held.append(_codes(hashes))
            if sum(map(len, held)) > GATHER:
                yield out()
        if held:
            yield out()
        settle()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            codes = np.sort(np.concatenate([unpack(raw) for (raw,) in rows]))
            again = np.unique(codes[1:][codes[1:] == codes[:-1]]).astype(np.int64)
            for at in range(0, len(again), 10_000):
                yield pa.RecordBatch.from_pydict({"code": again[at : at + 10_000]})
        settle()

    dealt = docs.select("text").mapInArrow(emit, "p int, codes binary").repartition(parts, "p").sortWithinPartitions("p")
    return cut(dealt.mapInArrow(count, "code long"), "anchors")


# -- sorted runs ---------------------------------------------------------------------


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before (0 at the first)."""
    sizes = np.array([len(s) for s in strings])
    width = int(sizes.max())
    table = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), dtype=np.uint8).reshape(len(strings), width)
    differ = table[1:] != table[:-1]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.r_[0, np.minimum(at, np.minimum(sizes[1:], sizes[:-1]))]


_RUN = "p int, prefix binary, size binary, rest binary, keys binary, more binary"


def _sent(p: int, strings: list[bytes], shared: np.ndarray, keys: np.ndarray, more: np.ndarray) -> tuple:
    """A front-coded part of a sorted run; its first string stands whole."""
    shared = shared.copy()
    shared[0] = 0
    rest = [s[k:] for s, k in zip(strings, shared.tolist())]
    planes = np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), -1).T).tobytes()  # by byte planes: high ones are mostly zero
    return p, shared.astype("<u2").tobytes(), np.array([len(r) for r in rest], dtype="<u2").tobytes(), b"".join(rest), planes, more.astype("<u2").tobytes()


def _received(shared: bytes, sizes: bytes, rest: bytes, keys: bytes, more: bytes) -> Iterator[tuple]:
    """(shared prefix, string, key, more) of a part, one at a time."""
    n = len(shared) // 2
    table = np.ascontiguousarray(np.frombuffer(keys, dtype=np.uint8).reshape(-1, n).T).view(_KEY).ravel()
    before, at = b"", 0
    for k, size, key, extra in zip(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist(), table.tolist(), np.frombuffer(more, "<u2").tolist()):
        before = before[:k] + rest[at : at + size]
        at += size
        yield k, before, key, extra


class Runs:
    """Gathers a task's strings, each with a key (document, its hash, place) and how many of its
    starts it stands for; hands out sorted, front-coded parts for the ranges between ``splitters``,
    and the spans of strings that are not the task's earliest."""

    def __init__(self, splitters: list[bytes]) -> None:
        self.splitters = splitters
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.strings: list[bytes] = []
        self.keys: list[np.ndarray] = []
        self.more: list[np.ndarray] = []
        self.length: list[np.ndarray] = []

    def add(self, strings: list[bytes], d, h, at, more, length) -> None:
        keys = np.empty(len(strings), dtype=_KEY)
        keys["d"], keys["h"], keys["at"] = d, h, at
        self.strings += strings
        self.keys.append(keys)
        self.more.append(np.asarray(more))
        self.length.append(np.asarray(length))
        self.size += len(strings)

    def flush(self) -> pa.RecordBatch:
        """One batch of parts, p being the range; of spans (document, hash, start, end) where p is -1."""
        rows = []
        if self.size:
            keys, more, length = np.concatenate(self.keys), np.concatenate(self.more), np.concatenate(self.length)
            order = np.lexsort((keys["at"], keys["h"], keys["d"])).tolist()
            order.sort(key=self.strings.__getitem__)  # stable: equal strings stay in the order of their keys
            strings, order = [self.strings[i] for i in order], np.array(order)
            keys, more, length = keys[order], more[order], length[order]
            shared = shared_prefixes(strings)
            sizes = np.array([len(s) for s in strings])
            again = (shared == sizes) & np.r_[False, sizes[1:] == sizes[:-1]]
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            later = again & (keys != keys[head])  # rows of one document are not repeats of each other
            if later.any():
                rows.append((-1, None, None, None, joined_spans(keys[later], length[later]).tobytes(), None))
            kept = np.flatnonzero(~again)
            strings, keys, more, shared = [strings[i] for i in kept.tolist()], keys[kept], more[kept], shared[kept]
            ends = [*(bisect.bisect_left(strings, s) for s in self.splitters), len(strings)]
            start = 0
            for p, end in enumerate(ends):
                if end > start:
                    rows.append(_sent(p, strings[start:end], shared[start:end], keys[start:end], more[start:end]))
                    start = end
        self.clear()
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[f.split()[0] for f in _RUN.split(", ")])


_SPAN = [("d", "<i8"), ("h", "<i8"), ("lo", "<i8"), ("hi", "<i8")]


def joined_spans(keys: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(document, hash, start, end) of spans, those that touch joined to one."""
    order = np.lexsort((keys["at"], keys["h"], keys["d"]))
    keys, end = keys[order], (keys["at"] + length)[order]
    out = np.empty(len(keys), dtype=_SPAN)
    out["d"], out["h"], out["lo"], out["hi"] = keys["d"], keys["h"], keys["at"], end
    fresh = np.r_[True, (keys["d"][1:] != keys["d"][:-1]) | (keys["h"][1:] != keys["h"][:-1]) | (keys["at"][1:] > end[:-1])]
    out = out[fresh]
    out["hi"] = np.maximum.reduceat(end, np.flatnonzero(fresh))
    return out


# -- merging ---------------------------------------------------------------------------


def merged(parts: list[Iterator[tuple]]) -> Iterator[tuple]:
    """(prefix shared with the string before, string, key, more) of sorted runs in order; equal strings by key.

    A loser tree: ``known[i]`` is the prefix that run i's first string shares with the
    last one that left the tree, or with the winner it lost to. Of two strings the one
    that shares more is smaller; only where both share as much are bytes compared, from there on.
    """
    leaves = 1
    while leaves < len(parts):
        leaves *= 2
    heads: list = [next(p, None) for p in parts] + [None] * (leaves - len(parts))
    known = [-1 if x is None else 0 for x in heads]

    def beats(i: int, j: int) -> bool:
        """Whether i stands before j; the loser's known prefix is that with the winner."""
        k = known[i]
        if k != known[j]:
            return k > known[j]
        if k < 0:
            return True
        (_, a, key_a, _), (_, b, key_b, _) = heads[i], heads[j]
        a, b = a[k:], b[k:]
        if a == b:
            first = key_a <= key_b
            known[j if first else i] = k + len(a)
            return first
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        same = k + (n - (x.bit_length() + 7) // 8 if x else n)
        first = a < b
        known[j if first else i] = same
        return first

    losers = [0] * leaves
    winners = list(range(leaves))
    for level in [leaves >> s for s in range(1, leaves.bit_length())]:
        up = []
        for node in range(level):
            i, j = winners[2 * node], winners[2 * node + 1]
            first = beats(i, j)
            losers[level + node] = j if first else i
            up.append(i if first else j)
        winners = up
    best = winners[0]
    while known[best] >= 0:
        _, string, key, more = heads[best]
        yield known[best], string, key, more
        after = next(parts[best], None)
        heads[best] = after
        known[best] = -1 if after is None else after[0]
        node = (leaves + best) >> 1
        while node:
            other = losers[node]
            k, l = known[best], known[other]
            if (k < l) if k != l else not beats(best, other):
                losers[node], best = best, other
            node >>= 1


_FOUND = "d long, h long, lo long, hi long, piece binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])


def _spans_of(raw: bytes) -> Iterator[pa.RecordBatch]:
    spans = np.frombuffer(raw, dtype=_SPAN)
    for at in range(0, len(spans), 10_000):
        part = spans[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([*(pa.array(part[c]) for c in ("d", "h", "lo", "hi")), pa.nulls(len(part), pa.binary())], names=[f.split()[0] for f in _FOUND.split(", ")])


def _merge(settled: Callable[[Iterator[tuple]], Iterator[tuple]]):
    """Rows of _FOUND from the parts of every range; ``settled`` reads a range's merged strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p,), rows in runs(batches):
            if p < 0:
                for row in rows:
                    yield from _spans_of(row[3])
                continue
            rows, made = [_received(*row) for row in rows], []
            for found in settled(merged(rows)):
                made.append(found)
                if len(made) == 10_000:
                    yield _found(made)
                    made = []
            yield _found(made)
        settle()

    return run


def common_end(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at their ends."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return ((x & -x).bit_length() - 1) // 8 if x else n


def _pieces_settled(span: int):
    """Later copies of a piece as spans; of its first one the strings that another piece may hold.

    Pieces of one anchor stand together, each sharing with the next at least the anchor. Of up to SMALL of them
    every two are held against each other, which leaves the strings that they have in common. In larger groups, and at the ends of a range,
    where others may stand outside, the prefix shared with the neighbours bounds them.
    """
    gram = gram_of(span)

    def run(strings: Iterator[tuple]) -> Iterator[tuple]:
        group: list[tuple] = []  # distinct pieces of one anchor: (string, key, bytes before the anchor, prefix shared with the piece before)
        inside = False  # whether the group begins inside the range
        small = True
        for shared, string, key, left in strings:
            if group and shared == len(string):
                if key != group[-1][1]:
                    yield (*key, key[2] + len(string) - 2, None)
                continue
            if group and shared < gram:
                yield from by_pairs(group) if small and inside else by_neighbours(group, 0)
                group, inside, small = [], True, True
            elif len(group) == SMALL or group and not small:
                # Too many: all but the last leave; the last waits for its next neighbour.
                small = False
                yield from by_neighbours(group, shared, 1)
                group = group[-1:]
            group.append((string, key, left, shared if group or inside else span))
        yield from by_neighbours(group, span)

    def by_neighbours(group: list[tuple], after: int, waiting: int = 0) -> Iterator[tuple]:
        """``after``: the prefix that the last piece shares with what comes behind."""
        behind = [x[3] for x in group[1:]] + [after]
        for (string, key, left, before), next_ in zip(group[: len(group) - waiting], behind):
            right = min(len(string) - left - 2, max(before, next_))
            if left + right >= span:
                yield open_strings(string, key, left, span - right, left)

    def by_pairs(group: list[tuple]) -> Iterator[tuple]:
        if len(group) == 1:
            return
        rights = [len(s) - left - 2 for s, _, left, _ in group]
        lefts = [s[r + 1 : -1] for (s, *_), r in zip(group, rights)]
        low, high = [span] * len(group), [-1] * len(group)
        for i in range(len(group)):
            reach = span
            for j in range(i + 1, len(group)):
                reach = min(reach, group[j][3], rights[i], rights[j])
                if reach + min(len(lefts[i]), len(lefts[j])) < span:
                    continue
                end = common_end(lefts[i], lefts[j])
                if reach + end >= span:
                    for k in (i, j):
                        low[k], high[k] = min(low[k], span - reach), max(high[k], end)
        for (string, key, left, _), a, b in zip(group, low, high):
            if b >= a:
                yield open_strings(string, key, left, a, b)

    def open_strings(string: bytes, key: tuple, left: int, low: int, high: int) -> tuple:
        """The strings that begin ``low`` to ``high`` bytes before the anchor, as the bytes that they cover."""
        right = len(string) - left - 2
        before = string[right + 1 : -1]
        return (*key[:2], key[2] + left - high, None, before[left - high :] + string[: span - low])

    return run


def _strings_settled(span: int):
    def run(strings: Iterator[tuple]) -> Iterator[tuple]:
        head = None
        for shared, _, key, _ in strings:
            if shared < span:
                head = key
            elif key != head:
                yield (*key, key[2] + span, None)

    return run


# -- the two sorts ---------------------------------------------------------------------


def _piece_strings(bits, span: int):
    """Batches (text, d, h) to (strings, d, h, starts, bytes before the anchor, bytes covered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch, part, row, shift, first, last, anchor, hashes in _blocks(batches, span):
            hit = bloom_hits(bits.value, _codes(hashes))
            first, last, anchor, row = first[hit], last[hit], anchor[hit], row[hit]
            raw = part.tobytes()
            strings = [raw[a : z + span] + b"\xff" + raw[f:a] + b"\xff" for f, z, a in zip(first.tolist(), last.tolist(), anchor.tolist())]
            d, h = (batch.column(c).to_numpy()[row] for c in (1, 2))
            yield strings, d, h, first + shift[hit], anchor - first, last - first + span

    return run


def _open_strings(span: int):
    """Batches (piece, d, h, lo) to all strings of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            raws = batch.column(0).to_pylist()
            n = np.array([len(r) - span + 1 for r in raws])
            row = np.repeat(np.arange(len(raws)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            strings = [r[k : k + span] for r, size in zip(raws, n.tolist()) for k in range(size)]
            d, h, lo = (batch.column(c).to_numpy()[row] for c in (1, 2, 3))
            yield strings, d, h, lo + step, np.zeros(len(row), dtype=np.int64), np.full(len(row), span)

    return run


def _splitters(rows: DataFrame, strings_of, n: int) -> list[bytes]:
    """At most ``n`` - 1 strings that cut a sample of the strings evenly."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings, *_ in strings_of(batches):
            heads = [s[:SPLITTER] for s in strings[::7]]
            yield pa.RecordBatch.from_pydict({"s": pa.array(heads, pa.binary())})
        settle()

    picked = rows.mapInArrow(sample, "s binary").orderBy(F.rand(13)).limit(SAMPLED * n).toArrow().column(0).to_pylist()
    picked.sort()
    return sorted({picked[len(picked) * k // n] for k in range(1, n)}) if picked else []


def _sorted(rows: DataFrame, strings_of, sample: float, settled) -> DataFrame:
    """_FOUND of the strings that ``strings_of`` makes of the rows, sorted over all of them."""
    n = partitions(rows.sparkSession)
    splitters = _splitters(rows.sample(sample, 13) if sample < 1 else rows, strings_of, n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Runs(splitters)
        for made in strings_of(batches):
            own.add(*made)
            if own.size >= RUN:
                yield own.flush()
        yield own.flush()
        settle()

    # A range goes to the task of its number, spans to any.
    to = F.when(F.col("p") >= 0, F.col("p")).otherwise(F.pmod(F.xxhash64("keys"), F.lit(n)).cast("int"))
    dealt = rows.mapInArrow(send, _RUN).repartitionById(n, to).sortWithinPartitions("p")
    return dealt.mapInArrow(_merge(settled), _FOUND)


def _keyed(key: str, text: str) -> list[Column]:
    """text, d and h: null ids after all others, texts by hash."""
    return [
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("d"),
        F.xxhash64(F.col(text)).alias("h"),
    ]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(d, h, spans): for every document with repeated strings (named by its id and the hash
    of its text) the spans that they cover, which may overlap. Written to the shared folder."""
    if not 2 <= span <= 20_000:
        raise ValueError("span must be between 2 and 20000 bytes")
    rows = docs.select(*_keyed(key, text))
    n = partitions(docs.sparkSession)
    with scratch() as kept:
        bits = bloom_of(anchors := _repeated_anchors(rows, span), "code")
        drop(anchors)
        share = 20.0 * n / max(1, rows.count())
        found = cut(_sorted(rows, _piece_strings(bits, span), share, _pieces_settled(span)), "pieces")
        bits.unpersist()
        open_ = found.filter("piece is not null").select("piece", "d", "h", "lo")
        share = 50.0 * n / max(1, open_.count())
        again = _sorted(open_, _open_strings(span), share, _strings_settled(span))
        spans = found.filter("piece is null").unionByName(again).groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        return kept(cut(spans, "spans"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs, ends exclusive) and kept (the remaining
    bytes; with ``digest`` kept_sha256 in their place) for every row of ``docs``."""
    found = repeated_spans(docs, key, text, span)
    rows = docs.select(F.col(key).alias("doc_id"), *_keyed(key, text))
    last = "kept_sha256 string" if digest else "kept binary"
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, t, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = t.encode()
                gone = union([(s["lo"], s["hi"]) for s in spans or ()])
                starts, ends = [0, *(hi for _, hi in gone)], [*(lo for lo, _ in gone), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(starts, ends)])
                shown = [{"lo": a, "hi": b} for a, b in gone]
                made.append((k, len(raw), len(raw) - len(kept), shown, hashlib.sha256(kept).hexdigest() if digest else kept))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], t) for c, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", last.split()[0]])
        settle()

    whole = rows.join(found, ["d", "h"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, {last}")
