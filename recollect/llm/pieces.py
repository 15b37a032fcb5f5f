"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score (ties: the
leftmost) and merges the best pair until none is left. No piece of such a
vocabulary has the space mark after another character, so that the chunks
between space marks are independent: each distinct chunk is encoded once per
task (a bounded memo). Long chunks use a heap; short ones are merged many at
a time, the best pair of every chunk in each round.

Each new chunk is checked against the sentencepiece library, as is one whole
text of each Arrow batch. A chunk that differed would take the library's ids,
and ``library_agrees`` would be false for the texts that hold it.

Defined results: null and empty texts have no ids and decode to the empty
string; texts are whole, of any length; repeated rows are encoded each; an empty
table gives no rows; columns named in ``keep`` pass through, and one named like an
output column (n_tokens, ids, decoded, library_agrees) is refused with ValueError.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import free, settle, slices, unlike

MARK = "▁"
SHORT = 48
#: Distinct chunks, and their characters, that a worker remembers.
MEMO, MEMO_CHARS = 100_000, 2_000_000
OUTPUT = ("n_tokens", "ids", "decoded", "library_agrees")
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int64(1 << 62)
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Slots(dict):
    """Chunk -> number, in the order in which chunks were first asked for."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


class Encoded:
    """Chunks of some texts: their numbers, where each text's begin, and the ids of all in a row."""

    def __init__(self, at: np.ndarray, cuts: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        self.at, self.cuts, self.ids, self.ends = at, cuts, ids, ends

    def of(self, k: int) -> np.ndarray:
        """The ids of one text."""
        return self.ids[self.ends[k] : self.ends[k + 1]]


def taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of a flat array, one behind the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class Pieces:
    """A BPE vocabulary with byte fallback, read through the library."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.size = sp.get_piece_size()
        plain = {}
        self.bytes_of = []
        self.byte_id = {}
        self.unknown = sp.unk_id()
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                plain[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece has a space mark inside; chunks are not independent")
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        #: Symbols are piece ids, or size + code point for characters without a piece.
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int32)
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        pairs = {}
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(plain, piece[:k]), self._symbol(plain, piece[k:])
                if left is not None and right is not None:
                    pairs[left << 21 | right] = (i, ranks[sp.get_score(i)])
        self.pairs = pairs
        self._build_table()
        #: The bytes of all pieces in a row.
        self.piece_size = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=size)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.digits = [str(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        self.slots, self.chars, self.used = _Slots(), 0, 0
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.start, self.size_of = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64)
        #: Decimal ids by chunk, made where they are asked for.
        self.csv: list[str] = []
        #: Bytes of the ids by chunk, made where they are asked for.
        self.raw, self.raw_used = np.empty(1 << 18, dtype=np.uint8), 0
        self.raw_start, self.raw_size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        #: Chunks for which the library finds other ids.
        self.wrong: set[int] = set()

    def _symbol(self, plain: dict[str, int], text: str) -> int | None:
        return plain.get(text, self.size + ord(text) if len(text) == 1 else None)

    # -- pairs in flat arrays: open addressing, vectorised lookups

    def _build_table(self, bits: int = 19) -> None:
        self.shift = np.uint64(64 - bits)
        keys = np.array(list(self.pairs), dtype=np.int64)
        slots = self._slot(keys).tolist()
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_made = np.zeros(1 << bits, dtype=np.int64)
        self.slot_rank = np.zeros(1 << bits, dtype=np.int64)
        self.probes = 1
        for key, at in zip(keys.tolist(), slots):
            step = 1
            while self.slot_key[at] >= 0:
                at, step = (at + 1) & ((1 << bits) - 1), step + 1
            self.slot_key[at] = key
            self.slot_made[at], self.slot_rank[at] = self.pairs[key]
            self.probes = max(self.probes, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at = self._slot(keys)
        seen = self.slot_key[at]
        out = np.where(seen == keys, at, -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            near = (at[open_] + step) & (len(self.slot_key) - 1)
            seen = self.slot_key[near]
            hit = seen == keys[open_]
            out[open_[hit]] = near[hit]
            open_ = open_[~hit & (seen >= 0)]
        return out

    # -- one chunk, by a heap

    def merge(self, chunk: str) -> list[int]:
        """Symbols of one chunk; O(n log n)."""
        symbols = self.symbol[np.frombuffer(chunk.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0 and (hit := self.pairs.get(symbols[left] << 21 | symbols[right])):
                heapq.heappush(agenda, (hit[1], left, symbols[left], symbols[right]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, a, b = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] != a or right < 0 or symbols[right] != b:
                continue  # a symbol of this pair has merged since
            symbols[left] = self.pairs[a << 21 | b][0]
            symbols[right] = -1
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [s for s in symbols if s >= 0]

    # -- many chunks, a merge of each at a time

    def merge_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all chunks in a row, and how many each has."""
        symbols = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        done_symbols, done_owner = [], []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            slot = self._lookup(symbols[:-1] << 21 | symbols[1:])
            slot[first[1:] - 1] = -1
            hit = np.flatnonzero(slot >= 0)
            best = np.full(len(symbols), _NONE)
            best[hit] = self.slot_rank[slot[hit]] << 40 | hit
            least = np.minimum.reduceat(best, first)
            live = least < _NONE
            stays = np.repeat(live, np.diff(np.r_[first, len(symbols)]))
            if not live.all():
                done_symbols.append(symbols[~stays])
                done_owner.append(owner[~stays])
            where = least[live] & ((1 << 40) - 1)
            symbols[where] = self.slot_made[slot[where]]
            stays[where + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(owner, minlength=len(chunks))

    # -- ids

    def _ids(self, symbols) -> list[int]:
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                raw = chr(s - self.size).encode("utf-8", "surrogatepass")
                out += [self.byte_id[b] for b in raw] if self.byte_id else [self.unknown]
        return out

    def _theirs(self, words: list[str]) -> list[list[int]]:
        """The library puts the first mark itself."""
        out = self.library.encode(words, num_threads=1)
        return [ids if w else [self.library.piece_to_id(MARK)] for w, ids in zip(words, out)]

    def _store(self, slots: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.empty_like(self.flat)]
        while len(self.start) < len(self.slots):
            self.start, self.size_of = np.r_[self.start, self.start], np.r_[self.size_of, self.size_of]
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[slots], self.size_of[slots] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)

    def learn(self, words: list[str], first: int) -> None:
        """Encode new chunks, without their first mark, by the agenda; the library only tells whether it agrees."""
        chunks = [MARK + w for w in words]
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self.chars += int(sizes.sum())
        short = np.flatnonzero(sizes <= SHORT)
        symbols, counts = self.merge_many([chunks[i] for i in short] if len(short) < len(chunks) else chunks) if len(short) else (
            np.empty(0, dtype=np.int64),
            np.empty(0, dtype=np.int64),
        )
        strange = np.flatnonzero(symbols >= self.size)
        if len(strange):
            made = [self._ids([s]) for s in symbols[strange].tolist()]
            reps = np.ones(len(symbols), dtype=np.int64)
            reps[strange] = [len(m) for m in made]
            is_strange = np.zeros(len(symbols), dtype=bool)
            is_strange[strange] = True
            counts = np.add.reduceat(reps, np.cumsum(counts) - counts)
            symbols = np.repeat(symbols, reps)
            symbols[np.repeat(is_strange, reps)] = list(chain.from_iterable(made))
        self._store(first + short, symbols, counts)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            ids = self.merge(chunks[i])
            if max(ids) >= self.size:
                ids = self._ids(ids)
            self._store(np.array([first + i]), np.array(ids), np.array([len(ids)]))
        own = np.arange(first, first + len(words))
        theirs = self._theirs(words)
        lengths = np.fromiter(map(len, theirs), dtype=np.int64, count=len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), dtype=np.int32, count=int(lengths.sum()))
        mine = self.gather(own)
        if not (np.array_equal(lengths, self.size_of[own]) and np.array_equal(flat, mine)):
            self.wrong.update(first + i for i, ids in enumerate(theirs) if self.ids_of(first + i).tolist() != ids)

    def ids_of(self, slot: int) -> np.ndarray:
        return self.flat[self.start[slot] : self.start[slot] + self.size_of[slot]]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of many chunks in a row."""
        sizes = self.size_of[slots]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slots] - ends + sizes, sizes)]

    def text_of(self, ids: list[int]) -> str:
        """The characters of ids, with the leading space that the first mark stands for."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "each-byte")

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: without the space of the first piece."""
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") and self._strips(np.array(ids)) else text

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without its first mark."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> Encoded:
        if len(self.slots) > MEMO or self.chars > MEMO_CHARS:
            self.forget()
        split = [self.chunks(t) for t in texts]
        cuts = np.cumsum([0, *map(len, split)])
        before = len(self.slots)
        at = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(cuts[-1]))
        new = list(islice(reversed(self.slots), len(self.slots) - before))[::-1]
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000], before + k)
        ends = np.r_[0, np.cumsum(self.size_of[at])][cuts]
        return Encoded(at, cuts, self.gather(at), ends)

    def written(self, coded: Encoded) -> list[str]:
        """The ids of each text as decimals joined by commas."""
        new, digits = np.arange(len(self.csv), len(self.slots)), self.digits
        if len(new):
            decimals = [digits[i] for i in self.gather(new).tolist()]
            ends = np.r_[0, np.cumsum(self.size_of[new])].tolist()
            self.csv += [",".join(decimals[a:b]) for a, b in zip(ends, ends[1:])]
        csv, at = self.csv, coded.at.tolist()
        return [",".join([csv[k] for k in at[a:b]]) for a, b in zip(coded.cuts, coded.cuts[1:])]

    def marked(self, coded: Encoded, slots) -> np.ndarray:
        """Whether each text holds one of these chunks."""
        if not slots:
            return np.zeros(len(coded.cuts) - 1, dtype=bool)
        hits = np.r_[0, np.cumsum(np.isin(coded.at, list(slots)))][coded.cuts]
        return hits[1:] > hits[:-1]

    def shown(self, coded: Encoded) -> list[str]:
        """The decoded texts, from the ids alone: those of each chunk become bytes once."""
        new = np.arange(len(self.raw_size), len(self.slots))
        if len(new):
            ids, counts = self.gather(new), self.size_of[new]
            made = taken(self.piece_bytes, self.piece_start[ids], self.piece_size[ids])
            sizes = np.add.reduceat(self.piece_size[ids], np.cumsum(counts) - counts)
            while self.raw_used + len(made) > len(self.raw):
                self.raw = np.r_[self.raw, np.empty_like(self.raw)]
            self.raw[self.raw_used : self.raw_used + len(made)] = made
            self.raw_start = np.r_[self.raw_start, self.raw_used + np.cumsum(sizes) - sizes]
            self.raw_size = np.r_[self.raw_size, sizes]
            self.raw_used += len(made)
        sizes = self.raw_size[coded.at]
        whole = taken(self.raw, self.raw_start[coded.at], sizes).tobytes()
        ends, out = np.r_[0, np.cumsum(sizes)][coded.cuts].tolist(), []
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            text = whole[a:b].decode("utf-8", "each-byte")
            out.append(text[1:] if text.startswith(" ") and self._strips(coded.of(k)) else text)
        return out

    def _strips(self, ids: np.ndarray) -> bool:
        """Whether the library leaves out the space of the first piece that shows anything."""
        first = next((int(i) for i in ids if self.bytes_of[i]), None)
        return first is not None and first != self.unknown

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text or ""]).ids.tolist()


_loaded: dict[str, Pieces] = {}


def load(model: str) -> Pieces:
    """The vocabulary, read once a task."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encode_decode(docs: DataFrame, keep: list[str], model: str, text: str = "text", ids: str = "array") -> DataFrame:
    """The columns ``keep`` of each row, with n_tokens, ids, decoded and library_agrees.

    ``ids`` is "array" for array<int> or "csv" for decimal ids joined by commas.
    """
    unlike(keep, OUTPUT)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_tokens long, ids {'string' if ids == 'csv' else 'array<int>'}, decoded string, library_agrees boolean"
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in slices(batches, batch_text, 1 << 19):
            texts = [t or "" for t in batch.column(n).to_pylist()]
            made = pieces.encode_all(texts)
            shown = pieces.shown(made)
            agrees = ~pieces.marked(made, pieces.wrong)
            whole = made.of(0).tolist()
            agrees[0] &= whole == pieces.library.encode(texts[0]) and pieces.library.decode(whole) == shown[0]
            column = pa.array(pieces.written(made), pa.string()) if ids == "csv" else pa.ListArray.from_arrays(
                pa.array(made.ends, pa.int32()),
                pa.array(made.ids, pa.int32()),
            )
            columns = [pa.array(np.diff(made.ends), pa.int64()), column, pa.array(shown, pa.string()), pa.array(agrees, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*keep, *OUTPUT])
        del pieces
        _loaded.pop(model, None)  # the worker goes on to other work
        settle()

    batch_text = free("text", docs.select(*keep))
    return docs.select(*keep, F.col(text).alias(batch_text)).mapInArrow(run, schema)
