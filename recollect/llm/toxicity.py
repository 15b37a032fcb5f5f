"""Toxicity scores: a lexicon trie met by Levenshtein automata, and context windows.

Learning takes a bounded sample of labelled rows (SAMPLE, the smallest hashes of
doc_id): the words and word stems that toxic rows hold far more often than
chance (binomial tail, corrected for the number tried) join a short seed list.
Every entry has an edit budget by its length. The trie of entries and the
automaton of words within those budgets are intersected and determinised as
texts ask for it, so that a misspelt entry is found in one walk over the word.

Around each hit a window of WINDOW words on either side is read: a pair of quotation
marks in it that encloses the hit, and words of reporting, make it a quotation,
otherwise it is abuse. Marks are paired over the whole text, each kind for itself:
a mark that was closed before a hit does not enclose it, and an apostrophe between
letters is no mark. A logistic model over the two sums of evidence gives the score.

Defined results: null and empty texts get the score of a text without hits;
every row is scored, repeated rows alike; of labelled rows that repeat a doc_id the
first text in order is learned from; without labelled rows of both kinds the model
keeps its prior weights; an empty table gives no rows; other columns pass through
where they are named, and one named score, abuse or quoted is refused with
ValueError. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import free, settle, slices, unlike

#: Most labelled rows that learning reads; all other counts cover every document.
SAMPLE = 5000
#: Most characters of them together.
SAMPLE_CHARS = 100_000_000
WINDOW = 6
#: Share of a hit's weight that is left for each edit.
PER_EDIT = 0.5
#: Words, and states of the automaton, that a worker remembers.
KNOWN, STATES = 150_000, 50_000
OUTPUT = ("score", "abuse", "quoted")
# General terms of insult that are known before any label is seen.
SEED = """
idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb imbecile scumbag
idiota estúpido imbécil basura
idiot idiotin dummkopf abschaum
crétin abruti ordure
""".split()
REPORTING = set(
    "said says wrote writes called calls quote quoted quotes reported sagte schrieb nannte zitat dit écrit appelle cite dijo escribió llamó cita".split(),
)
MARKS = re.compile("[\"“”„«»‘’]")
WORD = re.compile(r"[^\W_]+")
PRIOR = np.array([-3.0, 4.0, 1.0, 1.0])


def budget(word: str) -> int:
    """Edits allowed for an entry: none up to 4 letters, 1 up to 7, then 2."""
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


class Automaton:
    """Words within the edit budgets of a lexicon, determinised on demand.

    A state is a set of (trie node, edits so far). Reading a letter follows the
    trie, replaces, inserts, or (between letters) skips a trie letter. A branch
    dies when its edits pass every budget below its node.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.room = [0]
        self.entries = [*words, *stems]
        self.budgets = [budget(w) for w in words] + [0] * len(stems)
        for k, entry in enumerate(self.entries):
            node = 0
            self.room[0] = max(self.room[0], self.budgets[k])
            for letter in entry:
                if letter not in self.children[node]:
                    self.children.append({})
                    self.room.append(0)
                    self.children[node][letter] = len(self.children) - 1
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], self.budgets[k])
            (self.word_at if k < len(words) else self.stem_at)[node] = k
        self.forget()

    def forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, branches: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        open_ = [(n, e) for n, e in branches if e <= self.room[n]]
        while open_:
            node, edits = open_.pop()
            if least.get(node, 99) <= edits:
                continue
            least[node] = edits
            open_ += [(child, edits + 1) for child in self.children[node].values() if edits + 1 <= self.room[child]]
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.word_at[n]) for n, e in key if n in self.word_at and e <= self.budgets[self.word_at[n]]]
            self.accepts.append(min(ends) if ends else None)
            self.stems.append(min((self.stem_at[n] for n, e in key if e == 0 and n in self.stem_at), default=None))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            after.add((node, edits + 1))
            for seen, child in self.children[node].items():
                after.add((child, edits + (seen != letter)))
        return self._state(after)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry, or None."""
        if len(self.sets) > STATES:
            self.forget()
        state, stem, moves, sets = self.start, None, self.moves, self.sets
        for letter in word:
            now = moves[state].get(letter)
            if now is None:
                now = moves[state][letter] = self._move(state, letter)
            state = now
            if stem is None:
                stem = self.stems[state]
            if not sets[state]:
                break
        found = self.accepts[state] if sets[state] else None
        if stem is not None and (found is None or found[0] > 0):
            return (0, stem)
        return found


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    worth: list[float]
    innocent: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.words, self.stems)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def __getstate__(self):
        return (self.words, self.stems, self.worth, self.innocent, self.weights)

    def __setstate__(self, state):
        self.words, self.stems, self.worth, self.innocent, self.weights = state
        self.__post_init__()

    def entries(self) -> dict[str, float]:
        """What the lexicon holds, and its worth."""
        return dict(zip(self.words + self.stems, self.worth))

    def lookup(self, words: set[str]) -> set[str]:
        """The words that meet the lexicon; what was seen before is remembered."""
        if len(self.clean) + len(self.hits) > KNOWN:
            self.clean.clear()
            self.hits.clear()
        out = set()
        for word in words - self.clean:
            if word not in self.hits:
                found = self.automaton.match(word)
                if found is None or (found[0] and word in self.innocent):
                    self.clean.add(word)
                    continue
                self.hits[word] = found
            out.add(word)
        return out

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Sums over the hits read as abuse and over those read as quotation, and the strongest abuse."""
        if not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        found = self.lookup(set(WORD.findall(low)))
        if not found:
            return 0.0, 0.0, 0.0
        spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        opens, closes = quotations(low)
        abuse = quoted = strongest = 0.0
        for k, (word, start, end) in enumerate(spans):
            if word not in found:
                continue
            first, last = k - WINDOW - 1, k + WINDOW + 1
            left, right = spans[first][2] if first >= 0 else 0, spans[last][1] if last < len(spans) else len(low)
            near = {w for w, _, _ in spans[max(0, k - WINDOW) : k] + spans[k + 1 : last]}
            enclosed = any(end <= closes[i] < right for i in range(bisect_left(opens, left), bisect_left(opens, start)))
            edits, entry = self.hits[word]
            weight = self.worth[entry] * PER_EDIT**edits
            q = context(enclosed, bool(near & REPORTING))
            abuse += weight * (1 - q)
            quoted += weight * q
            strongest = max(strongest, weight * (1 - q))
        return abuse, quoted, strongest

    def score(self, abuse: float, quoted: float, strongest: float) -> float:
        z = float(features(abuse, quoted, strongest) @ self.weights)
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Where each closed quotation opens, ascending, and where it closes.

    A straight mark opens and closes in turn; a curly or angled one closes the latest open one of
    its kind. The German low mark is closed by either high one; an open mark that is followed
    by another of its kind is forgotten.
    """
    pairs: list[tuple[int, int]] = []
    open_: dict[str, int] = {}
    for m in MARKS.finditer(text):
        at, mark = m.start(), m.group()
        if mark == "’" and text[at - 1 : at].isalnum() and text[at + 1 : at + 2].isalnum():
            continue
        kinds = {'"': '"', "“": "„", "”": "“„", "»": "«", "’": "‘"}.get(mark, "")
        closed = next((k for k in kinds if k in open_), None)
        if closed:
            pairs.append((open_.pop(closed), at))
        elif mark in '"“„«‘':
            open_[mark] = at
    pairs.sort()
    return [a for a, _ in pairs], [b for _, b in pairs]


def context(enclosed: bool, reported: bool) -> float:
    """How far a hit reads as quotation, from 0 to 1."""
    return 0.8 if enclosed and reported else 0.6 if enclosed else 0.3 if reported else 0.0


def features(abuse: float, quoted: float, strongest: float) -> np.ndarray:
    return np.array([1.0, strongest, math.log1p(abuse), math.log1p(quoted)])


# -- learning -----------------------------------------------------------------


def _tail(n: int, k: int, p: float) -> float:
    """log P(X >= k), X ~ Binomial(n, p), bounded by its relative entropy."""
    share = k / n
    if share <= p:
        return 0.0
    gap = share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0)
    return -n * gap


def learn_lexicon(rows: list[tuple[str, int]], purity: float = 0.6) -> tuple[list[str], list[str], list[float], set[str]]:
    """Words and stems of toxic rows, what each is worth, and the words of clean rows.

    An entry's support is the number of different words that stand before it in
    toxic rows: copies of one text lend it no more than one of them would.
    """
    counts = (Counter(), Counter())
    stems = (Counter(), Counter())
    forms: dict[str, set[str]] = {}
    left: tuple[dict[str, set[str]], dict[str, set[str]]] = ({}, {})
    for text, toxic in rows:
        said = WORD.findall((text or "").lower())
        words = set(said)
        counts[toxic].update(words)
        stems[toxic].update({w[:n] for w in words for n in range(4, min(8, len(w)))})
        if toxic:
            for before, w in zip(["", *said], said):
                left[0].setdefault(w, set()).add(before)
                for n in range(4, min(8, len(w))):
                    left[1].setdefault(w[:n], set()).add(before)
                    forms.setdefault(w[:n], set()).add(w)
    total = len(rows)
    base = sum(t for _, t in rows) / total if total else 0.0
    picked: list[list[str]] = [[], []]
    if 0 < base < 1:
        for which, both in enumerate((counts, stems)):
            tried = max(1, sum(1 for w in both[1] if both[1][w] + both[0][w] >= 3))
            for entry, n in both[1].items():
                n = min(n, len(left[which][entry]))
                seen = n + both[0][entry]
                if n >= 3 and n >= purity * seen and len(entry) >= 3 and _tail(seen, n, base) + math.log(tried) < math.log(0.05):
                    picked[which].append(entry)
    stem_set = {s for s in picked[1] if len(forms.get(s, ())) >= 4}
    kept = sorted(s for s in stem_set if not any(s[:n] in stem_set for n in range(4, len(s))))
    words = sorted(w for w in {*SEED, *picked[0]} if not any(w.startswith(s) for s in kept))
    clean = {w for w, n in counts[0].items() if n > counts[1][w]}

    def worth(which: int, entry: str) -> float:
        """Log odds of an entry's support, from 0.2 to 1; 0.7 for a seed never seen."""
        pro, con = len(left[which].get(entry, ())), (counts, stems)[which][0][entry]
        return min(max(math.log((pro + 0.5) / (con + 0.5)) / 4, 0.2), 1.0) if pro + con else 0.7

    return words, kept, [worth(0, w) for w in words] + [worth(1, s) for s in kept], clean


def fit(rows: list[tuple[str, int]], rounds: int = 25) -> Model:
    """Lexicon, then logistic weights by Newton steps with a ridge towards the prior."""
    words, stems, worth, clean = learn_lexicon(rows)
    automaton = Automaton(words, stems)
    innocent = {w for w in clean if (found := automaton.match(w)) and found[0] > 0}
    model = Model(words, stems, worth, innocent)
    if not rows:
        return model
    x = np.array([features(*model.evidence(t)) for t, _ in rows])
    y = np.array([float(t) for _, t in rows])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = np.array([w[0], max(w[1], 0.0), max(w[2], 0.0), w[3]])
    return model


def held_out(key: str) -> Column:
    """The fifth that learning never sees (a null key counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows outside the held-out fifth."""
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    marked = marked.groupBy(key).agg(F.max(label).alias("mark")).orderBy(F.xxhash64(key), key).limit(sample)
    name, said = free("mark", docs), free("said", docs)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias(said)).join(F.broadcast(marked.withColumnRenamed("mark", name)), key)  # SAMPLE rows
    rows = rows.groupBy(key).agg(F.min(said).alias("text"), F.max(name).alias("toxic"))
    rows = rows.withColumn("upto", F.sum(F.length("text").cast("long")).over(Window.orderBy(F.xxhash64(key), key))).filter(F.col("upto") <= SAMPLE_CHARS)
    rows = sorted((r[key], r.text, int(r.toxic > 0)) for r in rows.collect())
    return fit([(t, y) for _, t, y in rows])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, with score, abuse and quoted."""
    unlike(keep, OUTPUT)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, said):
            seen = [model.evidence(t.as_py()) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:n],
                    pa.array([model.score(*e) for e in seen], pa.float64()),
                    pa.array([e[0] for e in seen], pa.float64()),
                    pa.array([e[1] for e in seen], pa.float64()),
                ],
                names=[*keep, *OUTPUT],
            )
        settle()

    said = free("text", docs.select(*keep))
    return docs.select(*keep, F.col(text).alias(said)).mapInArrow(run, f"{fields}, score double, abuse double, quoted double")


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            stays = [model.score(*model.evidence(t.as_py())) < threshold for t in batch.column(where)]
            yield batch.filter(pa.array(stays))
        settle()

    return docs.mapInArrow(run, docs.schema)
