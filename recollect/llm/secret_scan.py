"""Secret scan: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton finds keywords in one pass over the ASCII-lower-cased
text. Only at a hit is the kind's regular expression tried, anchored there, from
left to right and never inside an earlier match of its kind: the same matches as
a leftmost, non-overlapping search of the whole text. Long hexadecimal runs have
no keyword; one character-class search finds them. Kinds with an embedded
checksum or structure count only if it is right; a match that fails hides no later one.
What such matches have in common (the run a token stands in, the lines after a header) is
read once, so that time stays linear in the text.

Defined results: a null or empty text has no spans; spans of unlike kinds may
overlap; offsets are code points, end exclusive; repeated rows are scanned each; an
empty table gives no rows; other columns pass through, and a named one called
secret_spans is refused with ValueError.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .util import free, settle, slices, unlike

#: Kinds in the order used for spans that start together; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM_LABEL = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----")
PEM_NAME = re.compile(r"\s*+[A-Za-z][A-Za-z0-9-]*+:")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]++")
LINE = re.compile(r"[^\r\n]*+")
SPACE = re.compile(r"[ \t\n\r]*+")
OPENSSH = b"openssh-key-v1\0"
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "jwt": ["eyj"],
    "pem": ["-----begin "],
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def crc_base62(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def _checked_token(m: re.Match) -> bool:
    return crc_base62(m[1][:30]) == m[1][30:]


class Pattern:
    """Matches of one expression, anchored at a place."""

    def __init__(self, text: str, pattern: re.Pattern, accepts) -> None:
        self.text, self.pattern, self.accepts = text, pattern, accepts

    def at(self, place: int) -> tuple[int, bool] | None:
        """(end, accepted) of the match that starts here."""
        m = self.pattern.match(self.text, place)
        return (m.end(), self.accepts(m)) if m else None


class Jwt:
    """Three runs of token characters with dots between; the first two start with eyJ and hold a JSON object in base64.

    A run is measured once, whatever starts inside it are tried. Starts of one
    remainder by four are suffixes of one decoded text, which is made once as well.
    """

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end, self.last = text, 0, 0, None
        self.decoded: dict[int, tuple] = {}

    def _run(self, place: int) -> int | None:
        """End of the run of token characters at a place that starts with eyJ and goes on."""
        return TOKEN_RUN.match(self.text, place).end() if self.text.startswith("eyJ", place) else None

    def _measure(self, place: int) -> None:
        self.start, self.end, self.last = place, TOKEN_RUN.match(self.text, place).end(), None
        self.decoded = {}
        if self.text.startswith(".", self.end) and (second := self._run(self.end + 1)) and second > self.end + 4:
            m = TOKEN_RUN.match(self.text, second + 1) if self.text.startswith(".", second) else None
            if m:
                body = Decoded(self.text[self.end + 1 : second])
                self.last = m.end(), body.holds_object(0)

    def at(self, place: int) -> tuple[int, bool] | None:
        if not self.start <= place < self.end:
            self._measure(place)
        if self.last is None or self.end - place < 4:
            return None
        end, fine = self.last
        if not fine:
            return end, False
        kind = (self.end - place) % 4
        if kind not in self.decoded:
            self.decoded[kind] = place, Decoded(self.text[place : self.end])
        first, text = self.decoded[kind]
        return end, text.holds_object((place - first) // 4 * 3)


class Decoded:
    """Base64 of a run, read as UTF-8, and whether a JSON object is all that stands from a byte on."""

    def __init__(self, run: str) -> None:
        try:
            raw = base64.urlsafe_b64decode(run + "=" * (-len(run) % 4))
        except binascii.Error:
            raw = None
        self.text = raw.decode("utf-8", "surrogateescape") if raw is not None else None
        self.starts = None
        if raw is not None and not raw.isascii():
            sizes = np.fromiter((1 if "\ud800" <= c <= "\udfff" else len(c.encode()) for c in self.text), dtype=np.int64, count=len(self.text))
            self.starts = np.cumsum(sizes) - sizes
        self.bad = max((i for i, c in enumerate(self.text) if "\udc80" <= c <= "\udcff"), default=-1) if self.starts is not None else -1

    def holds_object(self, byte: int) -> bool:
        if self.text is None:
            return False
        at = byte if self.starts is None else int(np.searchsorted(self.starts, byte))
        if at <= self.bad or not self.text.startswith("{", at):
            return False
        try:
            _, end = _JSON.raw_decode(self.text, at)
        except (ValueError, RecursionError):
            return False
        return SPACE.match(self.text, end).end() == len(self.text)


_JSON = json.JSONDecoder()


class Pem:
    """A labelled block: headers, a base64 body and the end of the same label.

    The body decodes to one DER sequence of exactly the stated length, or starts with OpenSSH's magic, or is said to be encrypted by the
    headers. Headers reach to the end of their line, which other blocks may start in: what
    follows a line is read once.
    """

    def __init__(self, text: str) -> None:
        self.text, self.line = text, (0, -1, -1)
        self.after: dict[int, tuple[int, bool]] = {}
        self.bodies: dict[int, tuple[int, bool, bool]] = {}

    def _line(self, place: int) -> tuple[int, int]:
        """(end of the line, last place in it that says the key is encrypted) for a place in it."""
        start, end, said = self.line
        if not start <= place <= end:
            end = LINE.match(self.text, place).end()
            said = max(self.text.rfind(word, place, end) for word in ("DEK-Info:", "ENCRYPTED"))
            self.line = place, end, said
        return end, said

    def _headers(self, place: int) -> tuple[int, bool]:
        """(end of the headers that begin here, whether one says that the key is encrypted)."""
        seen: list[tuple[int, bool]] = []
        while place not in self.after:
            m = PEM_NAME.match(self.text, place)
            if not m:
                self.after[place] = place, False
                break
            end, said = self._line(m.end())
            name = self.text[place : m.end()]
            seen.append((place, said >= m.end() or "DEK-Info:" in name or "ENCRYPTED" in name))
            place = end
        end, said = self.after[place]
        for start, own in reversed(seen):
            said = said or own
            self.after[start] = end, said
        return end, said

    def _body(self, place: int) -> tuple[int, bool, bool]:
        """(end of the body, whether it is a whole key, whether it is base64 at all)."""
        if place not in self.bodies:
            m = PEM_BODY.match(self.text, place)
            self.bodies[place] = (m.end(), *_key(m[0])) if m else (-1, False, False)
        return self.bodies[place]

    def at(self, place: int) -> tuple[int, bool] | None:
        label = PEM_LABEL.match(self.text, place)
        if not label:
            return None
        start, encrypted = self._headers(label.end())
        end, whole, coded = self._body(start)
        tail = f"-----END {label[1]}-----"
        if end < 0 or not self.text.startswith(tail, end):
            return None
        return end + len(tail), whole or coded and encrypted


def _key(body: str) -> tuple[bool, bool]:
    """Whether a body is an unencrypted key, and whether it is base64 of something."""
    try:
        der = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False, False
    if der.startswith(OPENSSH):
        return True, True
    if len(der) < 2 or der[0] != 0x30:
        return False, bool(der)
    if der[1] < 0x80:
        return len(der) == 2 + der[1], True
    n = der[1] & 0x7F
    return 0 < n <= 8 and len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big"), True


#: kind -> what finds its matches in a text
FINDERS = {
    "assign": lambda text: Pattern(text, ASSIGN, lambda m: len(m[1]) >= 6),
    "access": lambda text: Pattern(text, ACCESS, lambda m: m.end() - m.start() >= 20),
    "github": lambda text: Pattern(text, GITHUB, _checked_token),
    "npm": lambda text: Pattern(text, NPM, _checked_token),
    "jwt": Jwt,
    "pem": Pem,
}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        built = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                built.add_word(word, (kind, len(word)))
        built.make_automaton()
        _automaton = built
    return _automaton


def lowered(text: str) -> str:
    """A-Z lower-cased, every other character kept, so that offsets stay."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then by kind as listed."""
    if not text:
        return []
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (kind, length) in automaton().iter(lowered(text)):
        hits.setdefault(kind, []).append(end - length + 1)
    for kind, starts in hits.items():
        finder, done = FINDERS[kind](text), 0
        for at in sorted(starts):
            if at >= done and (found := finder.at(at)):
                end, accepted = found
                if accepted or kind in BASE:
                    done = end
                if accepted:
                    spans.append((kind, at, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, with secret_spans."""
    unlike(keep, ("secret_spans",))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("secret_spans", SPAN)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, name):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py())] for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, kind)], names=[*keep, "secret_spans"])
        settle()

    name = free("text", docs.select(*keep))
    return docs.select(*keep, docs[text].alias(name)).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that touch or overlap are one."""

    def clean(value: str | None) -> str | None:
        spans = find(value)
        if not spans:
            return value
        out, at, k = [], 0, 0
        while k < len(spans):
            start, end = spans[k][1:]
            while k < len(spans) and spans[k][1] <= end:
                end = max(end, spans[k][2])
                k += 1
            out += [value[at:start], mark]
            at = end
        return "".join([*out, value[at:]])

    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns = list(batch.columns)
            columns[where] = pa.array([clean(t.as_py()) for t in columns[where]], columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        settle()

    return docs.mapInArrow(run, docs.schema)
