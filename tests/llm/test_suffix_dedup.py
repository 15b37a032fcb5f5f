"""Repeated passages against brute force; the loser tree against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import queries, suffix_dedup
from recollect.llm.util import tuned

SCHEMA = "doc_id long, text string"


def brute(rows, span):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of (doc_id, text) rows with unlike ids, in the order of ids."""
    seen, out = set(), []
    for k, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - span + 1):
            if raw[at : at + span] in seen:
                gone[at : at + span] = b"\1" * span
            seen.add(raw[at : at + span])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        n_spans = sum(g and not before for g, before in zip(gone, b"\0" + gone))
        out.append((k, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def spark_rows(spark, rows, span):
    made = suffix_dedup.remove_repeats(tuned(spark).createDataFrame(rows, SCHEMA), span=span, digest=True)
    got = made.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256").collect()
    return sorted([tuple(r) for r in got], key=lambda r: (r[0] is None, r[0]))


@pytest.mark.parametrize("alphabet,span,small", [("ab", 12, 16), ("ab", 12, 3), ("abcdé", 7, 16), ("xy z", 2, 4), ("a", 9, 16)])
def test_random_texts(spark, monkeypatch, alphabet, span, small):
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    monkeypatch.setattr(suffix_dedup, "RUN", 40)
    r = random.Random(span)
    rows = [(i * 3 % 61, "".join(r.choices(alphabet, k=r.randrange(60)))) for i in range(60)]
    rows = list({k: (k, t) for k, t in rows}.values()) + [(900, ""), (901, None), (None, rows[3][1] * 2)]
    assert spark_rows(spark, rows, span) == brute(rows, span)


def test_passages_copies_and_long_texts(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choices(words, k=n))

    passages = [prose(60) for _ in range(4)]
    rows = [(i, prose(r.randrange(3, 120))) for i in range(120)]
    rows += [(200 + i, prose(20) + passages[i % 4] + prose(20)) for i in range(80)]
    rows += [(400 + i, rows[5][1] if i % 2 else rows[121][1][: 200 + i] + "é" + rows[121][1][200 + i :]) for i in range(40)]
    rows += [(600, "ab" * 3000), (601, "\0" * 500), (602, passages[0] * 3), (603, prose(30_000))]
    assert spark_rows(spark, rows, suffix_dedup.SPAN) == brute(rows, suffix_dedup.SPAN)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(map(str, range(80)))
    docs = tuned(spark).createDataFrame([(1, text, 1), (1, text, 2), (2, "x" + text, 3), (1, "other", 4)], "doc_id long, text string, d int")
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "kept").collect())
    assert got == [(1, 5, 0, b"other"), (1, len(text), 0, text.encode()), (1, len(text), 0, text.encode()), (2, len(text) + 1, len(text), b"x")]
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, span=1)


def test_equal_strings_have_equal_anchors():
    r = np.random.default_rng(1)
    raw = r.integers(97, 99, 3000, dtype=np.uint8)
    raw[1500:2500] = raw[300:1300]
    found = {}
    first, last, anchor, _ = suffix_dedup.pieces(raw, np.ones(3000 - 49, dtype=bool), 50)
    assert first[0] == 0 and last[-1] == 2950 and (first[1:] == last[:-1] + 1).all()
    for f, z, a in zip(first, last, anchor):
        for at in range(f, z + 1):
            assert at <= a <= at + 50 - suffix_dedup.gram_of(50)
            assert found.setdefault(raw[at : at + 50].tobytes(), a - at) == a - at


def settled(pieces, span):
    """What is left open of sorted pieces (start of the suffix, what stands before it, place), as strings by place."""
    made = sorted((right + b"\xff" + left + b"\xff", (k, 0, 0), len(left)) for k, (right, left) in enumerate(pieces))
    shared = suffix_dedup.shared_prefixes([m[0] for m in made])
    out = {}
    for d, _, lo, hi, raw in suffix_dedup._pieces_settled(span)((n, *m) for n, m in zip(shared.tolist(), made)):
        assert hi is None
        for at in range(len(raw) - span + 1):
            out[d, lo + at] = raw[at : at + span]
    return out


@pytest.mark.parametrize("small", [2, 16])
def test_strings_that_pieces_share_stay_open(monkeypatch, small):
    """Of pieces of one anchor, every string that two of them hold at one distance from it is open."""
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    r, span = random.Random(4), 10
    gram = suffix_dedup.gram_of(span)
    for _ in range(300):
        anchors = [bytes(r.choices(b"xy", k=gram)) for _ in range(3)]
        texts = {(r.choice(anchors) + bytes(r.choices(b"ab", k=span - gram)), bytes(r.choices(b"ab", k=r.randrange(span - gram + 1)))) for _ in range(9)}
        pieces = sorted(texts)
        got = settled(pieces, span)
        held = {}
        for k, (right, left) in enumerate(pieces):
            for i in range(len(left) + 1):
                if len(right) >= span - i:
                    held.setdefault((left[len(left) - i :] + right[: span - i], i), []).append((k, len(left) - i))
        for (string, _), places in held.items():
            if len(places) > 1:
                assert all(got.get(p) == string for p in places)


def test_merge_is_sorted_and_knows_prefixes():
    r = random.Random(9)
    for k in (1, 2, 3, 7, 16):
        lists, all_ = [], []
        for i in range(k):
            strings = sorted({"".join(r.choices("ab", k=r.randrange(1, 7))).encode() + b"\xff" for _ in range(30)})
            shared = suffix_dedup.shared_prefixes(strings)
            keys = np.array([(i, 0, j) for j in range(len(strings))], dtype=suffix_dedup._KEY)
            part = suffix_dedup._sent(0, strings, shared, keys, np.zeros(len(strings)))
            lists.append(suffix_dedup._received(*part[1:]))
            all_ += [(s, (i, 0, j)) for j, s in enumerate(strings)]
        got = list(suffix_dedup.merged(lists))
        assert [x[1:3] for x in got] == sorted(all_)
        for before, x in zip(got, got[1:]):
            same = next((n for n, (a, b) in enumerate(zip(before[1], x[1])) if a != b), min(len(before[1]), len(x[1])))
            assert x[0] == same


def test_op13(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(x) for x in queries.QUERIES["op13_suffix_dedup"](spark, sf).collect())
    assert got == brute(rows, 100)
