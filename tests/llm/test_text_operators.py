"""Toxicity, SentencePiece, secrets, fingerprints and token files against brute force."""

import base64
import hashlib
import random
import time
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import pieces, queries, secret_scan, sketch, token_counts, toxicity
from recollect.llm.util import new_path, tuned

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return tuned(spark).createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# -- toxicity -------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    words, stems = ["moron", "pathetic", "scum", "clown"], ["lowe"]
    auto = toxicity.Automaton(words, stems)
    r = random.Random(3)
    for _ in range(3000):
        base = r.choice(words)
        word = list(base)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(word) + 1)
            word[k : k + r.randrange(2)] = r.choice(["", "m", "o", "q"])
        word = "".join(word)
        near = min([(edits(word, w), i) for i, w in enumerate(words) if edits(word, w) <= toxicity.budget(w)], default=None)
        got = auto.match(word)
        assert (got and got[0]) == (near and near[0]), word
    assert auto.match("lowered") == (0, 4) and auto.match("low") is None


def toxic_rows(n=400):
    r = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "er", "ing", "ou")]
    rows = []
    for i in range(n):
        said = [r.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            said.insert(r.randrange(30), r.choice(["moron", "zorkan", "zorkel", "zorkix", "zorkum", "zorkat"]))
        rows.append((" ".join(said), int(bad)))
    return rows


def test_learning_finds_words_and_stems_not_copies():
    rows = toxic_rows() + [("only in this copied row " + "ananan berberber", 1)] * 30
    words, stems, worth, _ = toxicity.learn_lexicon(rows)
    assert "zork" in stems and "moron" in words and "berberber" not in words
    assert len(worth) == len(words) + len(stems) and all(0.2 <= w <= 1 for w in worth)
    model = toxicity.fit(toxic_rows())
    wrong = [t for t, y in toxic_rows() if (model.score(*model.evidence(t)) >= 0.5) != bool(y)]
    assert not wrong
    assert model.score(*model.evidence("you are a morron and a zorkanite")) >= 0.5
    plain, quoted = model.evidence("you are a moron here"), model.evidence('she wrote "moron" here')
    assert quoted[1] > 0 and quoted[0] < plain[0]


def read_marks(text):
    """Quotations of a text by reading on from each opening mark."""
    mates = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
    mark = [c in '"“”„«»‘’' and not (c == "’" and text[:i][-1:].isalnum() and text[i + 1 : i + 2].isalnum()) for i, c in enumerate(text)]
    pairs, used = [], set()
    for i, c in enumerate(text):
        if not mark[i] or i in used or c not in mates:
            continue
        for j in range(i + 1, len(text)):
            if not mark[j]:
                continue
            if text[j] in mates[c]:
                pairs.append((i, j))
                used |= {i, j}
                break
            if text[j] == c:
                break
    return sorted(pairs)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab "«»', max_size=24))
def test_quotations_by_reading(text):
    opens, closes = toxicity.quotations(text)
    assert list(zip(opens, closes)) == read_marks(text)


def test_quotation_windows():
    model = toxicity.Model(["moron"], [], [1.0])
    quoted = {
        '“foo” and then moron and “bar”': 0.0,
        '"moron" she wrote': 0.8,
        '"moron" it was': 0.6,
        "he isn’t a ‘moron’ at all": 0.6,
        "it’s a moron’s way": 0.0,
        "„moron“ sagte er": 0.8,
        "« moron »": 0.6,
        '" one two three four five six seven moron eight "': 0.0,
        'they said moron': 0.3,
        'a " moron': 0.0,
        "moron": 0.0,
    }
    for text, q in quoted.items():
        abuse, said, strongest = model.evidence(text)
        assert (round(abuse, 6), round(said, 6), round(strongest, 6)) == (round(1 - q, 6), q, round(1 - q, 6)), text


def test_toxicity_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN", 20)
    monkeypatch.setattr(toxicity, "STATES", 20)
    model, fresh = (toxicity.Model(["pathetic", "moron"], ["lowe"], [1.0, 1.0, 1.0]) for _ in range(2))
    r = random.Random(8)
    for _ in range(200):
        text = " ".join("".join(r.choice("patheticmron") for _ in range(r.randrange(1, 9))) for _ in range(30)) + " morron pathetik lowered"
        monkeypatch.setattr(toxicity, "STATES", 20)
        got = model.evidence(text)
        monkeypatch.setattr(toxicity, "STATES", 10**9)
        assert got == fresh.evidence(text)
    assert len(model.clean) + len(model.hits) <= 20 + 33


def test_toxicity_edges(spark):
    labels = tuned(spark).createDataFrame([(i, y) for i, (_, y) in enumerate(toxic_rows())] + [(None, 1), (1, None)], "doc_id long, toxic int")
    table = docs(spark, [t for t, _ in toxic_rows()])
    model = toxicity.train(table, labels)
    odd = docs(spark, [None, "", "x" * 200_000, "moron", "moron"])
    got = toxicity.score(odd, model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in got] == [False, False, False, True, True]
    assert toxicity.reject(odd, model).count() == 3
    assert toxicity.score(odd.filter("false"), model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(odd.withColumnRenamed("lang", "Score"), model, ["doc_id", "Score"])
    copies = table.unionByName(table.filter("doc_id < 50")).withColumn("mark", table.doc_id).withColumn("said", table.text)
    assert toxicity.train(copies, labels).entries() == model.entries()
    blank = toxicity.train(table, labels.filter("false"))
    assert blank.score(*blank.evidence("nothing")) < 0.5 <= blank.score(*blank.evidence("moron"))


@pytest.mark.parametrize(
    "hostile",
    [
        lambda n: "eyJ" * n,
        lambda n: "eyJ" * n + ".eyJhIjoxfQ.b",
        lambda n: "eyJhIjoxfQ." * n,
        lambda n: "-----BEGIN PRIVATE KEY-----a:" * n,
        lambda n: "-----BEGIN PRIVATE KEY-----a:" * n + "\nMAMCAQE=\n-----END PRIVATE KEY-----",
        lambda n: "token=" * n,
        lambda n: "a1" * n,
    ],
)
def test_secrets_of_hostile_texts_take_linear_time(hostile):
    def took(n):
        began = time.process_time()
        secret_scan.find(hostile(n))
        return time.process_time() - began

    took(10_000)
    assert took(160_000) < 0.3 + 30 * max(took(10_000), 0.003)  # 16 times the text; squared, it were 256 times


# -- SentencePiece ------------------------------------------------------------------

MODEL = queries.tokenizer_file(queries.PIECE_MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abt heT.▁\n\tñé😀0　\x00"), max_size=60))
def test_agenda_equals_library(text):
    own = pieces.load(MODEL)
    ids = own.library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == own.library.decode(ids) == own.shown(own.encode_all([text]))[0]


def test_ids_are_the_agendas():
    own = pieces.Pieces(MODEL)
    own._theirs = lambda chunks: [[0] for _ in chunks]
    text = "the agenda makes these ids " + "ab" * 3000
    assert own.encode(text) == own.library.encode(text)
    made = own.encode_all([text, "", text])
    assert own.shown(made) == [text, "", text] and len(own.wrong) == len(own.slots)
    assert own.marked(made, own.wrong).tolist() == [True, False, True]


def test_broken_agenda_shows(spark):
    own = pieces.Pieces(MODEL)
    own.merge_many = lambda chunks: (np.full(len(chunks), 5, dtype=np.int64), np.ones(len(chunks), dtype=np.int64))
    made = own.encode_all(["some words here"])
    assert made.ids.tolist() == [5, 5, 5] != own.library.encode("some words here") and len(own.wrong) == 3
    own.merge_many = lambda chunks: (np.full(len(chunks), 300, dtype=np.int64), np.ones(len(chunks), dtype=np.int64))
    own.forget()
    made = own.encode_all(["hello world again"])
    assert own.shown(made) == [own.library.decode([300, 300, 300])] != ["hello world again"]


def test_memo_forgets(monkeypatch):
    own = pieces.Pieces(MODEL)
    monkeypatch.setattr(pieces, "MEMO", 10)
    for k in range(30):
        text = " ".join(f"word{k * i}" for i in range(9)) + " é😀 \x00"
        made = own.encode_all([text, "x"])
        assert made.of(0).tolist() == own.library.encode(text) and own.written(made)[1] == ",".join(map(str, own.library.encode("x")))
        assert own.shown(made) == [own.library.decode(made.of(0).tolist()), "x"]


def test_output_names_are_refused(spark):
    with pytest.raises(ValueError):
        pieces.encode_decode(docs(spark, ["x"]).withColumnRenamed("lang", "Ids"), ["doc_id", "Ids"], MODEL)


def test_long_chunks_and_rows(spark):
    own = pieces.load(MODEL)
    long = "ab" * 20_000 + "é" * 300
    assert own.encode(long) == own.library.encode(long)
    assert own.merge("▁" + "the" * 10) == own.merge_many(["▁" + "the" * 10])[0].tolist()
    texts = [None, "", long, "same text", "same text", "  two  spaces "]
    got = pieces.encode_decode(docs(spark, texts), ["doc_id"], MODEL).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        assert row.ids == own.library.encode(text or "") and row.n_tokens == len(row.ids) and row.library_agrees
        assert row.decoded == own.library.decode(row.ids)
    csv = pieces.encode_decode(docs(spark, texts), ["doc_id"], MODEL, ids="csv").orderBy("doc_id").collect()
    assert csv[3].ids == ",".join(map(str, got[3].ids))
    assert pieces.encode_decode(docs(spark, ["x"]).filter("false"), ["doc_id"], MODEL).count() == 0


# -- secrets ---------------------------------------------------------------------------

PLAIN = {
    "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    out = []
    for kind, least in (("assign", 6), ("access", 20), ("hex", 24)):
        for m in PLAIN[kind].finditer(text):
            if len(m[1] if kind == "assign" else m[0]) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            [
                "password",
                "PassWord",
                "token",
                "api_key",
                "apikey",
                "secret",
                "=",
                ": ",
                '"',
                "'",
                " ",
                "abc123",
                "tokentoken=",
                "AKIA",
                "AKIA" + "A1" * 9,
                "0af9" * 7,
                "é",
                "İ",
                "ſecret=abcdef1",
                "x",
                "-",
                "\n",
            ],
        ),
        max_size=14,
    ),
)
def test_prefilter_equals_plain_search(parts):
    text = "".join(parts)
    assert [s for s in secret_scan.find(text) if s[0] in secret_scan.BASE] == brute(text)


def test_checksums_and_redaction(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = "ghp_" + body + secret_scan.crc_base62(body), "ghp_" + body + "000000"
    assert [s[0] for s in secret_scan.find(good)] == ["github"] and not secret_scan.find(bad)
    assert [s[0] for s in secret_scan.find("npm_" + good[4:])] == ["npm"]
    texts = [None, "", 'a token = "abcdef123" b', "AKIA" + "B2" * 9 + " " + good, "clean text", "clean text"]
    rows = secret_scan.scan(docs(spark, texts), ["doc_id"]).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.secret_spans] for r in rows] == [secret_scan.find(t) for t in texts]
    clean = [r.text for r in secret_scan.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert clean == [None, "", 'a [secret]" b', "[secret] [secret]", "clean text", "clean text"]
    assert secret_scan.scan(docs(spark, ["x"]).filter("false"), ["doc_id"]).count() == 0


def pem(kind, body, headers=""):
    coded = base64.encodebytes(body).decode()
    return f"-----BEGIN {kind}-----\n{headers}{coded}-----END {kind}-----"


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
def test_private_keys_of_every_form(newline):
    der = bytes([0x30, 0x82, 0x01, 0x00]) + bytes(256)
    dek = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF00FF00FF00FF00FF00FF00FF00FF\n\n"
    good = [
        pem("RSA PRIVATE KEY", der),
        pem("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + bytes(range(200))),
        pem("RSA PRIVATE KEY", bytes(range(64)), dek),
        pem("RSA PRIVATE KEY", der, "Comment: a key\n\n"),
    ]
    bad = [
        pem("PRIVATE KEY", der[:-1]),
        pem("OPENSSH PRIVATE KEY", bytes(99)),
        pem("RSA PRIVATE KEY", bytes(64), "Comment: a key\n\n"),
        "-----BEGIN RSA PRIVATE KEY-----\n" + dek + "-----END RSA PRIVATE KEY-----",
    ]
    for key in good:
        key = key.replace("\n", newline)
        assert [s for s in secret_scan.find("a " + key + " b") if s[0] == "pem"] == [("pem", 2, 2 + len(key))]
    for key in bad:
        assert not [s for s in secret_scan.find(key.replace("\n", newline)) if s[0] == "pem"]


def test_a_rejected_match_hides_no_later_one():
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{part(b'{"alg":"HS256"}')}.{part(b'{"sub":"1"}')}.c2ln"
    assert secret_scan.find("eyJx." + token) == [("jwt", 5, 5 + len(token))]


# -- fingerprints ------------------------------------------------------------------------


def test_sketch_is_thresholded_and_mergeable():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = " ".join(word() for _ in range(3000))
    half = text[: len(text) // 2]
    a, b = sketch.sketch(sketch.points_of(text)), sketch.sketch(sketch.points_of(half))
    assert abs(len(a) - len(text) / sketch.KEPT) < 5 * (len(text) / sketch.KEPT) ** 0.5
    assert sketch.containment(b, a) > 0.97 and abs(sketch.containment(a, b) - 0.5) < 0.06
    assert sketch.merged(sketch.packed(a), sketch.packed(b)) == sketch.packed(np.union1d(a, b))
    assert (sketch.unpacked(sketch.packed(a)) == a).all()
    assert sketch.resemblance(a[:0], a[:0], True) == 1.0 and sketch.resemblance(a[:0], a) == 0.0


def windows(text):
    padded = "\0" * 15 + text + "\0" * 15
    return {padded[i : i + 16] for i in range(len(padded) - 15)}


def test_unsampled_sketches_are_exact_and_the_threshold_samples_them():
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in [*range(1, 100), 4000]]
    for text, then in zip(texts, texts[1:] + texts[:1]):
        cut = len(text) // 4
        changed = text[: len(text) - cut] + then[:cut]
        a, b = windows(text), windows(changed)
        one, two = (sketch.sketch(sketch.points_of(t), kept=1) for t in (text, changed))
        assert len(one) == len(a) and sketch.resemblance(one, two) == pytest.approx(len(a & b) / len(a | b))
        assert sketch.containment(one, two) == pytest.approx(len(a & b) / len(a))
        # The top 30 bits of what the threshold keeps are those of the hashes in the first quarter.
        kept = sketch.sketch(sketch.points_of(text), kept=4)
        assert np.array_equal(np.unique(kept >> np.uint32(2)), np.unique(one[one < 2**30]))


def test_short_texts_are_not_lost(spark):
    """Estimates against exact shingle sets: errors as sampling allows, hardly a near copy without likeness."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in range(1, 400)]
    got = sketch.edited_and_next(docs(spark, texts)).orderBy("doc_id").collect()
    errors, lost = [], 0
    for row, text, then in zip(got, texts, texts[1:] + texts[:1]):
        cut = len(text) // 4
        a, b, c = windows(text), windows(text[: len(text) - cut] + then[:cut]), windows(then)
        for found, one, two in ((row.near_edited, a, b), (row.near_next, a, c)):
            exact, joint = len(one & two) / len(one | two), len(one | two)
            spread = (max(exact * (1 - exact), 0.05) * sketch.KEPT / joint) ** 0.5
            errors.append((found - exact) / spread)
        lost += row.near_edited == 0 and cut > 0
    assert np.abs(errors).max() < 5 and np.mean(np.square(errors)) < 1.3 and abs(np.mean(errors)) < 0.15
    assert lost <= 6


def test_fingerprints_follow_the_next_document(spark):
    texts = ["aé" * 50, "", None, "x" * 3000, "hello world, a text", "hello world, a text", "zz"]
    rows = docs(spark, texts).repartition(5)
    got = sketch.edited_and_next(rows).orderBy("doc_id").collect()
    filled = [t or "" for t in texts]
    for i, row in enumerate(got):
        text, then = filled[i], filled[(i + 1) % len(filled)]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + then[:cut]
        assert row.doc_id == i and row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == sketch.packed(sketch.sketch(sketch.points_of(text)))
        assert row.edited_fingerprint == sketch.packed(sketch.sketch(sketch.points_of(changed)))
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0
    assert sketch.edited_and_next(rows.filter("false")).count() == 0
    single = sketch.edited_and_next(rows.filter("doc_id = 6")).first()
    assert single.near_next == 1.0 and sketch.fingerprints(rows, ["doc_id"]).count() == 7


# -- token files --------------------------------------------------------------------------

RANKS = queries.tokenizer_file(queries.RANKS)


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_separator_scan(spark, block, tmp_path):
    r = random.Random(block)
    want, stream = {}, {}
    for name in ("a.bin", "b.bin", "c.bin"):
        sizes = [r.randrange(9) for _ in range(40)] if name != "c.bin" else []
        ids = [x for n in sizes for x in [*(r.randrange(100) for _ in range(n)), 999]]
        if name == "b.bin":
            ids += [1, 2, 3]
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
        want |= {(name, i): (n, True) for i, n in enumerate(sizes)}
        if name == "b.bin":
            want[name, len(sizes)] = (3, False)
    got = token_counts.scan(tuned(spark), str(tmp_path), 999, block=block).collect()
    assert {(g.file.rsplit("/", 1)[1], g.ordinal): (g.n_ids, g.finished) for g in got} == want and len(got) == len(want)


def test_written_files_count_tokens(spark):
    texts = [None, "", "hello world", "hello world", "é" * 5000, "the end" * 3]
    path = new_path(spark, "test-tokens")
    token_counts.write_tokens(docs(spark, texts).repartition(3), path, RANKS, queries.END_OF_DOCUMENT, key="doc_id")
    own = token_counts.encoder(RANKS)
    got = {r.doc_id: r.n_tokens for r in token_counts.keyed_counts(spark, path, queries.END_OF_DOCUMENT, block=50).collect()}
    assert got == {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    odd = docs(spark, ["a b c", "d"]).selectExpr("case when doc_id = 0 then null else -1 end as doc_id", "text", "1 as k", "'x' as t")
    token_counts.write_tokens(odd, path + "-odd", RANKS, queries.END_OF_DOCUMENT, key="doc_id", file_bytes=8)
    found = token_counts.keyed_counts(spark, path + "-odd", queries.END_OF_DOCUMENT).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=str) == [(-1, 1), (None, 3)]
    for key in (0, 5, -1, None, 2**63 - 1, 2**62, -(2**63)):
        assert token_counts.key_of(token_counts.key_digits(key)) == key
