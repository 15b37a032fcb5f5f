"""Entity-exact retrieval, vector blocks, export gates, run files, tokenizers and arguments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions import embed, tokenizers
from recollect.operators import dense, entities, lexical
from recollect.plans import retrieve as R
from recollect.plans import run as P
from recollect.session import shared_dir
from recollect.sources import corpus, index

# -- vectors --------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 7, 1000])
@pytest.mark.parametrize("k", [None, 4])
def test_blocks_equal_brute_force(spark, block, k):
    r = np.random.default_rng(block)
    vectors = [None if i % 13 == 5 else [0.0] * 6 if i % 13 == 7 else r.integers(-2, 3, 6).astype(float).tolist() for i in range(60)]
    chunks = [(f"c{i:02}", f"p{(i * 7) % 23:02}", v) for i, v in enumerate(vectors)]
    queries = [("a", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("b", [1.0, 2.0, 0.0, -1.0, 0.0, 1.0]), ("c", [0.0] * 6)]
    c = spark.createDataFrame(chunks, "chunk string, page string, vector array<float>").repartition(4)
    q = spark.createDataFrame(queries, "query_id string, query_vector array<double>")
    found = dense.best_in_blocks(q, c, k, block)
    got = {(x.query_id, x.page): (x.chunk, round(x.cosine, 9)) for x in lexical.top_k(found, k or 99, score="cosine", tie="page").collect()}
    for name, v in queries:
        best = {}
        for chunk, page, x in chunks:
            n = np.linalg.norm(x or [0]) * np.linalg.norm(v)
            cos = float(np.dot(x, v) / n) if n else 0.0
            key = (-round(cos, 12), chunk)
            if page not in best or key < best[page][0]:
                best[page] = (key, cos)
        order = sorted(best, key=lambda p: (best[p][0][0], p))[: k or 99]
        assert {p: got.get((name, p)) for p in order} == {p: (best[p][0][1], round(best[p][1], 9)) for p in order}
        assert sum(1 for key in got if key[0] == name) == len(order)
    assert dense.best_in_blocks(q, c.filter("false"), k, block).count() == 0
    with pytest.raises(Exception, match="unlike lengths"):
        dense.best_in_blocks(q, spark.createDataFrame([("x", "p", [1.0]), ("y", "p", [1.0, 2.0])], c.schema).coalesce(1)).collect()


# -- entities --------------------------------------------------------------------------

PAGES = [("p1", "Ada Lovelace"), ("p2", "Notes"), ("p3", "Engine"), ("p4", "ada lovelace letters")]
CHUNKS = [
    ("p1", "p1:0", 0, "first programmer"),
    ("p2", "p2:0", 0, "nothing here"),
    ("p2", "p2:1", 1, "met Ada Lovelace and Charles Babbage"),
    ("p3", "p3:0", 0, "the Analytical Engine"),
    ("p4", "p4:0", 0, "Charles Babbage wrote"),
]


def _index(spark):
    pages = spark.createDataFrame(PAGES, "page_id string, title string")
    chunks = spark.createDataFrame(CHUNKS, "page_id string, chunk_id string, chunk_index int, text string")
    gazetteer = spark.createDataFrame([("ada lovelace", ["p1", "p2"]), ("engine", ["p3"])], "surface string, page_ids array<string>")
    return pages, chunks, gazetteer


def test_entity_exact_hits(spark):
    pages, chunks, gazetteer = _index(spark)
    seen = spark.createDataFrame(
        [("o", "Charles Babbage told Ada Lovelace of an engine. Charles Babbage, again. Bengine."), ("empty", ""), ("none", None)],
        "observation_id string, text string",
    )
    hits = entities.entity_exact(seen, gazetteer, pages, chunks, 1).collect()
    got = {(h.seed_id, h.source, h.surface, h.page_id): (h.rank, h.score, h.chunk_id, h.chunk_score) for h in hits}
    assert got == {
        ("entity-1", "gazetteer", "ada lovelace", "p1"): (1, 2.0, "p1:0", 0.0),
        ("entity-1", "gazetteer", "ada lovelace", "p2"): (2, 1.0, "p2:1", 1.0),
        ("entity-2", "gazetteer", "engine", "p3"): (1, 3.0, "p3:0", 1.0),
        ("entity-3", "noun_phrase", "charles babbage", "p2"): (1, 1.0, "p2:1", 1.0),  # one page a phrase, the smaller id
    }
    trace = entities.entity_trace(entities.entity_exact(seen, gazetteer, pages, chunks, 1)).collect()
    assert [(t.observation_id, [(s.seed_id, [p.page_id for p in s.returned_pages]) for s in t.per_seed_retrievals]) for t in trace] == [
        ("o", [("entity-1", ["p1", "p2"]), ("entity-2", ["p3"]), ("entity-3", ["p2"])]),
    ]
    with pytest.raises(ValueError):
        entities.entity_exact(seen, gazetteer, pages, chunks, 0)


def test_all_entity_admission_orders_by_rank_and_score(spark):
    pages, chunks, gazetteer = _index(spark)
    cases = spark.createDataFrame([("c", "Charles Babbage told Ada Lovelace of an engine.")], "case_id string, observation string")
    out = R.get_condition("all_entity_output_rag")(cases, gazetteer=gazetteer, pages=pages, chunks=chunks, k=5)
    assert [r.page for r in out.orderBy("rank").collect()] == ["p3", "p1", "p2", "p4"]
    with pytest.raises(ValueError):
        R.get_condition("all_entity_output_rag")(cases, gazetteer=gazetteer)


def test_phrases_meet_texts_like_brute_force(spark):
    r = random.Random(3)
    words = ["ab", "cd", "ef", "Gh", "i1"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(60)] + [(99, None)]
    phrases = [(i, " ".join(r.choice(words) for _ in range(1 + i % 5))) for i in range(25)] + [(77, ""), (78, "x")]
    docs = spark.createDataFrame(texts, "id int, text string")
    got = entities.phrase_matches(docs, spark.createDataFrame(phrases, "pid int, phrase string"), "id", "text", "pid", "phrase").collect()
    want = {(i, p) for i, t in texts for p, s in phrases if t and len(s) > 1 and f" {s.lower()} " in f" {t.lower()} "}
    assert {(x.doc, x.phrase_id) for x in got} == want and len(got) == len(want)
    none = entities.phrase_matches(docs, spark.createDataFrame([], "pid int, phrase string"), "id", "text", "pid", "phrase")
    assert none.count() == 0 and none.columns == ["doc", "phrase_id"]


# -- arguments, hits -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("condition", "given", "fine"),
    [
        ("no_memory", {}, True),
        ("no_memory", {"mode": "dense"}, False),
        ("no_memory", {"flow": "tool_output_only"}, False),
        ("input_rag", {"mode": "dense", "index": "i"}, True),
        ("input_rag", {"mode": "dense"}, False),
        ("input_rag", {"mode": "dense", "index": "i", "flow": "tool_output_only"}, False),
        ("input_rag", {"mode": "enhanced", "index": "i"}, False),
        ("input_rag", {"mode": "enhanced", "index": "i", "expansions": "e", "policy": "frozen"}, True),
        ("input_rag", {"mode": "hybrid", "index": "i", "expansions": "e"}, False),
        ("input_rag", {"mode": "hybrid", "index": "i", "policy": "frozen"}, False),
        ("naive_output_rag", {"mode": "dense", "index": "i"}, False),
        ("naive_output_rag", {"mode": "dense", "index": "i", "flow": "model_output_only", "k": 3}, True),
        ("all_entity_output_rag", {"index": "i", "k": 3}, True),
        ("all_entity_output_rag", {}, False),
        ("all_entity_output_rag", {"index": "i", "mode": "dense"}, False),
        ("all_entity_output_rag", {"index": "i", "expansions": "e"}, False),
        ("no_memory", {"response_policy": "frozen"}, False),
        ("no_memory", {"response_policy": "frozen", "responses": "r"}, True),
    ],
)
def test_argument_matrix(condition, given, fine):
    if fine:
        R.check_arguments(condition, **given)
    else:
        with pytest.raises(ValueError):
            R.check_arguments(condition, **given)


def test_text_windows_and_merge(spark):
    rows = spark.createDataFrame([("x" * 8000,), ("y" * 12001,), ("",)], "t string").select(
        F.transform(R.text_windows(F.col("t")), F.length).alias("n"),
    ).collect()
    assert [r.n for r in rows] == [[8000], [6000, 6000, 1], [0]]
    hits = spark.createDataFrame(
        [("q", 0, "a", 0.5), ("q", 1, "a", 0.9), ("q", 1, "b", 0.9), ("q", 0, "c", 0.1)],
        "query_id string, window int, source_id string, score double",
    )
    assert [(r.source_id, r.score) for r in R.max_merge(hits, 2).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.9)]


# -- export, matrix, runs ---------------------------------------------------------------------


def _raw(spark, signature=None, model="m", width=2, target=1):
    pages = spark.createDataFrame(
        [(1, "s", "a", "A", ["poison"]), (2, "s", "b", "B", None)],
        "id long, source_id string, slug string, title string, perturbations array<string>",
    )
    chunks = spark.createDataFrame(
        [(1, 1, 0, "x", model, signature, [1.0] * width), (2, 2, 0, "y", model, signature, [0.5] * width)],
        "id long, page_id long, chunk_index int, chunk_text string, model string, embedding_signature string, embedding array<float>",
    )
    links = spark.createDataFrame([(2, target, None, None)], "from_page_id long, to_page_id long, link_type string, link_source string")
    return pages, chunks, links


@pytest.mark.parametrize(
    ("broken", "message"),
    [
        ({"model": "other"}, "model"),
        ({"signature": "m:9"}, "signature"),
        ({"width": 3}, "width"),
        ({"target": 7}, "missing page"),
        ({}, None),
        ({"model": "llama-server:m"}, None),
        ({"signature": "m:2", "model": "other"}, None),
    ],
)
def test_export_gate(spark, tmp_path, broken, message):
    path = str(tmp_path / "index")
    if message:
        with pytest.raises(ValueError, match=message):
            index.export(*_raw(spark, **broken), path, "c", "m", 2)
        assert not (tmp_path / "index").exists() and not list(tmp_path.iterdir())
        return
    index.export(*_raw(spark, **broken), path, "c", "m", 2)
    back = index.read_index(spark, path, "m", 2)
    assert {r.chunk_id for r in back.chunks.collect()} == {"s:a:0", "s:b:0"} and back.links.first().source_page_id == "s:b"
    with pytest.raises(FileExistsError):
        index.export(*_raw(spark, **broken), path, "c", "m", 2)
    with pytest.raises(ValueError, match="dimensions"):
        index.read_index(spark, path, "m", 3)
    assert [p.name for p in tmp_path.iterdir()] == ["index"]


def test_export_is_ordered(spark, tmp_path):
    n = 60
    pages = spark.createDataFrame(
        [(i, f"s{i % 3}", f"p{(i * 7) % n:02}", "t", []) for i in range(n)],
        "id long, source_id string, slug string, title string, perturbations array<string>",
    )
    chunks = spark.createDataFrame(
        [(2 * i + k, i, 1 - k, "x", "m", None, [1.0]) for i in range(n) for k in (0, 1)],
        "id long, page_id long, chunk_index int, chunk_text string, model string, embedding_signature string, embedding array<float>",
    )
    links = spark.createDataFrame(
        [(i, j, None if i % 2 else "b", None if j % 2 else "z") for i in range(n) for j in (i // 2, i // 3)],
        "from_page_id long, to_page_id long, link_type string, link_source string",
    )
    index.export(pages, chunks, links, str(tmp_path / "index"), "c", "m", 1)
    stored = {
        name: [
            r.asDict() for f in sorted((tmp_path / "index" / name).glob("part-*")) for r in spark.read.parquet(str(f)).collect()
        ] for name in ("pages", "chunks", "links")
    }
    assert stored["pages"] == sorted(stored["pages"], key=lambda r: (r["source_id"], r["slug"])) and len(stored["pages"]) == n
    assert stored["chunks"] == sorted(stored["chunks"], key=lambda r: (r["page_id"], r["chunk_index"]))
    assert stored["links"] == sorted(stored["links"], key=lambda r: (r["source_page_id"], r["target_page_id"], r["link_type"], r["provenance"] or ""))


def test_embedder_runs_in_batches(spark):
    class Lengths:  # inside, so that workers get it by value
        model, dimensions = "lengths", 2

        def __init__(self, last=1.0, width=2):
            self.last, self.width = last, width

        def embed(self, texts):
            assert isinstance(texts, list)
            return np.array([[len(t), self.last] for t in texts])[:, : self.width]

    table = spark.createDataFrame([("ab",), (None,), ("",)], "text string").coalesce(1)
    assert [r.v for r in table.select(embed.embedder(Lengths())(F.col("text")).alias("v")).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    for model, message in ((Lengths(float("nan")), "not finite"), (Lengths(width=1), "shape")):
        with pytest.raises(Exception, match=message):
            table.select(embed.embedder(model)(F.col("text")).alias("v")).collect()
    embed.check_embedder(Lengths(), {"embedding_model": "lengths", "embedding_dimensions": 2})
    for manifest in ({"embedding_model": "x", "embedding_dimensions": 2}, {"embedding_model": "lengths", "embedding_dimensions": 3}):
        with pytest.raises(ValueError):
            embed.check_embedder(Lengths(), manifest)


def test_content_hash_is_checked(spark, tmp_path):
    path = tmp_path / "index"
    index.export(*_raw(spark), str(path), "c", "m", 2)
    for file in (path / "manifest").iterdir():
        if file.name.endswith(".json"):
            said = file.read_text()
            stated = spark.read.json(str(path / "manifest")).first().content_hash
            file.write_text(said.replace(stated, "0" * 64))
        elif file.name.endswith(".crc"):
            file.unlink()
    with pytest.raises(ValueError, match="content hash"):
        index.read_index(spark, str(path))


def test_vector_matrix(spark, tmp_path):
    file = str(tmp_path / "m.npy")
    matrix = np.random.default_rng(1).standard_normal((10_000, 3)).astype(np.float32)
    np.save(file, matrix)
    rows = index.read_matrix(spark, file, 10_000, 3).orderBy("row").collect()
    assert len(rows) == 10_000 and np.allclose(np.array([r.vector for r in rows]), matrix) and [r.row for r in rows[:2]] == [0, 1]
    with pytest.raises(ValueError, match="shape"):
        index.read_matrix(spark, file, 9_999, 3)
    np.save(file, np.ones((2, 2), dtype=np.int32))
    with pytest.raises(ValueError, match="floats"):
        index.read_matrix(spark, file, 2, 2)
    np.save(file, np.array([[1.0, np.nan]]))
    with pytest.raises(Exception, match="not finite"):
        index.read_matrix(spark, file, 1, 2).collect()
    np.save(file, np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        index.read_matrix(spark, file, 1, 1)


def test_settings_and_publish(spark, tmp_path):
    manifest = {"content_hash": "h", "corpus_id": "c", "embedding_model": "m"}
    said = P.settings("input_rag", "model", mode="hybrid", k=5, index=("i", manifest), response_cache_hash="x")
    assert set(said) == set(P.SETTINGS) and len(said) == 21
    assert said["constants"]["rrf_k"] == 60 and said["admission_policy"] == "all_retrieved" and said["retrieval_condition_detail"] is None
    bare = P.settings("no_memory", "model")
    assert bare["constants"] is None and bare["admission_policy"] is None
    assert P.settings("all_entity_output_rag", "model", index=("i", manifest))["retrieval_condition_detail"] == "entity_exact_match"
    with pytest.raises(ValueError):
        P.settings("no_memory", "model", odd=1)
    path, rows = str(tmp_path / "run"), spark.createDataFrame([("c1", "x")], "case_id string, response_text string")
    P.publish(rows, path, said)
    with pytest.raises(FileExistsError):
        P.publish(rows.filter("false"), path, said)
    assert spark.read.json(path).count() == 1 and {p.name for p in tmp_path.iterdir()} == {"run", "run.config"}
    broken = rows.select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception):
        P.publish(broken, str(tmp_path / "lost"), said)
    assert {p.name for p in tmp_path.iterdir()} == {"run", "run.config"}


def test_case_lookup_and_private_fields(spark):
    cases = spark.createDataFrame([("b", 1, "x", "t"), ("a", 2, "y", "t"), ("b", 3, "z", "t")], "case_id string, _at int, v string, observation_text string")
    assert P.find_case(cases, position="_at").first().v == "x" and P.find_case(cases, "b", "_at").first().v == "x" and P.find_case(cases, "q", "_at").count() == 0
    assert P.public(cases).columns == ["case_id", "v"]


# -- tokens and pages -------------------------------------------------------------------------------


def test_tokens_of_a_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["", None, "short", "a longer text, with Ünïcödé and numbers 12345 " * 20]
    own = tokenizers.encoder(ranks, pattern)()
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = table.select(
        "i",
        tokenizers.counter(ranks, pattern)(F.col("text")).alias("n"),
        tokenizers.windower(ranks, pattern, 16)(F.col("text")).alias("w"),
    ).orderBy("i").collect()
    for row, text in zip(got, texts):
        ids = own.encode_ordinary(text or "")
        assert row.n == len(ids) and row.w == ([text] if len(ids) <= 16 else [own.decode(ids[k : k + 16]) for k in range(0, len(ids), 16)])
    assert "".join(got[2].w) == texts[2]


def test_pages_from_files(spark):
    files = spark.createDataFrame(
        [("meetings", "m1", "# Sync \nattendees: user/ann\nsee [Ann \"A\"](user/ann)"), ("notes", "n1", "---\ntype: x\n---\nb"), ("slack", "s", "x")],
        "folder string, name string, text string",
    )
    marks = spark.createDataFrame([("note/n1", ["poison"])], "slug string, perturbations array<string>")
    got = {r.slug: r.text for r in corpus.normalized_corpus(files, marks, "v1", "note").collect()}
    assert set(got) == {"meeting/m1", "note/n1", "people/ann"}
    assert got["meeting/m1"].startswith(
        '---\ntitle: "Sync"\ntype: "meeting"\nsource_sha256: "',
    ) and "attendees: people/ann" in got["meeting/m1"] and "](people/ann)" in got["meeting/m1"]
    assert "type: x" in got["note/n1"] and 'perturbations: ["poison"]' in got["note/n1"] and got["note/n1"].count("type:") == 1
    assert got["people/ann"] == '---\nid: "ann"\ntype: "person"\nsource: "v1"\ngenerated_stub: true\naliases: ["Ann \\"A\\""]\n---\n# Ann "A"\n\nnote\n'
    assert spark.range(1).select(T.case_label(F.lit("x-ai-plan"), F.lit("positive"), ("x-",)).alias("v")).first().v == "AI Plan — Cue present"


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    assert shared_dir(spark)
