"""Choices, scoring, validation, caches, sources and small text functions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import caches, dedupe, entities, scoring, validate
from recollect.sources import corpus, index

LABEL = "Item 147 — CoreWeave Reserved-GPU Pricing Revision"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("response", "hit"),
    [("I pick CoreWeave Reserved-GPU Pricing Revision!", True), ("item 147", True), ("Lead Story", False), ("Item 1470", False), (LABEL, True), ("", False)],
)
def test_choice_matching(spark, response, hit):
    assert one(spark, T.matches_choice(F.lit(response), F.lit(LABEL))) is hit


CASES = "case_id string, variant string, output_choice string, memory_choice string, gold array<string>, sensitive array<string>"
PREDICTIONS = "case_id string, position int, response_text string, admitted array<string>, perturbations map<string,array<string>>"


def test_metrics(spark):
    cases = spark.createDataFrame(
        [
            ("a", "positive", "Plan A - red", "blue", ["g1"], ["secret word"]),
            ("b", "cue-ablated", "red", "red", ["g1"], []),
            ("c", "memory-included", "red", "blue", ["g1"], []),
            ("d", "positive", "red", "blue", ["g2"], []),
        ], CASES
    )
    predictions = spark.createDataFrame(
        [
            ("a", 1, "old", [], {}),
            ("a", 2, "Blue, and SECRET WORD", ["g1", "x"], {"x": ["poison"]}),
            ("b", 1, "red or green", [], {}),
            ("c", 1, "blue", [], {}),
            ("zz", 1, "x", [], {}),
        ], PREDICTIONS
    )
    rows = scoring.score_rows(cases, predictions)
    by = {r.case_id: r for r in rows.collect()}
    assert by["a"].beneficial and by["a"].privacy_overexposure and by["a"].poison_admitted and by["a"].spurious_admitted_count == 1
    assert by["d"].abstained and not by["b"].false_intervention
    m = scoring.metrics(rows).first()
    assert (m.case_count, m.memory_included_count, m.ceiling_accuracy) == (3, 1, 1.0)
    assert m.beneficial_decision_change_rate == 0.5 and m.memory_admission_precision == 0.5 and m.memory_admission_recall == 0.5
    empty = scoring.metrics(rows.filter("false")).first()
    assert empty.case_count == 0 and empty.abstention_rate == 0.0


def test_published_identity(spark):
    """5 gold of 428 admitted, 5 of 6 recalled."""
    cases = spark.createDataFrame([(f"c{i}", "positive", "x", "y", ["g"] if i else ["g", "h"], []) for i in range(5)], CASES)
    admitted = [["g", *[f"n{k}" for k in range(85 if i < 3 else 84)]] for i in range(5)]
    predictions = spark.createDataFrame([(f"c{i}", 1, "y", a, {}) for i, a in enumerate(admitted)], PREDICTIONS)
    m = scoring.metrics(scoring.score_rows(cases, predictions)).first()
    assert m.memory_admission_precision == pytest.approx(5 / 428, abs=1e-9) and m.memory_admission_recall == pytest.approx(5 / 6)


def test_both_choices_are_ambiguous(spark):
    cases = spark.createDataFrame([("a", "positive", "red", "blue", ["g"], [])], CASES)
    row = scoring.score_rows(cases, spark.createDataFrame([("a", 1, "red and blue", None, None)], PREDICTIONS)).first()
    assert not row.correct and not row.choice_identifiable and row.admitted_count == 0


def test_entity_union_and_admission(spark):
    hits = spark.createDataFrame(
        [("c", "b", 1, 0.7, "s1"), ("c", "a", 1, 0.9, "s2"), ("c", "a", 1, 0.6, "s3")],
        "case_id string, page_id string, rank int, score double, seed_id string",
    )
    got = dedupe.best_hits(hits).orderBy("new_rank").collect()
    assert [h.page_id for h in got] == ["a", "b"] and len(got[0].contributors) == 2
    some = spark.createDataFrame([("c", "b")], "case_id string, page_id string")
    assert [h.page_id for h in dedupe.admitted_only(hits, some, "case_id", "page_id", ["rank", "score"]).collect()] == ["b"]
    assert dedupe.admitted_only(hits, some.filter("false"), "case_id", "page_id", ["rank", "score"]).count() == 2


def test_seeds_and_exact_chunks(spark):
    pages = spark.createDataFrame(
        [("s:a", "Alpha Project", "projects/alpha-project"), ("s:b", "Beta Team", "teams/beta-team")],
        "page_id string, title string, slug string",
    )
    gazetteer = entities.surfaces(pages)
    seen = spark.createDataFrame([("o", "Compare Alpha Project with Beta Team and Alpha Projects.")], "observation_id string, text string")
    seeds = entities.gazetteer_seeds(seen, gazetteer).orderBy("seed_no").collect()
    assert [(s.surface, s.span_start) for s in seeds] == [("alpha project", 8), ("beta team", 27)]
    chunks = spark.createDataFrame(
        [("s:a", "s:a:1", 1, "about the alpha project"), ("s:a", "s:a:0", 0, "Alpha project."), ("s:a", "s:a:2", 2, "else")],
        "page_id string, chunk_id string, chunk_index int, text string",
    )
    asked = spark.createDataFrame(
        [("e1", "s:a", "alpha project"), ("e2", "s:a", "about nothing"), ("e3", "s:a", "zzz")],
        "seed_id string, page_id string, surface string",
    )
    got = {r.seed_id: (r.chunk_id, r.chunk_score) for r in entities.best_exact_chunk(asked, chunks).collect()}
    assert got == {"e1": ("s:a:0", 1.0), "e2": ("s:a:1", 0.0), "e3": ("s:a:0", 0.0)}


def test_keys_follow_python_json(spark):
    want = hashlib.sha256(
        json.dumps({"model": "m", "normalized_query": "café 😀 \"x\"", "prompt_version": "v1"}, sort_keys=True, separators=(",", ":")).encode(),
    ).hexdigest()
    assert one(spark, caches.expansion_key(F.lit('Café  😀 "x" '), "m", "v1")) == want
    fields = {"model": "m", "prompt": "é\n", "memory": ""}
    want = hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert one(spark, caches.response_key({"model": F.lit("m"), "prompt": F.lit("é\n"), "memory": F.lit(None).cast("string")})) == want


def test_frozen_cache(spark, tmp_path):
    cache = spark.createDataFrame([("k1", "one")], "key string, text string")
    asked = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert caches.lookup(asked.filter("key = 'k1'"), cache, "key", frozen=True).first().text == "one"
    with pytest.raises(caches.FrozenMiss):
        caches.lookup(asked, cache, "key", frozen=True)
    path = str(tmp_path / "cache")
    cache.write.parquet(path)
    whole = caches.populate(asked, cache, "key", lambda lost: lost.withColumn("text", F.lit("new")), path)
    assert sorted(r.key for r in whole.collect()) == ["k1", "k2"]
    assert one(spark, caches.valid_expansions(F.array(F.lit("a"), F.lit("b"), F.lit("B ")), F.lit("q"))) is False
    assert one(spark, caches.valid_expansions(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("q"))) is True


def test_index_round_trip_and_damage(spark, tmp_path):
    pages = spark.createDataFrame(
        [("s:a", "s", "a", "A", ["poison"]), ("s:b", "s", "b", "B", [])],
        "page_id string, source_id string, slug string, title string, perturbations array<string>",
    )
    chunks = spark.createDataFrame(
        [("s:a:0", "s:a", 0, "x", [1.0, 0.0]), ("s:b:0", "s:b", 0, "y", [0.0, 1.0])],
        "chunk_id string, page_id string, chunk_index int, text string, embedding array<float>",
    )
    links = spark.createDataFrame([("s:a", "s:b", "", None)], "source_page_id string, target_page_id string, link_type string, provenance string")
    path = str(tmp_path / "index")
    index.write_index(index.MemoryIndex(pages, chunks, links), path, "c", "m", 2)
    back = index.read_index(spark, path, "m")
    assert back.pages.count() == 2 and {r.page_id: r.body for r in back.documents.collect()} == {"s:a": "x", "s:b": "y"}
    with pytest.raises(ValueError, match="model"):
        index.read_index(spark, path, "other")
    with pytest.raises(Exception):
        index.write_index(index.MemoryIndex(pages, chunks, links), path, "c", "m", 2)
    links.write.mode("append").parquet(f"{path}/links")
    with pytest.raises(ValueError, match="links"):
        index.read_index(spark, path)
    bad = validate.index_issues(
        pages.union(pages),
        chunks.withColumn("embedding", F.array(F.lit(float("nan")))),
        links.withColumn("target_page_id", F.lit("s:z")),
        2,
    )
    assert {r.message for r in bad.collect()} == {"duplicate page id", "wrong vector width", "vector is not finite", "link to unknown page"}


def test_text_functions(spark):
    assert one(spark, T.casefold(F.lit("Straße ﬁn"))) == "strasse fin"
    assert one(spark, T.tokens(F.lit("Größe-12 x"))) == ["gr", "sse", "12", "x"]
    edits = F.array(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new")), F.struct(F.lit("b").alias("old"), F.lit("c").alias("new")))
    assert one(spark, T.fold_replacements(F.lit("aab"), edits)) == "cab"
    assert one(spark, T.fold_replacements(F.lit("xyz"), edits)) is None
    assert one(spark, T.token_windows(F.lit("a b c d e"), 2)) == ["a b", " c d", " e"]  # joined, they are the text
    odd = "  A, b\n\nc\td é x  "
    assert "".join(one(spark, T.token_windows(F.lit(odd), 2))) == odd
    assert one(spark, T.token_windows(F.lit("A, b"), 2)) == ["A, b"]
    assert one(spark, T.render_context(F.array(F.lit("x"), F.lit("y")))) == "1. x\n\n2. y"
    assert one(spark, T.canonical_slug(F.lit("user/ann"))) == "people/ann"
    assert one(spark, T.canonical_source_id(F.lit("notes/a"))) == "note/a"
    assert one(spark, T.upsert_frontmatter(F.lit("body"), "id", F.lit("1"))) == "---\nid: 1\n---\nbody"
    assert one(spark, T.upsert_frontmatter(F.lit("---\nid: 2\n---\nb"), "id", F.lit("1"))) == "---\nid: 2\n---\nb"
    assert one(spark, T.upsert_frontmatter(F.lit("---\nx: 2\n---\nb"), "id", F.lit("1"))) == "---\nid: 1\nx: 2\n---\nb"
    assert one(spark, T.upsert_frontmatter(F.lit("---\nx: 2\nb"), "id", F.lit("1"))) == "---\nx: 2\nb"
    assert one(spark, T.parse_vector(F.lit("(1, 2.5)"))) == [1.0, 2.5] and one(spark, T.parse_vector(F.lit("[1, x]"))) is None
    assert one(spark, T.rewrite_links(F.lit("attendees: user/a\n[x](user/b) user/c"))) == "attendees: people/a\n[x](people/b) user/c"
    assert one(spark, T.run_name(F.lit("d/naive-a_b-dense.jsonl"), "naive-")).asDict() == {"flow": "a_b", "mode": "dense"}
    assert one(spark, T.count_occurrences(F.lit("aAaa"), F.lit("aa"))) == 2


def test_calendar_and_stubs(spark):
    text = "BEGIN:VEVENT\r\nUID:e1@x\r\nSUMMARY:Long\r\n er: name\r\nATTENDEE;CN=A:mailto:a\r\nATTENDEE;CN=B:mailto:b\r\nEND:VEVENT\r\n"
    event = corpus.calendar_events(spark.createDataFrame([(text,)], "text string")).first()
    assert (event.uid, event.summary, event.attendees, event.location) == ("e1", "Longer: name", ["mailto:a", "mailto:b"], None)
    pages = spark.createDataFrame([("note/a", "[Ann](user/ann) [Ann Lee](people/ann) [A](note/a)")], "slug string, text string")
    stub = corpus.entity_stubs(pages).collect()
    assert [(s.slug, s.title, s.labels) for s in stub] == [("people/ann", "Ann Lee", ["Ann", "Ann Lee"])]


def test_case_rules(spark):
    from recollect.schemas import CASE

    text = "\n".join(f"Item {i}. Choice{i}" for i in range(30)) + "\nthe cue here. Red plan once. Blue plan once."
    case = (
        "c1",
        "b1",
        "positive",
        "Choose exactly one.",
        ("tool_result", "p", None),
        (True, "the cue here", None, None),
        ("m", "memory prose", ["notes/a"], [("notes/a", "notes/a.md", "h", [])], []),
        ("natural_language_choice", ("Red plan",), ("Blue plan",)),
        ([(str(i), "t", []) for i in range(3)],),
        None,
    )
    cases = spark.createDataFrame([case], CASE).withColumn("observation_text", F.lit(text))
    files = spark.createDataFrame([("notes/a.md", "other")], "path string, sha256 string")
    found = {r.message for r in validate.case_issues(cases, files, token_count=lambda t: F.lit(9000)).collect()}
    assert found == {"must contain positive, cue-ablated, and memory-included variants", "source hash mismatch"}
