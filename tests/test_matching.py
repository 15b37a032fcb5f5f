"""Phrases in texts against Python, and what reaches a shuffle on the way."""

import random
import re

from pyspark import SparkContext
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import entities
from recollect.operators.filters import key_filter


def matches(spark, texts, phrases):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame(list(enumerate(phrases)), "pid long, phrase string")
    return entities.substring_matches(docs, wanted, "doc_id", "text", "pid", "phrase")


def test_occurrences_inside_longer_tokens(spark):
    texts = ["xalpha beta gammay", "alpha beta gamma, alpha Beta gamma", "alpha betas gamma", "wow ??? ???", "a–b one two", "xone twox", None, "", "Straße", "o"]
    phrases = ["alpha beta gamma", "???", "one two", "–", "one", "beta", "o", "STRASSE", "no such thing", "zz", "", None]
    got = {(r.doc, r.phrase_id) for r in matches(spark, texts, phrases).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if t and p and p.casefold() in t.casefold()}


def test_short_phrases_of_a_file(spark, tmp_path):
    """A plan that cuts a phrase's tokens before it filters meets phrases of fewer than three."""
    texts, phrases = ["one two three four, One two three", "alone"], ["one two three", "one", "", "on", "?"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(list(enumerate(phrases)), "pid long, phrase string").write.parquet(f"{tmp_path}/p")
    wanted = spark.read.parquet(f"{tmp_path}/p")
    wanted = wanted.select("pid", F.when(F.col("pid") == 0, F.col("phrase")).otherwise(F.array_join(F.slice(T.tokens(F.col("phrase")), 1, 1), " ")).alias("phrase"))
    got = entities.substring_counts(spark.read.parquet(f"{tmp_path}/d"), wanted, "doc_id", "text", "pid", "phrase")
    assert {tuple(r) for r in got.collect()} == {(0, 0, 2), (0, 1, 2), (0, 3, 2), (1, 1, 1), (1, 3, 1)}


def test_counts_leave_the_scan_alone(spark, monkeypatch):
    """Phrases are counted in one scan, without grams of all texts; a null or repeated id and copies of phrases keep their rows."""
    r = random.Random(5)
    texts = ["".join(r.choices("aab. ", k=r.choice([0, 1, 9, 80]))) for _ in range(60)] + ["aaaa", "Straße STRASSE", "İi", "x😀x😀😀", None]
    phrases = ["".join(r.choices("aab. ", k=r.randrange(1, 5))) for _ in range(30)] + ["aa", "AA", "ss", "i̇", "😀", "", None]
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i // 2, p) for i, p in enumerate(phrases)], "pid long, phrase string")
    expected = sorted(
        (str(i // 2 if i % 7 else None), j // 2, t.casefold().count(p.casefold()))
        for i, t in enumerate(texts) for j, p in enumerate(phrases) if t and p and p.casefold() in t.casefold()
    )
    monkeypatch.setattr(entities, "_gram_places", None)
    got = entities.substring_counts(docs, wanted, "doc_id", "text", "pid", "phrase")
    assert sorted((str(r.doc), r.phrase_id, r.n) for r in got.collect()) == expected
    assert entities.substring_counts(docs, wanted.filter("phrase = ''"), "doc_id", "text", "pid", "phrase").collect() == []


def test_strings_that_overlap_themselves():
    words = ["".join(random.Random(n).choices("ab", k=1 + n % 7)) for n in range(80)] + [""]
    assert [entities.overlaps_itself(w) for w in words] == [any(w.startswith(w[i:]) for i in range(1, len(w))) for w in words]


def test_counts_of_many_phrases(spark, monkeypatch):
    monkeypatch.setattr(entities, "AT_ONCE", 0)
    docs = spark.createDataFrame([(1, "one two three one"), (2, "none")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, "one"), (2, "one two three")], "pid long, phrase string")
    got = entities.substring_counts(docs, wanted, "doc_id", "text", "pid", "phrase")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2), (1, 2, 1), (2, 1, 1)}


def test_random_substrings_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(entities, "STRETCH", 40)
    r = random.Random(8)
    texts = ["".join(r.choices("abé .", k=r.choice([0, 1, 5, 60, 500]))) for _ in range(40)]
    phrases = ["".join(r.choices("abé .", k=r.randrange(1, 14))) for _ in range(60)] + [t[37:52] for t in texts if len(t) > 60]
    got = {(r.doc, r.phrase_id) for r in matches(spark, texts, phrases).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t}


def test_short_phrases_make_no_cross_join(spark):
    docs = spark.range(50).selectExpr("id AS doc", "concat('text ', id, ' of words') AS t")
    wanted = spark.range(4).selectExpr("id AS phrase_id", "concat('t ', id) AS p")
    plan = entities.short_candidates(docs, wanted)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filter_keeps_keys_and_little_else(spark):
    keys = spark.range(0, 50_000, 10)
    test = key_filter(keys)
    kept = {x.id for x in spark.range(50_000).filter(test(F.col("id"))).collect()}
    assert set(range(0, 50_000, 10)) <= kept and len(kept) < 5_000 + 0.15 * 45_000
    assert spark.range(9).filter(key_filter(keys.limit(0))(F.col("id"))).count() == 0
    assert spark.createDataFrame([(None,)], "k long").filter(test(F.col("k"))).count() == 0


def test_only_hits_are_shuffled(spark):
    """Rows written by the shuffles of a phrase search grow with the hits, not with the texts."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=150)) + (" needle in hay" if i % 50 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4).cache()
    docs.count()
    phrases = spark.createDataFrame([(1, "needle in hay"), (2, "absent phrase here")], "pid int, phrase string")
    tracker = spark.sparkContext._jsc.sc().statusStore()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = {s.stageId() for s in _stages(tracker)}
        found = entities.phrase_matches(docs, phrases, "id", "text", "pid", "phrase").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        wrote = sum(s.shuffleWriteRecords() for s in _stages(tracker) if s.stageId() not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 12
    spread = 2 * len(rows)  # the texts of few files are dealt over the cores, in each of two passes
    assert wrote - spread < 3_000 < 600 * 150 / 10


def _stages(tracker):
    gateway = SparkContext._gateway
    every = tracker.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [every.apply(i) for i in range(every.size())]


def test_phrases_by_tokens(spark):
    texts = ["The Alpha-Beta of gamma", "alpha betas", "", None, "gamma; alpha beta"]
    phrases = ["alpha beta", "GAMMA", "of", "beta of gamma delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    wanted = spark.createDataFrame(list(enumerate(phrases)), "pid long, phrase string")
    got = {(r.doc, r.phrase_id) for r in entities.phrase_matches(docs, wanted, "id", "text", "pid", "phrase").collect()}
    norm = lambda t: " " + " ".join(re.findall("[a-z0-9]+", (t or "").lower())) + " "
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if norm(p) in norm(t)}


def test_case_folding_of_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x" + chr(c) + "Y" for c in points] + ["ΑΣ ΑΣ.", "İstanbul", "STRASSE ﬃ ŉ", "A\u0000B", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(8)
    made = rows.select("i", T.casefold(F.col("t")).alias("c"), F.concat_ws(" ", T.tokens(F.col("t"))).alias("w")).toPandas().set_index("i").sort_index()
    wrong = [t for t, c in zip(texts, made["c"]) if c != (t.casefold() if t is not None else None)]
    assert wrong == []
    wrong = [t for t, w in zip(texts, made["w"]) if w != " ".join(re.findall("[a-z0-9]+", (t or "").casefold()))]
    assert wrong == []
