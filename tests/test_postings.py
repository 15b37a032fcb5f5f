"""The postings index against scoring by hand, and what it reads."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recollect import queries
from recollect.operators import lexical, postings


def by_hand(asked, docs, k):
    toks = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / max(1, len(toks))
    df = Counter(t for words in toks.values() for t in set(words))
    out = {}
    for q, text in asked:
        scores = {}
        for t, mult in Counter(re.findall("[a-z0-9]+", text.lower())).items():
            for d, words in toks.items():
                if tf := words.count(t):
                    part = mult * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
                    scores[d] = scores.get(d, 0) + part
        for rank, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 12), d))[:k], 1):
            out[q, rank] = (d, round(scores[d], 9))
    return out


def corpus(n=300, seed=3):
    """Words with the frequencies of a language: some in most texts, most in few."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    freq = [1 / (i + 1) for i in range(600)]
    docs = [(f"d{i:04}", " ".join(r.choices(words, freq, k=r.randrange(1, 120)))) for i in range(n)]
    docs += [("e0", ""), ("e1", "?!"), ("e2", docs[4][1]), ("e3", docs[4][1])]
    asked = [(i, " ".join(r.choices(words, freq, k=r.randrange(1, 12)))) for i in range(25)]
    asked += [(100, docs[4][1]), (101, "w0 w0 w0 w599"), (102, "unknown words"), (103, "w3")]
    return docs, asked


def got(frame):
    return {(r.query_id, r["rank"]): (r.doc, round(r.score, 9)) for r in frame.collect()}


@pytest.mark.parametrize("shard,chunk,unread", [(4096, 512, 0.25), (40, 7, 0.9)])
def test_stored_and_one_off_ranks(spark, tmp_path, monkeypatch, shard, chunk, unread):
    for name, value in (("SHARD", shard), ("CHUNK", chunk), ("UNREAD", unread), ("SAVED", 0.0), ("LEADS", 8)):
        monkeypatch.setattr(postings, name, value)
    docs, asked = corpus()
    texts, wanted = spark.createDataFrame(docs, "id string, body string"), spark.createDataFrame(asked, "query_id int, query_text string")
    path = f"file://{tmp_path}/index"
    index = postings.build(texts, "id", "body", path)
    expected = by_hand(asked, docs, 5)
    assert got(postings.best(wanted, postings.read(spark, path), 5)) == expected
    assert got(postings.rank_once(wanted, texts, "id", "body", 5)) == expected
    assert got(lexical.bm25_rank(wanted, texts, 5, "id", "body", index)) == expected
    every = postings.top_k(postings.all_scores(wanted, index), 5)
    assert got(every) == expected


def test_frequent_words_stay_unread(spark, tmp_path):
    docs, _ = corpus(1200)
    wanted = spark.createDataFrame([(i, f"w0 w1 w2 w{200 + i}") for i in range(25)], "query_id int, query_text string")
    index = postings.build(spark.createDataFrame(docs, "id string, body string"), "id", "body", f"file://{tmp_path}/index")
    read = postings.reading(wanted, index, 3).agg({"postings": "sum", "unread": "sum"}).first()
    assert read["sum(unread)"] > 0.2 * read["sum(postings)"]


def test_hot_terms_lie_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SHARD", 20)
    docs = spark.range(500).selectExpr("id", "concat('every ', id) AS body")
    index = postings.build(docs, "id", "body", f"file://{tmp_path}/index")
    sizes = [r.n for r in index.blocks.filter("term = 'every'").collect()]
    assert sum(sizes) == 500 and len(sizes) == 25 and max(sizes) < 60


def scans(spark, path, run):
    """Scans of ``path`` in the plans that ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: {e.executionId(): e.physicalPlanDescription() for e in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    before = set(listed())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    plans = [plan for k, plan in listed().items() if k not in before]
    return sum(len(re.findall(rf"Location: InMemoryFileIndex[^\n]*{re.escape(path)}", p)) for p in plans)


def test_texts_are_scanned_once(spark):
    sf = "/root/testdata/sf0.001"
    assert scans(spark, f"{sf}/documents.parquet", lambda: queries.QUERIES["bm25_body_topk"](spark, sf).collect()) == 1


def test_empty_tables(spark, tmp_path):
    docs, asked = spark.createDataFrame([], "id long, body string"), spark.createDataFrame([(1, "a")], "query_id int, query_text string")
    assert lexical.bm25_rank(asked, docs, 3, "id", "body").collect() == []
    index = postings.build(docs, "id", "body", f"file://{tmp_path}/index")
    assert postings.best(asked, index, 3).collect() == [] and postings.best(asked.limit(0), index, 3).collect() == []


def test_order_of_terms_changes_no_score(spark):
    """Copies of a long text have the same score to the last bit, in whatever order a task meets their terms."""
    r = random.Random(5)
    weight = {f"w{i}": r.uniform(0.5, 9) for i in range(160)}
    rows = [(doc, t, r.randrange(1, 4)) for doc in range(40) for t in r.sample(sorted(weight), k=160)]
    tf = {t: n for _, t, n in rows}
    met = spark.createDataFrame([(0, doc, t, tf[t], 160, weight[t]) for doc, t, _ in rows], "query_id long, doc long, term string, tf int, len int, weight double").coalesce(1)
    index = postings.Postings(None, None, None, 40, 100.0, "")
    assert len({x.score for x in postings.scored(met, index).collect()}) == 1
    blocks = met.selectExpr("term", "int(doc) AS salt", "array(struct(doc, tf, len)) AS entries")
    zero = "0D AS least, 0D AS rest, 0D AS theta"
    asked = met.filter("doc = 0").selectExpr("query_id", "term", "weight", *zero.split(", "))
    found = postings.candidates(asked, blocks, ["term"], 100.0, 5, 40).collect()
    assert len(found) == 40 and len({x.partial for x in found}) == 1


def test_postings_are_shuffled_once_for_all_queries(spark, monkeypatch):
    """Cells of few queries: a posting reaches the workers once, not once for every cell of queries."""
    monkeypatch.setattr(postings, "CHUNK", 2)
    blocks = spark.range(40).selectExpr("concat('t', id % 2) AS term", "int(id % 4) AS salt", "array(struct(id AS doc, 1 AS tf, 10 AS len)) AS entries")
    zero = ("0D AS least", "0D AS rest", "0D AS theta")
    asked = spark.range(30).selectExpr("id AS query_id", "concat('t', id % 2) AS term", "double(id + 1) AS weight", *zero)
    met = postings._candidates_of(asked, blocks, ["term"], 10.0, 3, 40)
    assert len({(r.query_id, r.doc) for r in met.collect()}) == 30 * 20  # all tie
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_best_sums_of_a_task_hold_no_matrices():
    """What a task keeps for a query are its k best sums, however many queries and documents its cells have."""
    r, tops, seen = np.random.default_rng(1), {}, {}
    for cell in range(4):
        for start in range(0, 40, 10):
            numbers = list(range(start, start + 10))
            sums = r.random((10, 300))
            seen |= {n: np.r_[seen.get(n, np.zeros(0)), row] for n, row in zip(numbers, sums)}
            least = postings.kth_best(tops, numbers, sums, 5)
            assert least.tolist() == [np.sort(seen[n])[-5] for n in numbers]
    assert all(np.sort(best).tolist() == np.sort(seen[n])[-5:].tolist() for n, best in tops.items())
    assert sum((best if best.base is None else best.base).nbytes for best in tops.values()) == 40 * 5 * 8
    assert postings.kth_best({}, [1, 2], np.ones((2, 3)), 5).tolist() == [0.0, 0.0]


def test_cells_of_several_strips(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("STRIP", 3)):
        monkeypatch.setattr(postings, name, value)
    docs, asked = corpus()
    texts, wanted = spark.createDataFrame(docs, "id string, body string"), spark.createDataFrame(asked, "query_id int, query_text string")
    assert got(postings.rank_once(wanted, texts, "id", "body", 5)) == by_hand(asked, docs, 5)
