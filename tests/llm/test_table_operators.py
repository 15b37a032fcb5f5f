"""Joins, dedup, mixing, chat, URLs and the pipeline against brute force."""

import json
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import chat, embed_dedup, mixing, ngram_join, secret_scan, toxicity, url_filter, util
from recollect.llm.queries import PLANTED
from recollect.llm.util import components, tuned

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


class Sets:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    sets = Sets(400)
    for a, b in edges:
        sets.join(a, b)
    got = {x.node: x.component for x in components(tuned(spark).createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_stars_take_few_stages(spark):
    edges = [(100 * k, 100 * k + i) for k in range(1, 30) for i in range(1, 4)]
    tracker, group = spark.sparkContext.statusTracker(), "components of stars"
    table = tuned(spark).createDataFrame(edges, "u long, v long").coalesce(1)
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {(x.node, x.component) for x in components(table).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(v, u) for u, v in edges} | {(u, u) for u, _ in edges}
    assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)) <= 12


def test_forests_keep_the_pairs_of_a_node_together(monkeypatch):
    monkeypatch.setattr(util, "FOREST", 2)
    pairs = [(9, 1), (9, 2), (9, 3), (9, 4), (20, 5), (20, 6)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["u", "v"]) for rows in (pairs[:2], pairs[2:])]
    found = [sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for b in util._forest(iter(batches))]
    assert found == [[(2, 1), (3, 1), (4, 1), (9, 1)], [(6, 5), (20, 5)]]


# -- n-gram Jaccard join ----------------------------------------------------------


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_jaccard(rows):
    found, sets = [shingle_set(t) for _, t in rows], Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= 75 * len(found[i] | found[j]):
                sets.join(i, j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[sets.find(i)] = min(k, least.get(sets.find(i), k))
    return sorted(((k, len(found[i]), least.get(sets.find(i)) if found[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def noisy(r, words, share):
    return [r.choice("pqrstuvw") * 3 + str(r.randrange(10**6)) if r.random() < share else w for w in words]


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(40):
        rows.append(" ".join(passage + [r.choice(vocab) for _ in range(r.randrange(5, 120))]))
    for base in range(3):
        words = [r.choice(vocab) for _ in range(150)]
        for _ in range(45 if base == 0 else 6):
            rows.append(" ".join(noisy(r, words, r.choice([0, 0.01, 0.02, 0.03, 0.06]))))
    rows += ["One Two three", "one two THREE", "one two", "", None, " \t\n", "a b c d e", "A b c d e f", "x" * 50_000]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [
        (None, rows[0]),
        (None, "lonely words without any other copy"),
        (5_000, rows[41]),
        (5_000, rows[41]),
    ]


@pytest.mark.parametrize("block", [4, 128])
def test_jaccard_join_is_exact(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    rows = corpus(block)
    table = tuned(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, ngram_join.jaccard_components(table).collect()), key=str)
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("n", [200, 800])
def test_jaccard_tables_grow_with_the_rows_of_a_group(spark, n, monkeypatch):
    """Near copies of one to three edits: every table that the join writes stays linear in their number."""
    r = random.Random(n)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        edited = list(words)
        for at in r.sample(range(150), r.randrange(1, 4)):
            edited[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    counted = {}
    real = ngram_join.cut

    def cut(df, tag):
        out = real(df, tag)
        counted[tag] = max(counted.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    table = tuned(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, ngram_join.jaccard_components(table).collect()), key=str)
    assert got == brute_jaccard(rows)
    widest = 150 * 4 / 7  # shingles in a prefix, at most
    assert all(k <= n * widest for k in counted.values()), counted
    assert counted["near"] <= 4 * n and counted["links"] <= 3 * n, counted


def test_jaccard_leaves_no_shuffle_files(spark):
    """Files of finished steps do not wait for the driver's garbage collector."""

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before, name = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to = spark.conf.get(name, None)
    table = tuned(spark).createDataFrame(corpus(4), "doc_id long, text string").repartition(4)
    ngram_join.jaccard_components(table)
    for _ in range(50):  # files are deleted beside the next step
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get(name, None) == set_to


def test_jaccard_links_through_rows_without_key(spark):
    words = [f"w{i}" for i in range(120)]
    a, b, c = (" ".join(words[k : k + 100]) for k in (0, 8, 16))  # a ~ b ~ c, a and c unlike
    for key in (3, None):
        rows = [(1, a), (key, b), (2, c), (4, "other words that stand alone here")]
        table = tuned(spark).createDataFrame(rows, "doc_id long, text string")
        got = sorted(map(tuple, ngram_join.jaccard_components(table).collect()), key=str)
        assert got == brute_jaccard(rows)
        assert {r[2] for r in got if r[0] in (1, 2)} == {1}


def test_overlaps_are_exact():
    r = np.random.default_rng(2)
    left, right = ([np.unique(r.integers(0, 9000, r.integers(1, 6000), dtype=np.uint64)) for _ in range(k)] for k in (5, 7))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert ngram_join.overlaps(left, right).tolist() == want
    assert ngram_join.overlaps(left[:1], right).tolist() == want[:1]


def test_jaccard_empty_table_and_keep_one(spark):
    empty = tuned(spark).createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).count() == 0
    rows = corpus(9)
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    kept = [r.doc_id for r in ngram_join.keep_one(table).collect()]
    want = [k for k, n, c in brute_jaccard(rows) if n == 0 or k == c]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_keep_one_with_unlike_texts_of_one_id(spark):
    words = [f"word{i}" for i in range(400)]
    a, b, c, d = (" ".join(words[100 * i : 100 * i + 100]) for i in range(4))
    near_a = a + " more"
    rows = [(1, a), (5, near_a), (5, b), (5, c), (5, b), (5, ""), (5, None), (7, d + " x"), (7, d), (7, c), (None, a)]
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS).repartition(3)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(table).collect()]
    want = [(1, a), (5, b), (5, c), (5, ""), (5, None), (7, d)]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_keep_one_keeps_clashing_columns_and_rows_without_key(spark):
    words = [f"word{i}" for i in range(100)]
    a = " ".join(words)
    rows = [(None, a, 1, "x"), (None, a + " more", 2, "y"), (None, "alone among all the others", 3, "z"), (None, None, 4, "w"), (None, "", 5, "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _id int, _doubted string").repartition(2)
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, (r for k, r in enumerate(rows) if k != 1)))


def test_bitmaps_never_overstate():
    r = np.random.default_rng(0)
    for n in (1, 5, 100, 3000, 60_000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: len(a) * 9 // 10], r.integers(0, 2**63, n // 5 + 1, dtype=np.uint64)])
        differ = len(np.setxor1d(a, b))
        assert ngram_join._differ([ngram_join.bitmap(a)], [ngram_join.bitmap(b)])[0] <= differ
        assert (ngram_join.unpack(ngram_join.pack(a >> np.uint64(16))) == a >> np.uint64(16)).all()


# -- embeddings -------------------------------------------------------------------


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    r = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = r.standard_normal(16)
        for _ in range(60 if c == 0 else 5):
            rows.append((centre + 0.05 * r.standard_normal(16)).tolist())
    rows += [r.standard_normal(16).tolist() for _ in range(60)]
    rows += [
        rows[3],
        rows[3],
        [2 * x for x in rows[3]],
        [0.0] * 16,
        None,
        [float("nan")] * 16,
        [float("inf")] + [0.0] * 15,
        [1.0, None] + [0.0] * 14,
        [],
        [1.0, 2.0],
    ]
    table = tuned(spark).createDataFrame([(i + 10, v) for i, v in enumerate(rows)] + [(None, rows[0]), (10, rows[0])], "vec_id long, embedding array<double>")
    got = {g.vec_id: g for g in embed_dedup.near_duplicates(table).collect()}
    fine = [i for i, v in enumerate(rows) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i] for i in fine])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    sets = Sets(len(rows))
    for a, b in zip(*np.nonzero(links)):
        sets.join(fine[a], fine[b])
    degree = dict(zip(fine, links.sum(axis=1).tolist()))
    assert len(got) == len(rows) + 1 and got[None].n_links == 0 and got[None].component_id is None
    assert all(got[i + 10].n_links <= degree.get(i, 0) for i in range(len(rows)))
    assert sum(g.n_links for g in got.values()) >= 0.9 * sum(degree.values())
    assert all(got[i + 10].kept == (got[i + 10].component_id == i + 10) for i in range(len(rows)))
    assert all(sets.find(got[i + 10].component_id - 10) == sets.find(i) for i in range(len(rows)))
    assert embed_dedup.near_duplicates(table.filter("false")).count() == 0


def test_recall_plan():
    for n in (10, 10_000, 10**9):
        k, tables = embed_dedup.plan(n, 0.95, 0.95)
        assert 1 - (1 - embed_dedup.meet(math.sqrt(0.1)) ** k) ** tables >= 0.95


def test_embeddings_with_repeated_ids(spark):
    r = np.random.default_rng(9)
    a, b, c = (r.standard_normal(8).tolist() for _ in range(3))
    rows = [(5, a), (5, b), (5, a), (7, a), (3, b), (9, c), (9, [2 * x for x in c])]
    table = tuned(spark).createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("class", F.lit("x"))
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embed_dedup.near_duplicates(table).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True)]


# -- mixing -----------------------------------------------------------------------


def test_mixing_follows_weights(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "a" if i % 3 else ("b" if i % 2 else None), 1) for i in range(6000)]
    table = tuned(spark).createDataFrame(rows, DOCS)
    out = mixing.mix(table, {"a": 1.0, "b": 2.0}, seed=3)
    got = out.collect()
    assert set(out.columns) == {*table.columns, "copy", "n_copies", "mix_key"}
    share = {s: sum(len(r.text) for r in got if r.source == s) / sum(len(r.text) for r in got) for s in ("a", "b", None)}
    assert abs(share["a"] - 0.25) < 0.02 and abs(share["b"] - 0.5) < 0.02 and abs(share[None] - 0.25) < 0.02
    again = mixing.mix(table.repartition(7), {"a": 1.0, "b": 2.0}, seed=3).collect()
    assert sorted((r.doc_id, r.copy) for r in got) == sorted((r.doc_id, r.copy) for r in again)
    counts = {}
    for r in got:
        counts.setdefault(r.doc_id, []).append((r.copy, r.n_copies))
    assert all(sorted(c for c, _ in v) == list(range(v[0][1])) for v in counts.values())
    # Dealt out: within each task by key, whose order has nothing to do with the order of ids or sources.
    placed = out.select("doc_id", "source", "copy", "mix_key", F.spark_partition_id().alias("p")).collect()
    for p in {r.p for r in placed}:
        keys = [r.mix_key for r in placed if r.p == p]
        assert keys == sorted(keys)
    ids = [r.doc_id for r in sorted(placed, key=lambda r: r.mix_key)]
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.1
    sources = [r.source for r in placed]
    runs = 1 + sum(a != b for a, b in zip(sources, sources[1:]))
    by_chance = len(sources) * (1 - sum((sources.count(x) / len(sources)) ** 2 for x in set(sources)))
    assert runs > 0.8 * by_chance
    assert mixing.mix(table.filter("false"), {}).count() == 0
    odd = spark.createDataFrame([(1, None, "en", "a", 0), (2, None, "en", "b", 0)], DOCS)
    assert mixing.mix(odd, {}).count() == 0
    clash = table.withColumn("mix_rate", F.lit("r")).withColumn("mix_source", F.lit("s")).withColumn("Copy", F.lit(9))
    other = mixing.mix(clash, {"a": 1.0, "b": 2.0}, seed=3).collect()
    assert sorted((r.doc_id, r.copy) for r in other) == sorted((r.doc_id, r.copy) for r in got) and {(r.mix_rate, r.mix_source) for r in other} == {("r", "s")}


def test_a_source_of_one_character(spark, monkeypatch):
    """A high rate is drawn in chunks: the same copies as in one piece, and none of the rows holds them all."""
    rows = [(1, "x", "en", "tiny", 1), (1, "x", "en", "tiny", 1)] + [(k, "y" * 50, "en", "big", 50) for k in range(2, 40)]
    table = tuned(spark).createDataFrame(rows, DOCS)
    whole = sorted((r.doc_id, r.copy, r.n_copies, r.mix_key) for r in mixing.mix(table, {}).collect())
    monkeypatch.setattr(mixing, "CHUNK", 3)
    cut = sorted((r.doc_id, r.copy, r.n_copies, r.mix_key) for r in mixing.mix(table, {}).collect())
    assert cut == whole and max(n for *_, n, _ in whole) > 400
    rate = spark.range(1).select(mixing.drawn_count(F.lit(4e10), F.lit("1"), 17, F.lit(1 << 31), F.lit(5)).alias("n")).first().n
    assert 30 < rate < 140


@pytest.mark.parametrize("rate", [0.01, 1.0, 5.5, 16.0])
def test_quantile_is_poisson(spark, rate):
    u = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999999]
    got = [r.k for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.quantile(F.lit(rate), F.col("u")).alias("k")).collect()]
    for x, k in zip(u, got):
        cdf, p, want = math.exp(-rate), math.exp(-rate), 0
        while cdf <= x:
            want += 1
            p *= rate / want
            cdf += p
        assert k == want


# -- chat --------------------------------------------------------------------------

LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "share", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": None}, "question_answer", [("user", "p"), ("assistant", "")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"odd": 1}, None, None),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "text": "lost"}]}, None, None),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}]}, None, None),
    ({"messages": [{"role": "user", "content": "q"}, "assistant"]}, None, None),
    ({"messages": [{"role": "user", "content": ["q"]}]}, None, None),
    ({"messages": [{"role": "user", "content": {"q": 1}}]}, None, None),
    ({"messages": [{"role": "user", "content": None}, {"role": None, "content": "[1]"}]}, "messages", [("user", ""), ("", "[1]")]),
    ({"prompt": ["p"], "completion": "c"}, None, None),
    ({"prompt": {"p": 1}, "completion": "c"}, None, None),
    ({"prompt": '{"p": 1}', "completion": 5}, "prompt_completion", [("user", '{"p": 1}'), ("assistant", "5")]),
]


def test_layouts(spark):
    table = tuned(spark).createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(98, None), (99, "no json")], "id int, record string")
    got = {r.id: r for r in chat.format_chat(table).collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[i].layout == layout and (got[i].turns and [tuple(t) for t in got[i].turns]) == turns, LAYOUTS[i]
    assert got[8].formatted == "" and got[8].loss_spans == []
    clash = chat.format_chat(
        table.select("id", "record", F.lit("x").alias("turns"), F.lit(1).alias("formatted"), F.lit("kept").alias("other")),
    ).filter("id = 0").first()
    assert clash.formatted == got[0].formatted and clash.other == "kept" and clash.turns == got[0].turns
    assert got[7].fingerprint and got[98].layout is None and got[99].turns is None


def test_template_is_reversible(spark):
    r = random.Random(6)
    bits = [PLANTED, "\\", "</turn>", "### ", "#", "\\b", "\\t", "\\h", "\\c", ": ", "é😀", "\n", "text", "### user: ", "<", "/turn>"]
    rows = [
        (
            c,
            t,
            r.choice(["user", "assistant", "a: b", "### x", None]),
            "".join(r.choice(bits) for _ in range(r.randrange(8))) or None,
        ) for c in range(60) for t in range(r.randrange(1, 5))
    ]
    table = tuned(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(chat.rows_to_records(table))
    back = out.select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(c, []).append((role or "", text or ""))
    for row in back:
        assert [tuple(t) for t in row.turns] == want[row.conv_id]
        assert row.loss == "".join(t for role, t in want[row.conv_id] if role == "assistant")
    assert chat.format_chat(chat.rows_to_records(table.filter("false"))).count() == 0


def test_many_rules_of_unlike_shapes(spark):
    rules = [("com", "/" + "a" * k, "block" if k % 2 else "allow", 0) for k in range(400)]
    table = tuned(spark).createDataFrame(rules, "host string, path string, verdict string, tier int")
    pages = spark.createDataFrame([(k, f"http://x.com/{'a' * k}b") for k in (0, 1, 7, 250, 399, 500)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, table).collect()}
    assert all(got[k].verdict == ("block" if min(k, 399) % 2 else "allow") and got[k].rule == "com/" + "a" * min(k, 399) for k in got)


# -- URLs ----------------------------------------------------------------------------

RULES = [
    ("com", "/en/", "block", 0),
    ("example.com", "/en/7", "allow", 0),
    ("net", "/", "block", 1),
    ("a.net", "/x", "allow", 1),
    ("twice.org", "/", "allow", 0),
    ("twice.org", "/", "block", 0),
]
URLS = [
    "https://m.Example.COM/en/71?q",
    "http://x.com/en/",
    "http://com/en/7",
    "notexample.com/en/",
    None,
    "",
    "ftp://a.net/xy#z",
    "ftp://b.net",
    "https://b.net/",
    "http://TWICE.org/a",
    "http://x.com/EN/",
    "a://b://c.net/",
    "http://example.com/en/7",
    "http://example.com/en/7",
]


def test_url_rules(spark):
    rules = tuned(spark).createDataFrame(RULES, "host string, path string, verdict string, tier int")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("path", F.lit("clash"))
    got = url_filter.judge(pages, rules).orderBy("page_id").collect()
    assert len(got) == len(URLS)
    for row, url in zip(got, URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [
            (-t, len(h + p), len(h), v == "block", h + p, v, t) for h, p, v, t in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        assert (row.host, row.path) == (host, path)
        assert row.verdict == (best[5] if best else "allow")
        assert row.rule == (best[4] if best and best[6] == 0 else None) and row.method_rule == (best[4] if best and best[6] else None)
    assert url_filter.judge(pages, rules.filter("false")).filter("verdict = 'allow'").count() == len(URLS)
    assert url_filter.judge(pages.filter("false"), rules).count() == 0


# -- pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "er", "ing", "ou", "est")]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(120)]
    toxic = {i for i in range(0, 120, 5)}
    texts = [t + (" moron moron" if i in toxic else "") for i, t in enumerate(texts)]
    texts[7] = texts[6]
    texts[8] += ' token = "abcdef0123"'
    sf = str(tmp_path)
    table = tuned(spark).createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS)
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = C.drop_toxic(spark, docs, sf)
    assert {x.doc_id for x in clean.collect()} == set(range(120)) - toxic
    single = C.drop_near_duplicates(spark, docs, sf)
    assert {x.doc_id for x in single.collect()} == set(range(120)) - {7} and single.columns == docs.columns
    safe = {x.doc_id: x for x in C.redact_secrets(spark, docs, sf).collect()}
    assert not any(secret_scan.find(x.text) for x in safe.values()) and safe[8].n_chars == len(safe[8].text) and safe[9].text == texts[9]
    out = C.run(spark, sf).collect()
    assert {x.doc_id for x in out} <= set(range(120)) - toxic - {7} and all(x.library_agrees for x in out)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as C

    sf = str(tmp_path)
    words = [f"w{i}" for i in range(60)]
    copy = " ".join(words)
    rows = [
        (1, copy, "en", "a", 1),
        (1, copy, "en", "a", 1),
        (2, copy + " more", None, "b", 1),
        (None, copy, "en", None, 1),
        (3, None, "en", None, None),
        (4, "", "de", "b", 0),
        (None, "alone here", "en", "a", 1),
    ]
    table = tuned(spark).createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1))
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in C.STAGES[:3]:
        kept = stage(spark, kept, sf)
        assert tuple(kept.columns) == C.COLUMNS
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(
            map(str, [(r[0], r[1]) for r in rows] if name == "toxicity" else [(1, copy), (3, None), (4, ""), (None, "alone here")])
        )
    out = C.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= {1, 3, 4, None} and all(r.library_agrees for r in out)
    spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(f"{sf}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/none/labels.parquet")
    assert C.run(spark, f"{sf}/none").count() == 0
