"""An index kept up by differences against one built from nothing."""

from pyspark.sql import functions as F

from recollect.operators import postings, upkeep

SCHEMA = "id long, body string, digest string, deleted_at string"


def state(spark, rows):
    """rows: id -> text, or (text,) for one that is marked as deleted."""
    listed = [(k, t[0] if isinstance(t, tuple) else t, None, "2026-01-01" if isinstance(t, tuple) else None) for k, t in rows.items()]
    return spark.createDataFrame(listed, SCHEMA).withColumn("digest", F.sha2(F.coalesce("body", F.lit("")), 256))


def same(spark, kept, rows, tmp_path, name):
    live = {k: t for k, t in rows.items() if not isinstance(t, tuple)}
    table = spark.createDataFrame([(k, t) for k, t in live.items()], "id long, body string")
    fresh = postings.build(table, "id", "body", f"file://{tmp_path}/{name}-fresh")
    assert sorted(map(tuple, kept.counts().collect())) == sorted(map(tuple, fresh.counts.select("doc", "term", "tf", "len").collect()))
    assert kept.statistics() == (fresh.n_docs, fresh.avg_len)
    df = {r.term: r.df for r in fresh.bands.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    assert {r.term: r.df for r in kept.frequencies().collect()} == df
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "new words gamma")], "query_id int, query_text string")
    made = kept.postings(f"file://{tmp_path}/{name}-kept")
    ranked = [sorted((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in postings.best(asked, i, 3).collect()) for i in (made, fresh)]
    assert ranked[0] == ranked[1]


def test_updates_equal_a_build_from_nothing(spark, tmp_path, monkeypatch):
    kept = upkeep.Upkeep(spark, f"file://{tmp_path}/index")
    rows = {1: "alpha beta", 2: "beta beta gamma", 3: "gamma", 4: None, 5: "alpha delta alpha", 6: "last one"}
    assert kept.update(state(spark, rows), "id", "body", "digest") == {"added": 6, "changed": 0, "removed": 0}
    read = []
    true_rows = postings.token_rows
    monkeypatch.setattr(postings, "token_rows", lambda docs, key, text: read.append(sorted(r[key] for r in docs.collect())) or true_rows(docs, key, text))
    rows = rows | {2: "beta new words", 3: ("gamma",), 7: "alpha new"}
    del rows[6]
    assert kept.update(state(spark, rows), "id", "body", "digest") == {"added": 1, "changed": 1, "removed": 2}
    assert read.pop() == [2, 7]  # texts of added and changed documents only
    monkeypatch.undo()
    same(spark, kept, rows, tmp_path, "two")
    rows = rows | {3: "gamma is back", 7: ("alpha new",), 2: "beta beta gamma"}
    again = upkeep.Upkeep(spark, f"file://{tmp_path}/index")
    assert again.update(state(spark, rows), "id", "body", "digest") == {"added": 1, "changed": 1, "removed": 1}
    same(spark, again, rows, tmp_path, "three")
    before = again.segments()
    assert sum(again.update(state(spark, rows), "id", "body", "digest").values()) == 0 and again.segments() == before


def test_everything_may_go(spark, tmp_path):
    kept = upkeep.Upkeep(spark, f"file://{tmp_path}/index")
    assert kept.update(state(spark, {}), "id", "body", "digest") == {"added": 0, "changed": 0, "removed": 0}
    kept.update(state(spark, {1: "a"}), "id", "body", "digest")
    assert kept.update(state(spark, {}), "id", "body", "digest")["removed"] == 1
    assert kept.counts().count() == kept.documents().count() == kept.frequencies().count() == 0 and kept.statistics() == (0, 0.0)
