"""Scratch tables, Bloom filters and small helpers."""

import os

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm.util import bloom_hits, bloom_of, cut, drop, free, runs, scratch, tuned, unlike


def there(table):
    return os.path.exists(table._recollect_path.removeprefix("file:").replace("//", "/"))


def test_bloom_filters_hold_every_key(spark):
    r = np.random.default_rng(4)
    keys = r.integers(-(2**62), 2**62, 20_000)
    rows = tuned(spark).createDataFrame([(int(k),) for k in keys] + [(None,)], "k long").repartition(7)
    bits = bloom_of(rows, "k").value
    assert bloom_hits(bits, keys).all()
    assert bloom_hits(bits, r.integers(-(2**62), 2**62, 20_000)).mean() < 0.05
    assert not bloom_hits(bloom_of(rows.filter("false"), "k").value, keys).any()


def test_scratch_tables_go(spark):
    table = tuned(spark).range(5)
    with scratch() as kept:
        lost = cut(table, "lost")
        stays = kept(cut(table, "stays"))
        with scratch():
            inner = cut(table, "inner")
        assert there(lost) and there(stays) and not there(inner)
    assert there(stays) and not there(lost) and stays.count() == 5
    with pytest.raises(ZeroDivisionError), scratch():
        lost = cut(table, "lost")
        1 / 0
    assert not there(lost)
    drop(stays, table)
    assert not there(stays)


def test_names_and_runs(spark):
    table = spark.createDataFrame([(1, 2)], "Mark int, mark_ int")
    assert free("mark", table) == "mark__" and free("other", table) == "other"
    with pytest.raises(ValueError):
        unlike(["a", "Score"], ("score",))
    unlike(["a"], ("score",))
    parts = (([1, 1], ["a", "b"]), ([1, 2], ["c", "d"]), ([], []), ([2], ["e"]))
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "v": pa.array(v, pa.string())}) for k, v in parts]
    assert list(runs(iter(batches))) == [((1,), [("a",), ("b",), ("c",)]), ((2,), [("d",), ("e",)])]
