from collections import Counter

import pytest

from colloquy.llm import sharding


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    a = sharding.lookup(names, 1009)
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    b = sharding.lookup(names[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b) if x != 9)
    assert moved < 0.15 * len(a)
    assert sharding.lookup(1, 2) == [0, 0]
    for bad in ((["x"], 10), ([], 7), (8, 7)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


def test_rows(spark, tmpdir_path):
    rows = [(None, "a"), (None, "b"), (1, None), (1, "x" * 100000), (2, "")]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, shard int, slot string")
    got = sharding.assign(df, ["doc_id"]).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id == 1}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.assign(df.limit(0), ["doc_id"]).collect() == []
    assert all(0 <= r.slot < sharding.SLOTS for r in got)
    # both parts of a key count, and their border does
    pair = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "a string, b string")
    assert len({r.slot for r in sharding.assign(pair, ["a", "b"]).collect()}) == 3
    sharding.write(df, f"{tmpdir_path}/out", ["doc_id"])
    assert spark.read.parquet(f"{tmpdir_path}/out").count() == 5
