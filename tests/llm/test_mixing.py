import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing

SMALL = "/root/testdata/sf0.001"


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), ("d", 0), (None, 300)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights a 1, b 2, c 3, d 1, null 2; a, c and d are full, b and null share the rest
    assert got["a"] == 30 and got["c"] == 15 and got["d"] == 0
    assert got["b"] == got[None] == pytest.approx((1315 - 45) / 2)


def test_schedule_takes_every_block_once_and_evenly(spark):
    targets = spark.createDataFrame([(1, 1000.5), (2, 64.0), (3, 3000.0), (4, 0.0)], "source_no int, target double")
    rows = mixing.schedule(targets, block=10).collect()
    want = {(1, b) for b in range(100)} | {(2, b) for b in range(7)} | {(3, b) for b in range(300)}
    assert {(r.source_no, r.block) for r in rows} == want and len({r.slot for r in rows}) == len(rows) == len(want)
    first = [r.source_no for r in sorted(rows, key=lambda r: r.slot)][:41]
    assert abs(first.count(3) - 41 * 300 / 407) <= 4 and abs(first.count(1) - 41 * 100 / 407) <= 4


def test_hard_rows_rerun_and_sql(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(None, "x y z", "a"), (None, None, None), (3, "dup dup", "b"), (3, "dup dup", "b"), (61, "long " * 30000, "c"), (62, "", "zero"), (63, "", "zero"), (63, "", "zero")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, size int, start string")
    got = sorted((tuple(r) for r in mixing.mix(docs, block=16).collect()), key=repr)
    assert len(got) == len(rows)
    assert got == sorted((tuple(r) for r in mixing.mix(docs.repartition(7), block=16).collect()), key=repr)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = con.execute(mixing.ORACLE.replace("FROM documents", "FROM documents")).fetchall()
    assert [(g[0], g[1], g[2], round(g[3], 6), g[4]) for g in sorted(got, key=lambda g: repr(g[:5]))] == [(w[0], w[1], w[2], round(w[3], 6), w[4]) for w in sorted(want, key=lambda w: repr(w[:5]))]
    assert mixing.mix(docs.limit(0)).collect() == []
    out = mixing.repeat(docs)
    assert out.schema == docs.schema and out.where("size(split(text, ' ')) = 0").count() == 0


def test_taken_words_meet_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.mix(docs, ["doc_id", "source"])
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    assert all(r.t == int(r.x) for r in per)
    assert got.where("taken > 3 * size").count() == 0


def test_first_slots_of_a_small_mix(spark):
    """Straight from the definition: slot by slot along the schedule."""
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(5, "a"), (0, "a"), (40, "b"), (7, "b"), (13, "c"), (3, "c"), (1, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    line, targets = mixing.streams(docs, ["doc_id"])
    slots = {(r.source_no, r.block): r.slot for r in mixing.schedule(targets.select("source_no", "target"), 4).collect()}
    got = {r.doc_id: r.first_slot for r in mixing.mix(docs, block=4).collect()}
    for r in line.collect():
        end = int(r.target)
        taken = [w for e in range(3) for w in range(r.start + e * r.source_size, min(end, r.start + e * r.source_size + r.size))]
        assert got[r.doc_id] == min((slots[r.source_no, w // 4] for w in taken), default=None)


def test_repeat_keeps_every_source_near_its_target_and_in_step(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i % 9), "abc"[i % 3]) for i in range(900)] + [(2000, words(10_000), "d"), (3000, words(3), "e"), (3001, "", "f")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, slot int, __key string")
    target = {r.source: r.target for r in mixing.mix(docs, ["source"]).select("source", "target").distinct().collect()}
    out = mixing.repeat(docs, block=8)
    assert out.schema == docs.schema
    got = out.select("doc_id", "source", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    per = {}
    for r in got:
        per[r.source] = per.get(r.source, 0) + size[r.doc_id]
    assert "f" not in per and set(per) == set("abcde")
    for s in "abc":
        assert abs(per[s] - target[s]) <= 9 / 2
    assert per["d"] == 10_000  # one document, whole or not at all
    # every prefix of the mix holds the small sources in about their shares
    order = [r.source for r in sorted(got, key=lambda r: r.at) if r.source in "abc"]
    share = {s: order.count(s) / len(order) for s in "abc"}
    for n in range(50, len(order), 25):
        for s in "abc":
            assert abs(order[:n].count(s) - n * share[s]) <= 12


def test_one_long_document_never_leaves_its_source_empty(spark):
    rows = [(1, " ".join(["w"] * 10_000), "a"), (2, "x", "b"), (3, "y", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.target for r in mixing.mix(docs).where("doc_id = 1").collect()} != {10_000.0}
    assert sorted(r.doc_id for r in mixing.repeat(docs).collect()).count(1) == 1
