import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from colloquy.llm import warc


def plain(rows, smallest):
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= smallest and i is not None:
            first[sha(b)] = min(first.get(sha(b), i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        f = first.get(sha(b)) if len(b) >= smallest else None
        again = f is not None and f != i
        out.append((i, len(b), sha(b), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def sample():
    draw = random.Random(4)
    parts = ["<p>é</p>", "\r\n\r\n", "WARC/1.1\r\n", "日本", "x" * 500, "\n", ""]
    rows = [(i, f"http://h.org/{i}", "".join(draw.choice(parts) for _ in range(draw.randint(0, 6)))) for i in range(200)]
    return rows + [(None, None, "a"), (5, "http://twice", rows[5][2]), (5, "http://twice", rows[5][2]), (900, "u\r\nX: y", None), (901, "http://l", "long " * 400000)]


def test_round_trip(spark, tmpdir_path):
    rows = sample()
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, length int, archive string").repartition(5)
    for smallest, archives in ((0, 7), (50, 1)):
        path = f"{tmpdir_path}/w{smallest}"
        index = warc.write(pages, path, smallest, archives)
        got = warc.read(index).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(rows, smallest)
        html = {r[0]: r[2] or "" for r in rows}
        assert all(r.html == (html[r.page_id] if r.record_type == "response" else "") for r in got)
        # each record lies where the index says, and only the records asked for are read
        for r in index.limit(20).collect():
            with open(r.file.replace("file:", "").replace("//", "/"), "rb") as f:
                f.seek(r.offset)
                assert warc.parse(gzip.decompress(f.read(r.length)))["fields"]["WARC-Type"] == r.record_type
        # an archive as a whole is a chain of gzip members
        one = index.where("archive = 0").orderBy("offset").collect()
        with gzip.open(one[0].file.replace("file:", "").replace("//", "/")) as f:
            assert f.read().count(b"WARC/1.1\r\nWARC-Type: ") >= len(one)
        some = index.where("page_id % 9 = 0")
        assert {r.page_id for r in warc.read(some).collect()} == {i for i in html if i is not None and i % 9 == 0}


def test_ranges_coalesce(spark):
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 40, 5), ("f", 500, 5), ("g", 7, 1)], "file string, offset long, length long")
    got = sorted((r.file, r.start, r.stop, len(r.parts)) for r in warc.ranges(index, gap=100, most=10_000).collect())
    assert got == [("f", 0, 45, 3), ("f", 500, 505, 1), ("g", 7, 8, 1)]


def test_empty(spark, tmpdir_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, f"{tmpdir_path}/none")).collect() == []


def test_tasks_by_bytes(spark, tmpdir_path, monkeypatch):
    """As many writers as archives and as many readers as ranges, though the index is small."""
    monkeypatch.setattr(warc, "RANGE", 20_000)
    draw = random.Random(2)
    rows = [(i, f"u{i}", draw.randbytes(1500).hex()) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    written = warc.tape(pages, archives=9).groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("archive").alias("n")).collect()
    assert [r.n for r in written] == [1] * 9
    index = warc.write(pages, f"{tmpdir_path}/t", archives=9)
    total = index.agg(F.sum("length")).first()[0]
    back = warc.read(index)
    parts = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert total // 20_000 >= 8 and len(parts) >= 5 and sum(parts) == 120
    assert {(r.page_id, r.html) for r in back.collect()} == {(i, h) for i, _, h in rows}
