"""Splittable CSV and JSON readers against readers that take a file whole."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import schemas
from colloquy.sources import readers as RD
from colloquy.sources import records as R

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


@pytest.fixture(params=["250b", "128m"])
def small_ranges(spark, request):
    """Byte ranges of a few lines, so that records lie across many borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(draw):
    return "".join(draw.choice(["x", "é", '"', "\n", ",", " ", "word", "\r\n", "\\", "日", "\n\n", '""']) for _ in range(draw.choice([1, 1, 2, 5, 60])))


def test_csv_equals_a_whole_file_reader(spark, tmpdir_path, small_ranges):
    draw = random.Random(3)
    rows = [[f"r{i}", cells(draw), "é" + cells(draw)] for i in range(60)]
    rows.insert(30, ["long", "line\n" * 300, "z"])
    for name, columns, end in (("one", "abc", "\n"), ("two", "cab", "\r\n")):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if end == "\n" else csv.QUOTE_MINIMAL)
        w.writerow(list(columns))
        w.writerows([[r["abc".index(c)] for c in columns] for r in rows])
        with open(f"{tmpdir_path}/{name}_turn_3.csv", "w", newline="", encoding="utf-8") as f:
            f.write(("﻿" if name == "two" else "") + out.getvalue())
    df = RD.read_by_name(spark, [f"{tmpdir_path}/one_turn_3.csv", f"{tmpdir_path}/two_turn_3.csv"], TEXT)
    if small_ranges != "128m":
        assert df.select("__start").distinct().count() > 15
    got = df.orderBy("__file", "__start", "__n").collect()
    for name in ("one", "two"):
        mine = [[r.a, r.b, r.c] for r in got if f"/{name}_turn" in r["__file"]]
        assert mine == rows, name
    assert all(r.parse_error is None for r in got)
    runs = RD.scan_runs(spark, f"{tmpdir_path}/*.csv", TEXT)
    assert runs.groupBy("model", "turn").count().orderBy("model").collect() == [("one", 3, len(rows)), ("two", 3, len(rows))]


def test_csv_equals_sparks_reader(spark, tmpdir_path, small_ranges):
    """Unquoted, empty and missing cells, blank lines, spaces."""
    text = 'a,b,c\n1,,3\n\n"", x ,\n4,"5"\n6,7,8,9\n"un""quoted",\\,"\n"\n,,\nlast,one,here'
    path = f"{tmpdir_path}/m_turn_1.csv"
    with open(path, "w") as f:
        f.write(text)
    whole = spark.read.schema(TEXT).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    got = RD.read_by_name(spark, path, TEXT)
    assert [tuple(r) for r in got.select("a", "b", "c").orderBy(got["__start"], got["__n"]).collect()] == [tuple(r) for r in whole.collect()]
    assert [r.parse_error for r in got.orderBy("__start", "__n").collect()] == [None, None, "number of cells", "number of cells", None, None, None]


def test_gold_order_and_errors(spark, tmpdir_path, small_ranges):
    rows = [("D", "h", "a\nb"), ("D", "m", 'say "x"'), ("E", "x", "c"), ("E", "", "d")] + [("F", "m", f"label {i}") for i in range(20)]
    with open(f"{tmpdir_path}/gold.csv", "w", newline="") as f:
        csv.writer(f).writerows([("disease", "weight", "symptom"), *rows])
    got = [tuple(r) for r in RD.scan_gold(spark, f"{tmpdir_path}/gold.csv").orderBy("ord").collect()]
    assert got == [(d, i, s, w or None) for i, (d, w, s) in enumerate(rows)]
    bad = sorted((r.symptom, r.error) for r in RD.gold_errors(spark, f"{tmpdir_path}/gold.csv").collect())
    assert bad == [("c", "weight"), ("d", "weight")]


@pytest.mark.parametrize("layout", ["one line", "pretty", "lines"])
def test_json_equals_a_whole_file_reader(spark, tmpdir_path, small_ranges, layout):
    draw = random.Random(4)

    def value():
        return "".join(draw.choice(['"', "\\", "{", "}", "[", "]", ",", "x", "é", "\n", " ", ":", "\\\\"]) for _ in range(draw.choice([0, 2, 9, 80])))
    rows = [{"pid": str(i), "disease_name": value(), "simple_info": {"Chief Complaint": value(), "Age": i, "Hx": [value(), "b"], "o": {"k": value()}}, "extra": [{"a": {}}]} for i in range(40)]
    if layout == "lines":
        text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + draw.choice(["", "\n"])
    else:
        text = json.dumps(rows, ensure_ascii=i) if (i := layout == "one line") else json.dumps(rows, indent=2, ensure_ascii=False) + "\n"
    path = f"{tmpdir_path}/p.json"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    whole = spark.read.schema(schemas.PROFILE).option("multiLine", layout != "lines").json(path)
    got = RD.scan_profiles(spark, path)

    def plain(df):
        """Lists and objects in ``simple_info`` without the blanks around their parts."""
        return sorted((int(r.pid), r.disease_name, [(k, json.loads(v) if k in ("Hx", "o") else v) for k, v in r.simple_info.items()]) for r in df.collect())
    assert plain(got) == plain(whole)
    assert [x[1] for x in plain(got)] == [r["disease_name"] for r in rows]


def test_one_file_is_read_by_many_tasks(spark, tmpdir_path):
    path = f"{tmpdir_path}/big_turn_1.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow("abc")
        w.writerows([i, "x\n" * 20, "y" * 40] for i in range(20_000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = RD.read_by_name(spark, path, TEXT)
        parts = df.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(r["count"] for r in parts) == 20_000 and len(parts) > 8


def test_jobs_do_not_grow_with_the_runs(spark, tmpdir_path):
    def jobs(n):
        folder = f"{tmpdir_path}/{n}"
        spark.range(n).select(F.lit("1").alias("a"), F.lit("2").alias("b"), F.lit("3").alias("c"), F.concat(F.lit("m"), "id").alias("model"), F.lit(1).alias("turn")).write.partitionBy("model", "turn").option("header", True).csv(folder)
        spark.sparkContext.setJobGroup(f"runs{n}", "")
        assert RD.scan_runs(spark, f"{folder}/*/*", TEXT).count() == n
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(f"runs{n}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(ids)
    assert jobs(3) == jobs(12)


def test_an_unclosed_file_and_no_rows(spark, tmpdir_path):
    for name, text in (("open", 'a,b,c\n1,2,"never\nclosed'), ("head", "a,b,c\n")):
        with open(f"{tmpdir_path}/{name}.csv", "w") as f:
            f.write(text)
    assert [r.a for r in RD.read_by_name(spark, f"{tmpdir_path}/open.csv", TEXT).collect()] == ["1"]
    assert RD.read_by_name(spark, f"{tmpdir_path}/head.csv", TEXT).collect() == []
    with open(f"{tmpdir_path}/p.json", "w") as f:
        f.write("[]\n")
    assert RD.scan_profiles(spark, f"{tmpdir_path}/p.json").collect() == []
    assert R.names("﻿x,\"y\nz\"\r") == ["x", "y\nz"]
