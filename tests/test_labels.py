"""Joins by disease: whole results, dealt to many tasks, rows that files store in few bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import labels as L

GOLD = "disease string, ord bigint, symptom string, weight string"


def _tables(spark):
    gold = spark.createDataFrame([("d0", i, f"s{i}", "h" if i % 2 else None) for i in range(40)] + [("d1", 90, "x", "m"), ("d1", 90, "x", "m"), (None, 91, "n", "m")], GOLD)
    dialogues = spark.createDataFrame([(i, "d0") for i in range(300)] + [(300, "d1"), (300, "d1"), (301, "d9"), (302, None), (None, "d1")], "dialogue_id bigint, disease string")
    return dialogues, gold


def test_join_gold_is_whole_and_dealt(spark):
    dialogues, gold = _tables(spark)
    got = L.join_gold(dialogues, gold)
    g = gold.withColumnRenamed("disease", "g")
    plain = dialogues.join(g, F.col("disease") == F.col("g"), "left").drop("g")
    assert got.columns == plain.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    at = got.where("disease = 'd0'").withColumn("p", F.spark_partition_id()).collect()
    parts: dict[int, list[int]] = {}
    for r in at:
        parts.setdefault(r.p, []).append(r.ord)
    assert len(parts) > 3
    for ords in parts.values():  # a label's rows come together
        assert sum(a != b for a, b in zip(ords, ords[1:])) < 2 * len(set(ords)) * L.SALTS
        assert sum(a == b for a, b in zip(ords, ords[1:])) > len(ords) / 2


def test_lists_of_dialogues_are_whole_and_dealt(spark):
    dialogues, gold = _tables(spark)
    got = L.dialogue_lists(dialogues, gold)
    texts = {r.disease: r.gold_list for r in L.gold_list_text(gold).collect() if r.disease}
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((*r, texts.get(r[1]))) for r in map(tuple, dialogues.collect()))
    assert got.where("disease = 'd0'").select(F.spark_partition_id().alias("p")).distinct().count() > 3


def _groups(path):
    """Row groups of a folder's files, in rows, and their column chunks of ``gold_list`` or ``symptom``."""
    import glob

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/*.parquet"))]
    return [m.row_group(i) for m in files for i in range(m.num_row_groups)]


def _sf(spark, path, labels, dialogues):
    """part and orders with ``labels`` labels of one brand and ``dialogues`` customers that have it."""
    spark.range(labels).selectExpr("id AS p_partkey", "'Brand#11' AS p_brand", "concat('TYPE ', sha2(cast(id as string), 512)) AS p_type",
                                   "cast(4 as int) AS p_size").coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.range(dialogues).selectExpr("id AS o_orderkey", "id * 30 AS o_custkey", "'O' AS o_orderstatus", "'1' AS o_orderpriority").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


def test_lists_beyond_the_dictionary_limit_are_written_once_a_file(spark, tmpdir_path):
    """Lists of over 1 MB: a file holds one copy and not one per dialogue, and no page of 100 rows is built."""
    from colloquy.plans.catalog import QUERIES

    keep = {k: spark.conf.get(k, None) for k in ("parquet.page.size.row.check.min", "parquet.dictionary.page.size")}
    d = _sf(spark, f"{tmpdir_path}/in", 12_000, 640)
    got = QUERIES["gold_list_text"](spark, d)
    got.write.parquet(f"{tmpdir_path}/out")
    assert {k: spark.conf.get(k, None) for k in keep} == keep  # the caller's session is as it was
    back = spark.read.parquet(f"{tmpdir_path}/out")
    want = "\n".join(f"-{r.p_type}" for r in spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").collect())
    assert len(want) > 1 << 20
    assert [tuple(r) for r in back.groupBy("disease", F.md5("gold_list").alias("h")).count().collect()] == [("Brand#11", _md5(want), 640)]
    chunks = [g.column(j) for g in _groups(f"{tmpdir_path}/out") for j in range(g.num_columns) if g.column(j).path_in_schema == "gold_list"]
    assert sum(c.total_uncompressed_size for c in chunks) < 1.1 * len(want) * len(chunks)
    assert len(chunks) < 100


def test_join_gold_is_dealt_finely_and_its_row_groups_are_bounded(spark, tmpdir_path):
    from colloquy.plans.catalog import QUERIES
    from colloquy.session import SHORT_ROWS

    d = _sf(spark, f"{tmpdir_path}/in", 300, 3000)
    got = QUERIES["join_gold"](spark, d)
    assert got.count() == 900_000 and got.select("dialogue_id", "ord").distinct().count() == 900_000
    assert got.sparkSession.conf.get("parquet.block.row.count.limit") == SHORT_ROWS["parquet.block.row.count.limit"]
    assert spark.conf.get("parquet.block.row.count.limit", None) is None
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 16 and max(sizes) < 900_000 / 6  # one disease alone is over many tasks


def _md5(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()
