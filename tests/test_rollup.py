import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import metrics as M
from colloquy.operators import rollup as R

SCHEMA = "model string, turn int, organized_QA string, score long, weighted_score long, penalty_score double, reward_score double, top1_result boolean, topk_result boolean, part int"


def rows(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        org = draw.choice(["- ok", "- ok", "Early Stop Error.", "QA format Error.", None, "Error"])
        score = draw.choice([-1, None, 0, 3, 5, 9]) if org == "- ok" else -1
        out.append((draw.choice(["a", "b", None]), draw.choice([2, 5]), org, score, draw.randint(0, 9), draw.choice([0.5, 1.0, None, 2.5]), draw.random(), draw.choice([True, False, None]), draw.choice([True, None]), draw.randint(0, 4)))
    return out + [("only bad", 1, "Error", -1, -1, -1.0, -1.0, None, None, 0), ("one", 1, "- x", 4, 4, 2.0, 2.0, True, True, 3)]


def plain(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in (r[c] for c in cols)) for r in df.collect()), key=repr)


def test_any_split_into_batches_gives_the_full_roll_up(spark, tmpdir_path):
    df = spark.createDataFrame(rows(1, 400), SCHEMA)
    want = plain(M.run_leaderboard(df))
    for name, batches in (("one", [df]), ("five", [df.where(f"part = {i}") for i in range(5)])):
        path = f"{tmpdir_path}/{name}"
        for i, b in enumerate(batches):
            R.add_batch(b, path, i)
        R.add_batch(batches[0], path, 0)  # done again
        assert plain(R.roll_up(spark, path)) == want


def test_a_roll_up_reads_no_rows(spark, tmpdir_path):
    R.add_batch(spark.createDataFrame(rows(2, 50), SCHEMA), f"{tmpdir_path}/s", 0)
    assert set(spark.read.parquet(f"{tmpdir_path}/s").columns) == {"model", "turn", "name", "value", "n", "batch"}


@pytest.mark.parametrize("parts", ["1", "16"])
def test_quantiles_equal_percentile(spark, parts):
    q = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        draw = random.Random(7)
        data = [(draw.choice(["x", "x", "x", None, "y"]), draw.choice([None, float(draw.randint(-5, 5)), draw.gauss(0, 1)])) for _ in range(3000)] + [("lone", 2.5), ("empty", None)]
        df = spark.createDataFrame(data, "g string, v double")
        got = {r.g: list(r.quantiles) for r in R.exact_quantiles(df, ["g"], "v", q).collect()}
        want = {r.g: list(r.p) for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, q))).alias("p")).collect() if r.p}
        assert got.keys() == want.keys()
        assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_many_different_values_in_one_group(spark):
    n = 3_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    r = R.exact_quantiles(df, ["g"], "v", [0.25, 0.5]).collect()
    assert [list(x.quantiles) for x in r] == [[0.25 * (n - 1), 0.5 * (n - 1)]]
