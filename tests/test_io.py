import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import requests as RQ
from colloquy.plans import standins
from colloquy.sources import readers as RD
from colloquy.sources import sinks as SK
from colloquy.streaming import incremental as INC


def test_pandas_csv_round_trip(spark, tmpdir_path):
    qa = ["chief \"quoted\" complaint", "Question: a,\nnext line", "it's ok"]
    pdf = pd.DataFrame([{"pid": "00000012", "disease": "Lower Extremity Peripheral Artery Disease, PAD",
                         "QA": str(qa)}])
    path = os.path.join(tmpdir_path, "m_turn_2.csv")
    pdf.to_csv(path, index=False)
    from colloquy.functions.lists import parse_list_cell
    r = RD.scan_dialogues(spark, path).withColumn("QA", parse_list_cell("QA")).collect()[0]
    assert r.pid == "00000012" and r.disease.endswith(", PAD") and r.QA == qa


def test_gold_ord_in_file_order(spark, tmpdir_path):
    rows = [("Dz, with comma", "h", "first"), ("Dz, with comma", "m", "sec\"ond"), ("Other", "m", "third")]
    path = os.path.join(tmpdir_path, "gold.csv")
    pd.DataFrame(rows, columns=["disease", "weight", "symptom"]).to_csv(path, index=False)
    got = [tuple(r) for r in RD.scan_gold(spark, path).orderBy("ord").collect()]
    assert got == [(d, i, s, w) for i, (d, w, s) in enumerate(rows)]


def test_run_identity_anchored(spark):
    df = spark.createDataFrame([("/x/turnip_turn_models/org-turner_turn_5.csv/part-0.csv",), ("/y/m_turn_12.csv",)],
                               "p string")
    model, turn = RD.run_identity(F.col("p"))
    assert [tuple(r) for r in df.select(model, turn).collect()] == [("org-turner", 5), ("m", 12)]


def test_resume_batch_equals_one_run(spark, tmpdir_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    todo = spark.range(100).select(F.col("id").alias("k"))

    def process(df):
        return df.select("k", (F.col("k") * 2).alias("v"))

    out = os.path.join(tmpdir_path, "out")
    INC.resume_batch(spark, todo.where("k % 3 = 0"), process, out, ["k"], schema)
    full = INC.resume_batch(spark, todo, process, out, ["k"], schema)
    again = INC.resume_batch(spark, todo, process, out, ["k"], schema)
    assert sorted(tuple(r) for r in full.collect()) == [(k, 2 * k) for k in range(100)]
    assert again.count() == 100


def test_stream_second_run_sees_only_new_files(spark, tmpdir_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    src, sink, ckpt = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ckpt"))
    seen = []

    def process(df):
        seen.append(df.count())
        return df.withColumn("v", F.col("k") + 1)

    spark.range(0, 10).select(F.col("id").alias("k")).write.parquet(src)
    INC.resume_stream(spark, src, schema, process, sink, ckpt)
    spark.range(10, 15).select(F.col("id").alias("k")).write.mode("append").parquet(src)
    INC.resume_stream(spark, src, schema, process, sink, ckpt)
    assert seen == [10, 5]
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == list(range(15))


def test_apply_model_errors_do_not_fail_job(spark):
    df = spark.createDataFrame([(f"r{i}", "x" * i) for i in range(1, 30)], "request_id string, prompt string")
    out = {r.request_id: r for r in RQ.apply_model(df, standins.make_refusing_model, batch_size=4,
                                                     max_retries=2, backoff_seconds=0).collect()}
    assert len(out) == 29
    for i in range(1, 30):
        r = out[f"r{i}"]
        if i % 7 == 0:
            assert r.response is None and r.error == "ValueError: refused" and r.attempts == 2
        else:
            assert r.response == standins.digest_reply("x" * i) and r.error is None


def test_legacy_runs_layout(spark, tmpdir_path):
    df = spark.createDataFrame([("org/m1", 2, "1", 3), ("org/m1", 2, "2", -1), ("m2", 5, "3", 1)],
                               "model string, turn int, pid string, score long")
    base = os.path.join(tmpdir_path, "dialogue")
    names = sorted(os.path.basename(p) for p in SK.write_legacy_runs(df, base))
    assert names == ["m1_turn_2.csv", "m2_turn_5.csv"]
    schema = T.StructType([T.StructField("pid", T.StringType()), T.StructField("score", T.LongType())])
    back = sorted(tuple(r)[:4] for r in RD.scan_runs(spark, base + "/*.csv", schema).collect())
    assert back == [("m1", 2, "1", 3), ("m1", 2, "2", -1), ("m2", 5, "3", 1)]


def test_route_provider(spark):
    df = spark.createDataFrame([("gpt-4o-mini", 2), ("claude-3-haiku", 4), ("org/llama", 2), ("llama", 2),
                                ("claude", 3)], "m string, n int")
    p, t = RQ.route_provider(F.col("m"), F.col("n"))
    assert [tuple(r) for r in df.select(p, t).collect()] == [
        ("openai", "gpt-4o-mini"), ("anthropic", "claude-3-haiku"), ("local", "org/llama"),
        ("unsupported", "llama"), ("openai", "gpt-4o-mini")]


def test_csv_columns_by_name_and_bad_cells(spark, tmpdir_path):
    a, b = (os.path.join(tmpdir_path, f"{n}_turn_2.csv") for n in "ab")
    pd.DataFrame([["D", "1", 3.0, "- x"], ["D", "2", None, "- y"]], columns=["disease", "pid", "score", "organized_QA"]).to_csv(a, index=False)
    pd.DataFrame([["3", "much", "- z", "e"]], columns=["pid", "score", "organized_QA", "extra"]).to_csv(b, index=False)
    schema = T.StructType([T.StructField("pid", T.StringType()), T.StructField("organized_QA", T.StringType()), T.StructField("score", T.LongType())])
    got = sorted(tuple(r) for r in RD.scan_runs(spark, f"{tmpdir_path}/*.csv", schema).collect())
    assert got == [("a", 2, "1", "- x", 3, None), ("a", 2, "2", "- y", None, None), ("b", 2, "3", "- z", None, "score")]
    import pytest
    with pytest.raises(ValueError, match="no column"):
        RD.read_by_name(spark, b, T.StructType([T.StructField("disease", T.StringType())]))


def test_models_that_share_a_file_name(spark, tmpdir_path):
    import pytest
    df = spark.createDataFrame([("a/x", 2, "1"), ("b/x", 2, "2")], "model string, turn int, pid string")
    with pytest.raises(ValueError, match="share a run file name"):
        SK.write_legacy_runs(df, os.path.join(tmpdir_path, "d"))


def test_export_is_in_order(spark, tmpdir_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(6)
    path = os.path.join(tmpdir_path, "e")
    SK.export_sorted(df, path, ["k"])
    keys = []
    for name in sorted(x for x in os.listdir(path) if x.startswith("part-")):
        keys += pd.read_csv(os.path.join(path, name))["k"].tolist()
    assert keys == list(range(5000))


def test_failed_rows_are_done_again(spark, tmpdir_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("response", T.StringType())])
    todo = spark.range(10).select(F.col("id").alias("k"))
    out = os.path.join(tmpdir_path, "r")
    first = INC.resume_batch(spark, todo, lambda d: d.select("k", F.when(F.col("k") % 2 == 0, "a").alias("response")), out, ["k"], schema, failed="response IS NULL")
    assert first.count() == 10
    again = INC.resume_batch(spark, todo, lambda d: d.select("k", F.when(F.col("k") != 3, "b").alias("response")), out, ["k"], schema, failed="response IS NULL")
    assert {r.k: r.response for r in again.collect()} == {k: None if k == 3 else "ab"[k % 2] for k in range(10)}
    assert again.count() == 10


def test_invalid_replies_and_attempts(spark):
    def make():
        calls = {}

        def fn(items):
            out = []
            for m in items:
                calls[m[-1]["content"]] = n = calls.get(m[-1]["content"], 0) + 1
                out.append("good" if m[-1]["content"] != "slow" or n > 2 else "bad")
            return out
        return fn
    df = spark.createDataFrame([("1", "fast"), ("2", "slow")], "request_id string, p string").withColumn("messages", RQ.messages(F.col("p"))).coalesce(1)
    got = {r.request_id: r for r in RQ.apply_model(df, make, "messages", valid=lambda r: r == "good", backoff_seconds=0).collect()}
    assert (got["1"].response, got["1"].attempts) == ("good", 1) and (got["2"].response, got["2"].attempts) == ("good", 3)
    none = RQ.apply_model(df, make, "messages", valid=lambda r: False, max_retries=2, backoff_seconds=0).collect()
    assert all(r.response is None and r.error == "invalid reply" and r.attempts == 2 for r in none)

    def refuse():
        def fn(items):
            raise KeyError("no")
        return fn
    once = RQ.apply_model(df.limit(1), refuse, "messages", retryable=lambda e: False, backoff_seconds=0).collect()[0]
    assert (once.attempts, once.response) == (1, None) and once.error.startswith("KeyError")


def test_prompts_and_languages(spark, tmpdir_path):
    assert RD.language_paths("/x/", "english")["gold"] == "/x/data/gold_label_en.csv"
    assert RD.language_paths("/x", "korean")["patient_prompt"] == "/x/prompt/patient_prompt.txt"
    path = os.path.join(tmpdir_path, "p.txt")
    with open(path, "w") as f:
        f.write(" line\n\nlast\n")
    assert RD.load_prompt(spark, path) == " line\n\nlast\n"


def test_staged_tables_go(spark):
    from colloquy.session import drop_staged, staging_path
    drop_staged(spark)
    path = staging_path(spark, "x")
    spark.range(3).write.parquet(path)
    other = staging_path(spark, "y")
    spark.range(3).write.parquet(other)
    assert drop_staged(spark, path, "elsewhere") == 1 and not os.path.exists(path.removeprefix("file:"))
    assert drop_staged(spark) == 1 and not os.path.exists(other.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from colloquy.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
