from pyspark.sql import functions as F

from colloquy.operators import metrics as M

ROWS = [  # FIXTURES 3.1 d1..d7 as scored rows
    ("d1", "- a", 3, 4, 2.0, 4.0, True, True),
    ("d2", "- b", -1, -1, 1.0, 1.0, False, False),
    ("d3", "- c", -1, -1, 0.0, 0.0, False, False),
    ("d4", "- d", 0, 0, 0.0, 0.0, False, True),
    ("d5", "- e", -1, -1, 0.0, 0.0, False, False),
    ("d6", "Early Stop Error.", -1, -1, -1.0, -1.0, False, False),
    ("d7", "Error", -1, -1, -1.0, -1.0, False, False),
]
SCHEMA = ("pid string, organized_QA string, score long, weighted_score long, penalty_score double, "
          "reward_score double, top1_result boolean, topk_result boolean")


def _df(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumn("model", F.lit("m")).withColumn("turn", F.lit(2))


def test_fixture_metrics(spark):
    r = M.run_leaderboard(_df(spark)).collect()[0]
    assert (r.score_mean, r.score_median, r.score_std) == (1.5, 1.5, 2.1213203435596424)
    assert (r.clean_len, r.early_stop_len, r.format_error_len, r.matching_error_len, r.other_error_len) == (
        2, 1, 0, 3, 1)
    assert (r.top1_accuracy, r.topk_accuracy) == (0.5, 1.0)
    d = {x.metric: x for x in M.score_describe(_df(spark)).collect()}["score"]
    assert (d["count"], d["min"], d.p25, d.p50, d.p75, d["max"]) == (2, 0.0, 0.75, 1.5, 2.25, 3.0)


def test_one_clean_row_and_none(spark):
    one = M.score_stats(_df(spark, ROWS[:1] + ROWS[5:])).collect()[0]
    assert one.score_std is None and one.score_mean == 3.0
    none = M.accuracy_rates(_df(spark, ROWS[5:])).collect()[0]
    assert none.top1_accuracy is None


def test_missing_score_counts_as_clean(spark):
    rows = [("x", "- a", None, None, None, None, None, None)] + ROWS[:2]
    r = M.error_counts(_df(spark, rows)).collect()[0]
    assert r.clean_len == 2


def test_metrics_json_document(spark):
    import json
    doc = json.loads(M.metrics_json(_df(spark)).collect()[0].metrics_json)
    assert doc["score"]["describe"]["25%"] == 0.75 and doc["clean_len"] == 2
    assert set(doc) >= {"score", "weighted_score", "penalty_score", "reward_score", "top1_accuracy"}


def test_metrics_json_file(spark, tmpdir_path):
    """One document per run, with nulls, never NaN."""
    import json
    from pathlib import Path

    from colloquy.sources import sinks as SK
    SK.write_metrics_json(_df(spark, ROWS[5:]).unionByName(_df(spark).withColumn("turn", F.lit(5))), f"{tmpdir_path}/m")
    docs = {p.parent.name: json.loads(p.read_text()) for p in Path(tmpdir_path, "m").rglob("*.json")}
    assert set(docs) == {"turn=2", "turn=5"}
    assert docs["turn=5"]["score"]["std_dev"] == 2.1213203435596424
    assert docs["turn=2"]["score"]["mean"] is None and docs["turn=2"]["top1_accuracy"] is None
