"""End-to-end run of the stages with deterministic stand-in replies."""

from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.operators import metrics as M
from colloquy.operators import requests as RQ
from colloquy.operators import stages as ST
from colloquy.plans.bindings import inline_table
from colloquy.plans.standins import (make_comparer_model, make_judge_model, make_organizer_model,
                                     make_predictor_model)

ORGANIZER = "Summarise for {disease}:\n{input}"
COMPARER = "Disease: {disease}\nLabels:\n{a}\nStatement: {b}"
KEYS = ["model", "turn", "pid"]


def _call(df, make):
    """Replies are written once and read back: later stages never call the
    model again through lineage."""
    from colloquy.session import staging_path
    path = staging_path(df.sparkSession, "replies")
    RQ.apply_model(df.where(F.col("prompt").isNotNull()), make, backoff_seconds=0).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages_end_to_end(spark):
    dialogues = spark.createDataFrame([
        ("m", 1, "1", "D", ["cough", "Question: how long?", "two days", "Question: extra", "x"]),
        ("m", 1, "2", "D", ["fever", "Question: pain? Question: where?", "chest"]),
        ("m", 1, "3", "D", ["tired", "Question: sleep?", "badly"]),
    ], "model string, turn int, pid string, disease string, QA array<string>")
    gold = inline_table(spark, [("D", 1, "Fatigue", "m"), ("D", 2, "Hypertension", "h")], schemas.GOLD)
    profiles = spark.createDataFrame(
        [("00000001", "D", {"Chief Complaint": "cough"}), ("00000003", "D", {"Chief Complaint": "tired"})],
        schemas.PROFILE)

    org = ST.organize_requests(dialogues, KEYS, 1, ORGANIZER)
    organized = ST.organize_results(org, _call(org, make_organizer_model))
    by_pid = {r.pid: r for r in organized.collect()}
    assert by_pid["1"].organized_QA == "- Fatigue\n- Hypertension\n"
    assert by_pid["2"].organized_QA == "QA format Error."
    assert len(by_pid["1"].QA) == 3

    creq = ST.compare_requests(organized, gold, KEYS, COMPARER)
    assert creq.count() == 6
    scored = ST.compare_results(organized, creq, _call(creq, make_comparer_model), gold, KEYS)
    s = {r.pid: r for r in scored.collect()}
    assert (s["1"].score, s["1"].weighted_score, s["1"].penalty_score, s["1"].reward_score) == (2, 3, 2.0, 2.0)
    assert s["1"].referred_gold_label == "- Fatigue\n- Hypertension\n- Not in Gold Label\n"
    assert (s["2"].score, s["2"].referred_gold_label) == (-1, "Error.")

    preq = ST.predict_requests(scored, profiles, KEYS, 1)
    assert "patient_info: \nChief Complaint: cough\n\nmedical_history: \ncough" in \
        {r.pid: r for r in preq.collect()}["1"].prompt
    preds, jreq = ST.judge_requests(scored, preq, _call(preq, make_predictor_model), KEYS)
    diagnosed = ST.diagnose_results(scored, preds, jreq, _call(jreq, make_judge_model), KEYS)
    d = {r.pid: r for r in diagnosed.collect()}
    assert d["1"].model_predictions == ["D", "Other"] and d["1"].topk_result and d["1"].top1_result
    assert d["2"].model_predictions is None and d["2"].top1_result is False

    board = M.run_leaderboard(diagnosed).collect()[0]
    assert (board.clean_len, board.format_error_len, board.score_mean, board.top1_accuracy) == (2, 1, 2.0, 1.0)


def _tables(spark):
    organized = spark.createDataFrame([(p, p, "D", ["head", "Question: q", "a"], "- one\n- two") for p in ("1", "2", "3", "4")],
                                      "key string, pid string, disease string, QA array<string>, organized_QA string")
    gold = inline_table(spark, [("D", 1, "Fatigue", "m"), ("D", 2, "Cough", "h")], schemas.GOLD)
    return organized, gold


def test_missing_and_doubled_replies(spark):
    organized, gold = _tables(spark)
    reqs = ST.compare_requests(organized, gold, ["key"], COMPARER)
    ids = {(r.key, r.pos): r.request_id for r in reqs.collect()}
    replies = [(i, 2, "Reason: r\nFinal Response: Fatigue") for k, i in ids.items() if k != ("2", 1)]
    replies += [(ids["1", 0], 1, "Reason: r\nFinal Response: Cough"), (ids["3", 1], 3, "Reason: r\nFinal Response: Cough"), (ids["4", 0], 3, None)]
    r = spark.createDataFrame(replies, "request_id string, ord int, response string")
    got = {x.key: x for x in ST.compare_results(organized, reqs, r, gold, ["key"], order_col="ord").collect()}
    assert len(got) == 4
    assert (got["1"].status, got["1"].score, got["1"].penalty_score, got["1"].referred_gold_label) == ("ok", 2, 1.5, "- Fatigue\n- Fatigue\n")
    assert (got["2"].status, got["2"].score, got["2"].referred_gold_label) == ("missing_reply", None, None)
    assert got["3"].referred_gold_label == "- Fatigue\n- Cough\n" and got["4"].score == 2


def test_doubled_absent_and_odd_profiles(spark):
    organized, _ = _tables(spark)
    scored = organized.withColumn("score", F.lit(1)).withColumn("status", F.when(F.col("key") == "4", "match_error").otherwise("ok"))
    scored = scored.withColumn("pid", F.when(F.col("key") == "3", "P-12").otherwise(F.col("pid")))
    prof = spark.createDataFrame([("00000001", {"a": "new", "b": None}, 2), ("00000001", {"a": "old"}, 1), ("00000009", {"a": "x"}, 1)],
                                 "pid string, simple_info map<string,string>, ord int")
    got = {r.key: r for r in ST.predict_requests(scored, prof, ["key"], 1, system="S", order_col="ord").collect()}
    assert set(got) == {"1", "2", "3"} and got["2"].status == got["3"].status == "no_profile" and got["2"].messages is None
    assert "a: new\nb: None\n" in got["1"].prompt
    assert [m.role for m in got["1"].messages] == ["system", "user"] and got["1"].messages[0].content == "S"


def test_request_ids_differ_for_different_keys(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("", "x")], "p string, q string")
    assert df.select(RQ.request_id("s", "p", "q").alias("i")).distinct().count() == 5


def test_replies_are_attached_by_packed_ids(spark):
    """Half the bytes of an id, and the same result as by its text."""
    from pyspark.sql import functions as F

    from colloquy.operators import requests as RQ
    h = "ab" * 32
    ids = [h, h.upper(), h + "\n", "ab" * 16, "«" * 16, "x", "", None]
    reqs = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "request_id string, k int")
    replies = spark.createDataFrame([(x, o, f"{i}-{o}" if o < 3 else None) for i, x in enumerate([*ids, "y"]) for o in (2, 1, 3)], "request_id string, ord int, response string")
    got = RQ.attach_replies(reqs, replies, "ord")
    want = reqs.join(RQ.last_replies(replies, "ord"), "request_id", "left")
    assert {r.k: (r.request_id, r.response) for r in got.collect()} == {r.k: (r.request_id, r.response) for r in want.collect()}
    sizes = {r[0]: r[1] for r in reqs.select("k", F.octet_length(RQ.packed_id())).collect()}
    assert sizes[0] == 32 and sizes[3] == 33 and reqs.select(RQ.packed_id().alias("i")).where("i IS NOT NULL").distinct().count() == len(ids) - 1


def test_predictions_are_parsed_once(spark):
    """The parsed predictions are read from their table, not joined again for each use."""
    from colloquy.operators import stages as ST
    scored = spark.createDataFrame([(1, "D"), (2, "D")], "k int, disease string")
    reqs = spark.createDataFrame([(1, "r1", "ok"), (2, "r2", "no_profile")], "k int, request_id string, status string")
    replies = spark.createDataFrame([("r1", "Diseases:\n- D")], "request_id string, response string")
    preds, judge = ST.judge_requests(scored, reqs, replies, ["k"])
    assert "Join" not in preds._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.predict_status for r in preds.collect()} == {1: "ok", 2: "no_profile"} and judge.count() == 2


def test_judge_messages_stay_out_of_the_reply_join(spark):
    from colloquy.plans.catalog import QUERIES
    q = QUERIES["stage_judge"](spark, "/root/testdata/sf0.001")
    assert "AS messages" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_parsed_once_each(spark):
    """The parsers stand once in the plan of the predictions, which uses them for value and status."""
    import re

    from pyspark.sql import functions as F

    from colloquy.functions import text as X
    df = spark.createDataFrame([("Diseases: [a, b]\nx",), ("Reasoning: r\n  s\nResult: True",)], "response string")
    for parse, marker in ((X.parse_predictions, "Diseases:"), (X.parse_judgement, "Result:")):
        plan = df.select(parse(F.col("response")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(rf"StartsWith\([^()]*, {marker}\)", plan, re.I)) == 1, plan
