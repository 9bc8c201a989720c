"""Query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per
operator.  Every result is flat (no maps / arrays), every computed column
is aliased, counts are BIGINT and doubles are rounded to 6 places, so the
DuckDB oracle in ``plans.oracle`` can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import labels as L
from colloquy.operators import scoring as S
from colloquy.plans import bindings as B
from colloquy.session import LONG_TEXTS, SHORT_ROWS, stored, writing_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------- B1 scoring

def _b1_scores(spark, sf_dir, mode=S.SUBSTRING):
    s = S.score_bullets(B.b1_bullets(spark, sf_dir), B.b1_gold(spark), B.B1_KEYS, mode=mode,
                        carry=["event_id"])
    return s.withColumn("break_event_id", F.col("break_row.event_id"))


@query("bullet_scoring")
def bullet_scoring(spark, sf_dir):
    s = _b1_scores(spark, sf_dir)
    return s.select("dialogue_id", "disease", "n_bullets", "n_live", "break_event_id",
                    "score", "weighted_score", "penalty_score", "reward_score",
                    "status", "label_trace", "reason_trace")


@query("score_plain")
def score_plain(spark, sf_dir):
    return _b1_scores(spark, sf_dir).select("dialogue_id", "score")


@query("score_weighted")
def score_weighted(spark, sf_dir):
    return _b1_scores(spark, sf_dir).select("dialogue_id", "weighted_score")


@query("score_penalty")
def score_penalty(spark, sf_dir):
    return _b1_scores(spark, sf_dir).select("dialogue_id", "penalty_score")


@query("score_reward")
def score_reward(spark, sf_dir):
    return _b1_scores(spark, sf_dir).select("dialogue_id", "reward_score")


@query("poison_break")
def poison_break(spark, sf_dir):
    s = _b1_scores(spark, sf_dir)
    return s.select("dialogue_id", "break_event_id", "n_live")


@query("label_trace")
def label_trace(spark, sf_dir):
    return _b1_scores(spark, sf_dir).select("dialogue_id", "label_trace")


@query("reason_trace")
def reason_trace(spark, sf_dir):
    return _b1_scores(spark, sf_dir).select("dialogue_id", "reason_trace")


@query("trace_rows")
def trace_rows(spark, sf_dir):
    f = S.bullet_flags(B.b1_bullets(spark, sf_dir), B.b1_gold(spark), B.B1_KEYS)
    return S.trace_rows(f, ["dialogue_id", "event_id"]).drop("pos")


def _d_bullets(spark, sf_dir):
    return stored(B.d_bullets(spark, sf_dir), "bullets")  # they are read several times


@query("gold_contains")
def gold_contains(spark, sf_dir):
    a = S.annotate_bullets(_d_bullets(spark, sf_dir), B.d_gold(spark, sf_dir))
    return a.select("event_id", "dialogue_id", "resp", "hit")


@query("label_weight")
def label_weight(spark, sf_dir):
    a = S.annotate_bullets(_d_bullets(spark, sf_dir), B.d_gold(spark, sf_dir))
    return a.select("event_id", "resp", "weight")


@query("join_gold")
def join_gold(spark, sf_dir):
    spark = writing_session(spark, SHORT_ROWS)
    j = L.join_gold(B.d_dialogues(spark, sf_dir), B.d_gold(spark, sf_dir))
    return j.select("dialogue_id", "disease", "ord", "symptom", "weight")


@query("score_lines")
def score_lines(spark, sf_dir):
    """All scores and the label trace with labels that span lines and lie across one another."""
    s = S.score_bullets(_d_bullets(spark, sf_dir), B.d_gold(spark, sf_dir), ["dialogue_id"])
    return s.select("dialogue_id", "n_bullets", "n_live", "score", "weighted_score", "penalty_score", "reward_score", "label_trace", "status")


def _seen(spark, sf_dir, mode):
    f = S.bullet_flags(B.b1_bullets(spark, sf_dir), B.b1_gold(spark), B.B1_KEYS, mode=mode)
    return f.select("event_id", "dialogue_id", "label", "live",
                    (F.col("live") & F.col("hit") & F.col("seen")).alias("seen"))


@query("seen_before")
def seen_before(spark, sf_dir):
    return _seen(spark, sf_dir, S.SUBSTRING)


@query("seen_before_exact")
def seen_before_exact(spark, sf_dir):
    return _seen(spark, sf_dir, S.EXACT)


@query("gold_list_text")
def gold_list_text(spark, sf_dir):
    # a list grows with the label file, to MBs; Parquet keeps no least or greatest value of that length
    spark = writing_session(spark, {**LONG_TEXTS, "parquet.column.statistics.enabled#gold_list": "false"})
    d = L.dialogue_lists(B.d_dialogues(spark, sf_dir), B.d_gold(spark, sf_dir))
    return d.select("dialogue_id", "disease", "gold_list")


@query("first_label")
def first_label(spark, sf_dir):
    a = S.annotate_bullets(B.b1_bullets(spark, sf_dir), B.b1_gold(spark))
    f = L.first_rows(a, ["dialogue_id", "label"], "pos", ["event_id"])
    return f.select("dialogue_id", "label", F.col("event_id").alias("first_event_id"), "n_rows")


# ------------------------------------------------------------- B3 metrics

from colloquy.operators import metrics as M  # noqa: E402


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles at 6 places, for the compare (the operators don't round)."""
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


@query("score_stats")
def score_stats(spark, sf_dir):
    return _rounded(M.score_stats(B.b3_results(spark, sf_dir)))


@query("score_describe")
def score_describe(spark, sf_dir):
    return _rounded(M.score_describe(B.b3_results(spark, sf_dir)))


@query("accuracy_rates")
def accuracy_rates(spark, sf_dir):
    return _rounded(M.accuracy_rates(B.b3_results(spark, sf_dir)))


@query("error_counts")
def error_counts(spark, sf_dir):
    return M.error_counts(B.b3_results(spark, sf_dir))


@query("run_leaderboard")
def run_leaderboard(spark, sf_dir):
    return _rounded(M.run_leaderboard(B.b3_results(spark, sf_dir)))


@query("metrics_json")
def metrics_json(spark, sf_dir):
    """The document's numbers as one row per metric and statistic."""
    doc = M.metrics_struct(B.b3_results(spark, sf_dir))
    parts = [F.struct(F.lit(f"{c}.{n}").alias("name"), F.col(f"metrics.{c}.{n}").cast("double").alias("value"))
             for c in M.SCORE_COLS for n in ("mean", "median", "std_dev", "describe.count", "describe.min", "describe.`25%`", "describe.`75%`", "describe.max")]
    parts += [F.struct(F.lit(n).alias("name"), F.col(f"metrics.{n}").cast("double").alias("value"))
              for n in ("top1_accuracy", "topk_accuracy", "clean_len", "early_stop_len", "format_error_len", "matching_error_len", "other_error_len")]
    out = doc.select("model", "turn", F.explode(F.array(*parts)).alias("p")).select("model", "turn", "p.*")
    return _rounded(out.withColumn("name", F.replace("name", F.lit("`"), F.lit(""))))


@query("status_taxonomy")
def status_taxonomy(spark, sf_dir):
    r = B.b3_results(spark, sf_dir)
    return r.select("pid", "model", "turn", M.status_column().alias("status"))


@query("clean_rows")
def clean_rows(spark, sf_dir):
    return M.clean_rows(B.b3_results(spark, sf_dir)).select("pid", "model", "turn", "score", "weighted_score")


@query("error_guard")
def error_guard(spark, sf_dir):
    r = B.b3_results(spark, sf_dir)
    g = M.error_guard()
    return r.select("pid", g.alias("guarded"),
                    F.when(g, F.lit(-1).cast("bigint")).otherwise(F.col("score")).alias("score"),
                    F.when(g, F.lit("Error.")).alias("referred_gold_label"))


@query("sentinel_default")
def sentinel_default(spark, sf_dir):
    """Diagnosis defaults for failed dialogues (no model call is made)."""
    from colloquy.operators import diagnosis as D
    r = B.b3_results(spark, sf_dir).withColumn(
        "model_predictions", F.concat(F.col("lang"), F.lit("-disease")))
    out = D.sentinel_default(r)
    return out.select("pid", "model_predictions", "topk_result", "top1_result", "n_calls")


# ------------------------------------------------------------ B2 dialogues

from colloquy.functions import text as X  # noqa: E402
from colloquy.operators import dialogue as DG  # noqa: E402
from colloquy.operators import requests as RQ  # noqa: E402

ORGANIZER_TEMPLATE = B.ORGANIZER_TEMPLATE
DOCTOR_SYSTEM = B.DOCTOR_SYSTEM
PATIENT_SYSTEM = B.PATIENT_SYSTEM


def _b2_cut(spark, sf_dir):
    return B.b2_dialogues(spark, sf_dir, max_items=2 * B.B2_TURNS + 1)


@query("assemble_dialogue")
def assemble_dialogue(spark, sf_dir):
    d = B.b2_dialogues(spark, sf_dir)
    return d.select("conv_id", F.size("QA").cast("bigint").alias("n_items"),
                    F.array_join("QA", B.B2_SEP).alias("qa_text"))


@query("cut_turns")
def cut_turns(spark, sf_dir):
    d = B.b2_dialogues(spark, sf_dir).withColumn("QA", DG.cut_turns("QA", B.B2_TURNS))
    return d.select("conv_id", F.size("QA").cast("bigint").alias("n_items"),
                    F.array_join("QA", B.B2_SEP).alias("qa_text"))


@query("cut_run")
def cut_run(spark, sf_dir):
    """A run cut to fewer turns and written to the long run's table: both
    runs are there afterwards, each under its own turn."""
    long = B.c_dialogues(spark, sf_dir).select("o_orderkey", F.lit("m").alias("model"), F.lit(9).alias("turn"), "QA")
    path = staging_path(spark, "cut")
    SK.stage_write(long, path)
    SK.stage_write(DG.cut_run(long, B.C_TURNS), path)
    back = spark.read.parquet(path)
    return back.select("o_orderkey", F.col("turn").cast("bigint").alias("turn"), F.size("QA").cast("bigint").alias("n_items"))


@query("split_head_body")
def split_head_body(spark, sf_dir):
    d = _b2_cut(spark, sf_dir)
    body = DG.body("QA", B.B2_TURNS)
    return d.select("conv_id", DG.head("QA").alias("head"), F.array_join(body, B.B2_SEP).alias("body_text"),
                    F.size(body).cast("bigint").alias("n_body"))


@query("render_dialogue")
def render_dialogue(spark, sf_dir):
    d = _b2_cut(spark, sf_dir)
    return d.select("conv_id", X.render_dialogue(DG.head("QA"), DG.body("QA", B.B2_TURNS), B.B2_TURNS)
                    .alias("dialogue_text"))


@query("render_history")
def render_history(spark, sf_dir):
    d = _b2_cut(spark, sf_dir)
    return d.select("conv_id", X.render_history("QA", B.B2_TURNS).alias("history"))


@query("chat_messages")
def chat_messages(spark, sf_dir):
    rows = B.b2_turn_rows(spark, sf_dir)
    info = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    out = None
    for mode, template in [("doctor", DOCTOR_SYSTEM), ("patient", PATIENT_SYSTEM)]:
        m = DG.chat_message_rows(rows, ["conv_id"], X.fill_template(template, [("patient_information", info)]),
                                 mode).withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    return out.select("conv_id", "mode", "msg_idx", "role", "content")


@query("validate_turns")
def validate_turns(spark, sf_dir):
    d = _b2_cut(spark, sf_dir)
    return d.select("conv_id", DG.marker_count("QA", B.B2_TURNS, B.B2_MARKER).alias("n_marker"),
                    DG.validate_turns("QA", B.B2_TURNS, B.B2_MARKER).alias("status"))


@query("count_marker")
def count_marker(spark, sf_dir):
    rows = B.b2_turn_rows(spark, sf_dir)
    return rows.select("conv_id", F.col("pos").alias("turn"), X.count_marker("text", B.B2_MARKER).alias("n_marker"))


@query("emit_requests")
def emit_requests(spark, sf_dir):
    """Organizer and predictor requests for dialogues that pass validation;
    the others cost no call."""
    T = B.B2_TURNS
    d = _b2_cut(spark, sf_dir).withColumn("status", DG.validate_turns("QA", T, B.B2_MARKER)) \
        .withColumn("model", F.lit("conversations")).withColumn("turn", F.lit(T)).withColumn("pos", F.lit(0))
    org = d.where(F.col("status") == DG.VALID)
    prompt = X.fill_template(ORGANIZER_TEMPLATE, [
        ("input", X.render_dialogue(DG.head("QA"), DG.body("QA", T), T)), ("disease", F.col("disease"))])
    r1 = RQ.emit_requests(org, "organize", ["model", "turn", "conv_id", "pos"], prompt)
    from colloquy.operators.diagnosis import predictor_input
    info = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"), F.lit("\n"))
    r2 = RQ.emit_requests(org, "predict", ["model", "turn", "conv_id", "pos"],
                          predictor_input(info, X.render_history("QA", T)))
    return r1.unionByName(r2).select("request_id", "stage", "conv_id",
                                     F.col("messages")[0]["content"].alias("system"),
                                     F.col("messages")[1]["content"].alias("prompt"))


# -------------------------------------------------------------- B5 replies

from colloquy.functions.scrub import scrub_negations as _scrub  # noqa: E402


@query("parse_verdict")
def parse_verdict(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir).select("doc_id", X.parse_verdict(B.b5_verdict_reply()).alias("v"))
    return d.select("doc_id", "v.reason", "v.answer", "v.marker_found")


@query("clean_verdict")
def clean_verdict(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    return d.select("doc_id", X.clean_reason("text").alias("no_breaks"), X.clean_answer("text").alias("no_stars"))


@query("fenced_block")
def fenced_block(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    return d.select("doc_id", X.fenced_block(B.b5_predictor_reply()).alias("block"))


def _predictions(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    return d.select("doc_id", X.parse_predictions(X.fenced_block(B.b5_predictor_reply())).alias("p"))


@query("parse_predictions")
def parse_predictions(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.select("doc_id", F.size("p").cast("bigint").alias("n_predictions"),
                    F.array_join("p", "|").alias("predictions"))


@query("top1_slice")
def top1_slice(spark, sf_dir):
    from colloquy.operators.diagnosis import python_list_text, top_k
    p = _predictions(spark, sf_dir)
    top = top_k(F.col("p"), 1)
    return p.select("doc_id", F.try_element_at(top, F.lit(1)).alias("top1"),
                    python_list_text(top).alias("top1_text"),
                    F.when(F.col("p").isNull(), F.lit("prediction_parse_error")).otherwise(F.lit("ok"))
                    .alias("status"))


@query("parse_judgement")
def parse_judgement(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir).select("doc_id", X.parse_judgement(X.fenced_block(B.b5_judge_reply())).alias("j"))
    return d.select("doc_id", "j.reasoning", "j.result_text", "j.result",
                    F.when(F.col("j.ok"), F.lit("ok")).otherwise(F.lit("judge_parse_error")).alias("status"))


@query("strip_unicode")
def strip_unicode(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    padded = F.concat(F.lit(B.B5_STRIP_PAD_LEFT), F.col("text"), F.lit(B.B5_STRIP_PAD_RIGHT))
    s = X.strip(padded)
    return d.select("doc_id", s.alias("stripped"), F.length(s).cast("bigint").alias("n_stripped"))


@query("fill_template")
def fill_template(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    return d.select("doc_id", X.fill_template(B.B5_TEMPLATE, [("input", F.col("text")), ("disease", F.col("lang"))])
                    .alias("prompt"))


@query("scrub_negations")
def scrub_negations(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    return d.select("doc_id", _scrub(B.b5_scrub_response(), B.b5_scrub_context()).alias("scrubbed"))


@query("explode_bullets")
def explode_bullets(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir)
    e = d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"), X.strip("line").alias("bullet"))


@query("route_requests")
def route_requests(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir).select("doc_id", B.b5_model_name().alias("model"),
                                        (F.size(F.split(F.col("text"), "\n", -1)) + 1).cast("bigint")
                                        .alias("n_messages"))
    provider, target = RQ.route_provider(F.col("model"), F.col("n_messages"))
    return d.select("doc_id", "model", "n_messages", provider.alias("provider"), target.alias("target_model"))


@query("batch_ids")
def batch_ids(spark, sf_dir):
    d = B.b5_docs(spark, sf_dir).select("doc_id", "lang")
    return RQ.batch_ids(d, ["lang"], ["doc_id"], B.B5_BATCH).select("doc_id", "lang", "batch_id")


# --------------------------------------------------------------- B4 lookups

from colloquy.operators import diagnosis as D  # noqa: E402
from colloquy.session import staging_path  # noqa: E402
from colloquy.sources import readers as RD  # noqa: E402
from colloquy.sources import sinks as SK  # noqa: E402
from colloquy.streaming import incremental as INC  # noqa: E402


@query("join_profile")
def join_profile(spark, sf_dir):
    j = D.join_profile(B.b4_dialogues(spark, sf_dir), B.b4_profiles(spark, sf_dir).where(F.col("c_acctbal") >= 0))
    return j.select("o_orderkey", F.col("profile_key").alias("pid"), "c_name", "n_name", "r_name")


@query("unmatched_profiles")
def unmatched_profiles(spark, sf_dir):
    """Orders whose customer has no profile (profiles exist for accounts
    with a non-negative balance)."""
    prof = B.b4_profiles(spark, sf_dir).where(F.col("c_acctbal") >= 0)
    return D.unmatched_profiles(B.b4_dialogues(spark, sf_dir), prof).select(
        "o_orderkey", F.col("pid").alias("o_custkey"))


@query("pad_key")
def pad_key(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.pad_key("c_custkey").alias("pid"))


@query("dedup_last")
def dedup_last(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("ord"))
    return D.dedup_last(o, "o_custkey", "ord").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("attach_results")
def attach_results(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    res = B.b4_order_results(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return D.attach_results(o, res, ["o_orderkey"]).select("o_orderkey", "o_custkey", "n_lines", "total_qty")


def _b4_requests(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey")


def _b4_responses(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return li.select("o_orderkey", F.concat(F.lit("lines="), F.col("n").cast("string")).alias("response"))


@query("join_responses")
def join_responses(spark, sf_dir):
    j = RQ.join_responses(_b4_requests(spark, sf_dir), _b4_responses(spark, sf_dir), "inner", on="o_orderkey")
    # the id is for outside services; inside, the natural key joins
    return j.select(RQ.request_id("diagnose", "o_orderkey").alias("request_id"), "o_orderkey", "response")


@query("missing_results")
def missing_results(spark, sf_dir):
    j = RQ.join_responses(_b4_requests(spark, sf_dir), _b4_responses(spark, sf_dir), on="o_orderkey")
    return RQ.with_missing_default(j).select("o_orderkey", "response", "missing")


@query("pending_rows")
def pending_rows(spark, sf_dir):
    """Orders with no finished line item yet."""
    li = B.table(spark, sf_dir, "lineitem")
    done = li.where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("o_orderkey"))
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return INC.pending_rows(o, done, ["o_orderkey"])



@query("resume_batch")
def resume_batch(spark, sf_dir):
    """First run covers finished orders, the resumed run the rest; the
    result equals one run over all orders."""
    from pyspark.sql import types as T
    out_schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
                               T.StructField("n_lines", T.LongType())])
    res = B.b4_order_results(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").select(
        "o_orderkey", "n_lines")

    def process(todo):
        return todo.join(res, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "n_lines")

    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = staging_path(spark, "resume")
    INC.resume_batch(spark, orders.where(F.col("o_orderstatus") == "F"), process, path, ["o_orderkey"], out_schema)
    return INC.resume_batch(spark, orders, process, path, ["o_orderkey"], out_schema)


@query("union_runs")
def union_runs(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    finished = o.where(F.col("o_orderstatus") == "F").select(F.lit("finished").alias("run"), "o_orderkey", "o_custkey")
    rest = o.where(~F.col("o_orderstatus").eqNullSafe("F")).select(F.lit("open").alias("run"), "o_orderkey",
                                                                    "o_custkey")
    return finished.unionByName(rest)


@query("ordered_export")
def ordered_export(spark, sf_dir):
    from pyspark.sql import types as T
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    path = staging_path(spark, "export")
    SK.export_sorted(o, path, ["o_custkey", "o_orderkey"])
    schema = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderkey", T.LongType()),
                           T.StructField("o_orderstatus", T.StringType())])
    return RD.read_by_name(spark, path, schema).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("project_core")
def project_core(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("append_rows")
def append_rows(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    path = staging_path(spark, "append")
    SK.append_rows(o.where(F.col("o_orderstatus") == "F"), path, ["o_orderpriority"])
    SK.append_rows(o.where(~F.col("o_orderstatus").eqNullSafe("F")), path, ["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("stage_write")
def stage_write(spark, sf_dir):
    """Stage written twice (the second time only the urgent partition):
    dynamic partition overwrite keeps it idempotent."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    path = staging_path(spark, "stage")
    SK.stage_write(o, path, ["o_orderpriority"])
    SK.stage_write(o.where(F.col("o_orderpriority") == "1-URGENT"), path, ["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority")


# -------------------------------------------------------------- profile maps

@query("render_profile")
def render_profile(spark, sf_dir):
    p = B.b_profiles(spark, sf_dir)
    return p.select("event_id", X.render_profile("info").alias("profile_text"),
                    X.render_profile("info", trailing_newline=True).alias("profile_text_nl"))


@query("profile_text")
def profile_text(spark, sf_dir):
    return B.b_profiles(spark, sf_dir).select("event_id", X.profile_text("info").alias("profile_text"))


@query("chief_complaint")
def chief_complaint(spark, sf_dir):
    return B.b_profiles(spark, sf_dir).select("event_id", X.chief_complaint("info").alias("chief_complaint"))


@query("profile_drop_keys")
def profile_drop_keys(spark, sf_dir):
    m = X.drop_keys("info")
    return B.b_profiles(spark, sf_dir).select("event_id", F.array_join(F.map_keys(m), ",").alias("keys_csv"),
                                              F.size(m).cast("bigint").alias("n_keys"))


@query("parse_list_cell")
def parse_list_cell(spark, sf_dir):
    from colloquy.functions.lists import parse_list_cell as plc
    ev = B.table(spark, sf_dir, "events").select("event_id", plc(B.list_cell()).alias("items"))
    return ev.select("event_id", F.size("items").cast("bigint").alias("n_items"),
                     F.array_join("items", "|").alias("items"))


# ------------------------------------------------- staged files and streams

@query("scan_dialogues")
def scan_dialogues(spark, sf_dir):
    """Dialogues written as pandas-style CSV (QA as list text), read back."""
    from colloquy.functions.lists import parse_list_cell as plc
    d = B.b2_dialogues(spark, sf_dir).select(F.col("conv_id").cast("string").alias("pid"), "disease", "QA")
    path = staging_path(spark, "dialogues")
    SK.write_csv(d, path)
    back = RD.scan_dialogues(spark, path).withColumn("QA", plc("QA"))
    return back.select(F.col("pid").cast("bigint").alias("conv_id"), "disease",
                       F.size("QA").cast("bigint").alias("n_items"), F.array_join("QA", B.B2_SEP).alias("qa_text"))


@query("scan_gold")
def scan_gold(spark, sf_dir):
    """A label file derived from ``part`` (brand = disease), written in key
    order, read back and numbered in file order."""
    p = B.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("disease"), F.when(F.col("p_size") > 25, "h").otherwise("m").alias("weight"),
        F.col("p_name").alias("symptom"), "p_partkey")
    path = staging_path(spark, "gold")
    SK.write_csv(p.orderBy("p_partkey").drop("p_partkey"), path)
    return RD.scan_gold(spark, path).select("ord", "disease", "symptom", "weight")


@query("scan_profiles")
def scan_profiles(spark, sf_dir):
    prof = B.b4_profiles(spark, sf_dir).select("pid", "disease_name", "simple_info")
    path = staging_path(spark, "profiles")
    SK.write_json_arrays(prof, path)
    back = RD.scan_profiles(spark, path)
    return back.select("pid", "disease_name", F.size("simple_info").cast("bigint").alias("n_info"),
                       X.chief_complaint("simple_info").alias("chief_complaint"),
                       F.array_join(F.map_keys("simple_info"), ",").alias("keys_csv"))



def _written_runs(spark, sf_dir):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("pid", T.StringType()), T.StructField("organized_QA", T.StringType()),
                           T.StructField("score", T.LongType()), T.StructField("top1_result", T.StringType())])
    r = B.b3_results(spark, sf_dir).select("model", "turn", F.col("pid").cast("string").alias("pid"),
                                           "organized_QA", "score", F.col("top1_result").cast("string"))
    base = staging_path(spark, "runs")
    SK.write_legacy_runs(r, base)
    return RD.scan_runs(spark, base + "/*.csv", schema)


@query("scan_runs")
def scan_runs(spark, sf_dir):
    r = _written_runs(spark, sf_dir)
    return r.select("model", "turn", F.col("pid").cast("bigint").alias("pid"), "organized_QA", "score",
                    "top1_result")


@query("run_identity")
def run_identity(spark, sf_dir):
    r = _written_runs(spark, sf_dir)
    return r.groupBy("model", "turn").agg(F.count(F.lit(1)).alias("n_rows"))


@query("resume_stream")
def resume_stream(spark, sf_dir):
    """Dialogues arrive as files in two drops (conversations that open with
    a system message first); each drop is validated by one availableNow
    run of the stream; the sink then holds every dialogue once."""
    from pyspark.sql import types as T
    T2 = B.B2_TURNS
    rows = B.b2_turn_rows(spark, sf_dir)
    sys_first = rows.where((F.col("pos") == 0) & (F.col("role") == "system")).select("conv_id")
    d = B.b2_dialogues(spark, sf_dir, max_items=2 * T2 + 1).select("conv_id", "QA")
    drops = [d.join(sys_first, "conv_id", "left_semi"), d.join(sys_first, "conv_id", "left_anti")]
    src, sink, ckpt = (staging_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("QA", T.ArrayType(T.StringType()))])

    def process(df):
        return df.select("conv_id", DG.marker_count("QA", T2, B.B2_MARKER).alias("n_marker"),
                         DG.validate_turns("QA", T2, B.B2_MARKER).alias("status"))

    for drop in drops:
        drop.write.mode("append").parquet(src)
        INC.resume_stream(spark, src, schema, process, sink, ckpt)
    return spark.read.parquet(sink).select("conv_id", "n_marker", "status")


def _model_requests(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    return c.select(RQ.request_id("echo", "conv_id", "turn").alias("request_id"), F.col("text").alias("prompt"))


@query("apply_model")
def apply_model(spark, sf_dir):
    from colloquy.plans.standins import make_echo_model
    out = RQ.apply_model(_model_requests(spark, sf_dir), make_echo_model, batch_size=8, backoff_seconds=0)
    return out.select("request_id", "response", "error", F.col("attempts").cast("bigint").alias("attempts"))


@query("apply_model_errors")
def apply_model_errors(spark, sf_dir):
    from colloquy.plans.standins import MAX_RETRIES, make_refusing_model
    # one item a call: in larger batches an item also takes part in calls that others spoil
    out = RQ.apply_model(_model_requests(spark, sf_dir), make_refusing_model, batch_size=1,
                         max_retries=MAX_RETRIES, backoff_seconds=0)
    return out.select("request_id", "response", "error", F.col("attempts").cast("bigint").alias("attempts"))


@query("call_model")
def call_model(spark, sf_dir):
    """One prompt per call, many calls in flight in each task."""
    from colloquy.operators import calls
    from colloquy.plans.standins import make_echo_call
    out = calls.call_model(_model_requests(spark, sf_dir), make_echo_call, in_flight=16)
    return out.select("request_id", "response", "error", F.col("attempts").cast("bigint").alias("attempts"))


@query("reply_ledger")
def reply_ledger(spark, sf_dir):
    """A first run in which the service refuses some requests, then one that asks for these again; the
    ledger has every reply once, and only the refused requests were asked twice."""
    from colloquy.operators import calls
    from colloquy.plans.standins import make_echo_call, make_refusing_call
    path, buckets = staging_path(spark, "ledger"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests = _model_requests(spark, sf_dir)
    first = calls.call_into_ledger(requests, make_refusing_call, path, buckets, in_flight=16, max_retries=2, backoff_seconds=0)
    refused = first.where("response IS NULL").select("request_id", F.col("attempts").alias("refused")).checkpoint()
    out = calls.call_into_ledger(requests, make_echo_call, path, buckets, in_flight=16)
    out = out.join(refused, "request_id", "left")
    return out.select("request_id", "response", "error", (F.col("attempts") + F.coalesce("refused", F.lit(0))).cast("bigint").alias("attempts"))


@query("leaderboard_states")
def leaderboard_states(spark, sf_dir):
    """The leaderboard from the states of four batches of dialogues."""
    from colloquy.operators import rollup
    rows, path = B.b3_results(spark, sf_dir), staging_path(spark, "states")
    for i in range(4):
        rollup.add_batch(rows.where(F.pmod(F.xxhash64("pid"), F.lit(4)) == i), path, i)
    return _rounded(rollup.roll_up(spark, path))


@query("exact_quantiles")
def exact_quantiles(spark, sf_dir):
    """Quartiles of prices by return flag, by selection over value counts."""
    from colloquy.operators import rollup
    q = rollup.exact_quantiles(B.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    return q.select("l_returnflag", *[F.round(F.col("quantiles")[i], 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75))])


# --------------------------------------------------- C the whole evaluation

from colloquy.operators import stages as ST  # noqa: E402


def _organize(spark, sf_dir):
    org = ST.organize_requests(B.c_dialogues(spark, sf_dir), B.C_KEYS, B.C_TURNS, B.C_ORGANIZER)
    return ST.organize_results(org, B.c_organizer_replies(spark, sf_dir), "ord")


def _compare(spark, sf_dir):
    organized, gold = stored(_organize(spark, sf_dir), "organized"), B.c_gold(spark, sf_dir)
    reqs = ST.compare_requests(organized, gold, B.C_KEYS, B.C_COMPARER)
    return ST.compare_results(organized, reqs, B.c_comparer_replies(spark, sf_dir, reqs), gold, B.C_KEYS, order_col="ord")


def _predict(spark, sf_dir):
    scored = stored(_compare(spark, sf_dir), "scored")
    reqs = ST.predict_requests(scored, B.c_profiles(spark, sf_dir), B.C_KEYS, B.C_TURNS, system=B.C_PREDICTOR_SYSTEM, order_col="ord")
    preds, judge = ST.judge_requests(scored, reqs, B.c_predictor_replies(spark, sf_dir), B.C_KEYS, B.C_JUDGE_SYSTEM, "ord")
    return scored, reqs, preds, judge


@query("stage_organize")
def stage_organize(spark, sf_dir):
    return _organize(spark, sf_dir).select("o_orderkey", "organized_QA", F.size("QA").cast("bigint").alias("n_items"))


@query("stage_compare")
def stage_compare(spark, sf_dir):
    return _compare(spark, sf_dir).select("o_orderkey", "status", *ST.SCORES, "referred_gold_label", "reasons")


@query("stage_predict")
def stage_predict(spark, sf_dir):
    _, reqs, preds, _ = _predict(spark, sf_dir)
    m = F.col("messages")
    return reqs.select("o_orderkey", m[0]["content"].alias("system"), m[1]["content"].alias("prompt")).join(preds, "o_orderkey").select(
        "o_orderkey", "system", "prompt", F.col("predict_status").alias("status"), F.array_join("model_predictions", "|").alias("predictions"))


@query("stage_judge")
def stage_judge(spark, sf_dir):
    _, _, _, judge = _predict(spark, sf_dir)
    # only what is shown goes through the join, not the messages
    asked = judge.select("o_orderkey", "stage", "request_id", F.col("messages")[0]["content"].alias("system"), "prompt")
    j = RQ.attach_replies(asked, B.c_judge_replies(spark, sf_dir), "ord")
    v = X.parse_judgement(X.fenced_block("response"))
    return j.select("o_orderkey", "stage", "system", "prompt", v["reasoning"].alias("reasoning"), v["result"].alias("result"))


@query("evaluate_run")
def evaluate_run(spark, sf_dir):
    scored, _, preds, judge = _predict(spark, sf_dir)
    out = ST.diagnose_results(scored, preds, judge, B.c_judge_replies(spark, sf_dir), B.C_KEYS, "ord")
    return out.select("o_orderkey", "status", "score", "weighted_score", "penalty_score", "reward_score", F.array_join("model_predictions", "|").alias("predictions"),
                      "topk_reason", "topk_result", "top1_reason", "top1_result")
