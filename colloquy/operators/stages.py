"""The evaluation stages chained from the operators.

Each stage is split at the model call: ``*_requests`` builds the request
table (``request_id``, ``messages`` plus keys), the caller obtains replies
``(request_id, response)`` from ``requests.apply_model`` or any batch
service, and ``*_results`` joins them back by ``request_id``.  Replies may
come twice (the last one counts, by an order column when there is one) or
not at all.  Every input dialogue stays in the result exactly once; a
``status`` says how far it came:

``organizer_error``   validation failed, or the organizer's text is an error
``missing_reply``     a statement has no comparer reply: scores are NULL and
                      the dialogue is pending
``match_error``       a statement was no exact label: scores are -1
``no_profile``        scored, but no profile to predict from
``missing_prediction`` / ``prediction_parse_error``
``missing_judgement`` / ``judge_parse_error``
``ok``

Failed dialogues never produce requests.  Write each stage's replies to a
table (``sources.sinks.stage_write``) before the next stage: replies are
costly and not repeatable, so no later stage may recompute them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions.scrub import scrub_negations
from colloquy.operators import dialogue as DG
from colloquy.operators import diagnosis as D
from colloquy.operators import scoring as S
from colloquy.operators.joins import broadcast_if_small
from colloquy.operators.labels import gold_list_text
from colloquy.operators.requests import attach_replies, messages, request_id
from colloquy.session import stored

SCORES = ["score", "weighted_score", "penalty_score", "reward_score"]


# ------------------------------------------------------------- organize

def organize_requests(dialogues: DataFrame, keys: list[str], turns: int, template: str,
                      marker: str = "Question:") -> DataFrame:
    """Cut to ``turns``, validate, render; ``prompt`` and ``messages`` only
    for valid rows."""
    d = dialogues.withColumn("QA", DG.cut_turns("QA", turns))
    d = d.withColumn("status", DG.validate_turns("QA", turns, marker)).withColumn(
        "rendered", X.render_dialogue(DG.head("QA"), DG.body("QA", turns), turns))
    prompt = X.fill_template(template, [("input", F.col("rendered")), ("disease", F.col("disease"))])
    valid = F.col("status") == DG.VALID
    return d.withColumn("request_id", request_id("organize", *keys)).withColumn("prompt", F.when(valid, prompt)) \
        .withColumn("messages", F.when(valid, messages(prompt)))


def organize_results(org: DataFrame, replies: DataFrame, order_col: str | None = None) -> DataFrame:
    """``organized_QA``: scrubbed reply for valid rows, the validation
    error text otherwise, ``Error`` when a valid row got no reply."""
    j = attach_replies(org, replies, order_col)
    ok = F.coalesce(scrub_negations(F.col("response"), F.col("rendered")), F.lit(DG.GENERIC_ERROR))
    organized = F.when(F.col("status") == DG.VALID, ok).otherwise(F.col("status"))
    return j.withColumn("organized_QA", organized).drop("response", "prompt", "messages", "request_id", "status")


# -------------------------------------------------------------- compare

def compare_requests(organized: DataFrame, gold: DataFrame, keys: list[str], template: str) -> DataFrame:
    """One request per statement of every dialogue that passed the guard."""
    ok = organized.where(~_failed())
    lines = ok.select(*keys, "disease", F.posexplode(F.split("organized_QA", "\n", -1)).alias("pos", "line"))
    gl = broadcast_if_small(gold_list_text(gold).withColumnRenamed("disease", "__gd"))
    b = lines.join(gl, F.col("disease") == F.col("__gd"), "left").drop("__gd")
    prompt = X.fill_template(template, [("disease", F.col("disease")),
                                        ("a", F.coalesce(F.col("gold_list"), F.lit(""))),
                                        ("b", X.strip("line"))])
    return b.select(*keys, "disease", F.col("pos").cast("bigint").alias("pos"),
                    request_id("compare", *keys, "pos").alias("request_id"), prompt.alias("prompt"),
                    messages(prompt).alias("messages"))


def _failed():
    """The comparer's guard: an organizer error text (or none) is not compared."""
    return F.coalesce(F.col("organized_QA").contains("Error"), F.lit(True))


def compare_results(organized: DataFrame, bullet_requests: DataFrame, replies: DataFrame, gold: DataFrame,
                    keys: list[str], mode: str = S.SUBSTRING, order_col: str | None = None) -> DataFrame:
    """Parse every reply, score each dialogue, attach with the guard.  A
    dialogue that misses a reply is pending: its scores and traces are NULL.
    The parsed replies are stored, as the scoring reads them several times."""
    j = attach_replies(bullet_requests, replies, order_col)
    v = X.parse_verdict(F.coalesce(F.col("response"), F.lit("")))
    bullets = j.select(*keys, "disease", "pos", v["answer"].alias("resp"), v["reason"].alias("reason"),
                       F.col("response").isNull().alias("absent"))
    bullets = stored(bullets, "bullets")
    scored = S.apply_error_guard(organized, S.score_bullets(bullets, gold, keys, mode=mode), keys)
    absent = bullets.groupBy(*keys).agg(F.count_if("absent").alias("__absent"))
    out = scored.join(absent, keys, "left")
    pending = F.coalesce(F.col("__absent"), F.lit(0)) > 0
    status = (F.when(_failed(), F.lit("organizer_error")).when(pending, F.lit("missing_reply"))
              .when(F.col("score") == -1, F.lit("match_error")).otherwise(F.lit("ok")))
    hidden = {c: F.when(~pending, F.col(c)) for c in [*SCORES, "referred_gold_label", "reasons"]}
    return out.withColumn("status", status).withColumns(hidden).drop("__absent")


# ------------------------------------------------------------- diagnose

def predict_requests(scored: DataFrame, profiles: DataFrame, keys: list[str], turns: int,
                     pid_col: str = "pid", system: str | None = None, order_col: str | None = None) -> DataFrame:
    """Predictor input (profile + history) for every scored dialogue; the
    last profile of a pid counts.  Without one, ``status`` is ``no_profile``
    and there is no request text."""
    clean = scored.where(F.col("status") == "ok").drop("status")
    known = D.last_profiles(profiles.select("pid", "simple_info", *([order_col] if order_col else [])), order_col)
    j = D.join_profile(clean, known, pid_col)
    prompt = D.predictor_input(X.render_profile("simple_info", trailing_newline=True), X.render_history("QA", turns))
    has = F.col("profile_key").isNotNull()
    return j.select(*keys, request_id("predict", *keys).alias("request_id"), F.when(has, prompt).alias("prompt"),
                    F.when(has, messages(prompt, system)).alias("messages"),
                    F.when(has, F.lit("ok")).otherwise(F.lit("no_profile")).alias("status"))


def judge_requests(scored: DataFrame, predict_reqs: DataFrame, predict_replies: DataFrame,
                   keys: list[str], system: str | None = None, order_col: str | None = None):
    """Parsed predictions ``(keys, model_predictions, predict_status)`` and
    the top-k and top-1 judge requests built from them, out of one join that
    is stored."""
    p = attach_replies(predict_reqs.select(*keys, "request_id", "status"), predict_replies, order_col)
    p = p.withColumn("__parsed", X.parse_predictions(X.fenced_block("response")))  # a column of its own: evaluated once
    parsed = F.col("__parsed")
    status = (F.when(F.col("status") != "ok", F.col("status")).when(F.col("response").isNull(), F.lit("missing_prediction"))
              .when(parsed.isNull(), F.lit("prediction_parse_error")).otherwise(F.lit("ok")))
    p = stored(p.select(*keys, F.when(status == "ok", parsed).alias("model_predictions"), status.alias("predict_status")), "predictions")
    j = scored.select(*keys, "disease").join(p.where("predict_status = 'ok'"), keys)
    asked = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), D.judge_input(D.python_list_text(x), F.col("disease")).alias("prompt"))
                                for s, x in (("judge_topk", F.col("model_predictions")), ("judge_top1", D.top_k(F.col("model_predictions"), 1)))]))
    reqs = j.select(*keys, asked.alias("r")).select(*keys, "r.stage", "r.prompt")
    rid = F.when(F.col("stage") == "judge_topk", request_id("judge_topk", *keys)).otherwise(request_id("judge_top1", *keys))
    return p, reqs.withColumn("request_id", rid).withColumn("messages", messages(F.col("prompt"), system))


def diagnose_results(scored: DataFrame, predictions: DataFrame, judge_reqs: DataFrame,
                     judge_replies: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Attach predictions and both judgements; failed dialogues get the
    defaults (no prediction, both results false).  One row per dialogue."""
    jr = attach_replies(judge_reqs, judge_replies, order_col).select(
        *keys, "stage", "response", X.parse_judgement(X.fenced_block("response")).alias("j"))
    wide = jr.groupBy(*keys).agg(
        *[F.max(F.when(F.col("stage") == f"judge_{s}", F.col(f"j.{c}"))).alias(f"{s}_{n}")
          for s in ("topk", "top1") for c, n in (("reasoning", "reason"), ("result", "result"))],
        F.count_if(F.col("response").isNull()).alias("__silent"), F.count_if(~F.col("j.ok")).alias("__bad"))
    out = D.attach_results(D.attach_results(scored, predictions, keys), wide, keys)
    final = (F.when(F.col("status") != "ok", F.col("status")).when(F.col("predict_status") != "ok", F.col("predict_status"))
             .when(F.coalesce(F.col("__silent"), F.lit(2)) > 0, F.lit("missing_judgement"))
             .when(F.col("__bad") > 0, F.lit("judge_parse_error")).otherwise(F.lit("ok")))
    out = out.withColumn("status", final).drop("predict_status", "__silent", "__bad")
    return D.sentinel_default(out).drop("n_calls")
