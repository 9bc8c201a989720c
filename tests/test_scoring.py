import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import schemas
from colloquy.operators.labels import runs_of
from colloquy.operators import scoring as S
from colloquy.plans.bindings import inline_table
from tests.rules import score_dialogue
from tests.window_form import score as score_by

# FIXTURES 3.1: gold of disease D in file order
GOLD_D = [("Hypertension", "m"), ("Sudden Severe Hypertension", "h"), ("Dyspnea", "h"),
          ("Exertional Dyspnea", "m"), ("Fatigue", "m")]

GOLDEN = {
    "d1": (["Sudden Severe Hypertension", "Hypertension", "Hypertension", "Not in Gold Label"], 3, 4, 2.0, 4.0),
    "d2": (["Fatigue", "Dysp", "Fatigue"], -1, -1, 1.0, 1.0),
    "d3": ([""], -1, -1, 0.0, 0.0),
    "d4": (["- Fatigue"], 0, 0, 0.0, 0.0),
    "d5": (["-Fatigue"], -1, -1, 0.0, 0.0),
}

BULLET_SCHEMA = T.StructType([
    T.StructField("did", T.StringType()), T.StructField("disease", T.StringType()),
    T.StructField("pos", T.LongType()), T.StructField("resp", T.StringType()),
    T.StructField("reason", T.StringType())])


def _gold(spark, rows_by_disease):
    rows, o = [], 0
    for d, labels in rows_by_disease.items():
        for s, w in labels:
            o += 1
            rows.append((d, o, s, w))
    return inline_table(spark, rows, schemas.GOLD)


def _bullets(spark, dialogues):
    rows = [(did, dis, i, a, f"r{i}") for did, (dis, answers) in dialogues.items() for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, BULLET_SCHEMA)


@pytest.mark.parametrize("form", ["package", "window"])
def test_golden_rows(spark, form):
    gold = _gold(spark, {"D": GOLD_D})
    b = _bullets(spark, {k: ("D", v[0]) for k, v in GOLDEN.items()})
    got = {r.did: r for r in score_by(b, gold, ["did"], form=form).collect()}
    for did, (_, score, weighted, penalty, reward) in GOLDEN.items():
        r = got[did]
        assert (r.score, r.weighted_score, r.penalty_score, r.reward_score) == (score, weighted, penalty, reward), did
    assert got["d1"].label_trace == ("- Sudden Severe Hypertension\n- Hypertension\n- Hypertension\n"
                                     "- Not in Gold Label\n")
    assert got["d2"].label_trace == "- Fatigue\n"
    assert got["d3"].label_trace == "" and got["d5"].label_trace == ""
    assert got["d4"].label_trace == "- Not in Gold Label\n"
    assert got["d2"].status == "match_error" and got["d1"].status == "clean"


def test_exact_mode_d1(spark):
    gold = _gold(spark, {"D": GOLD_D})
    b = _bullets(spark, {"d1": ("D", GOLDEN["d1"][0])})
    r = S.score_bullets(b, gold, ["did"], mode=S.EXACT).collect()[0]
    assert (r.penalty_score, r.reward_score) == (2.5, 3.5)


def test_error_guard(spark):
    gold = _gold(spark, {"D": GOLD_D})
    dialogues = spark.createDataFrame([("d1", "D", "- x"), ("d6", "D", "Early Stop Error."), ("d7", "D", "Error")],
                                      "did string, disease string, organized_QA string")
    b = _bullets(spark, {"d1": ("D", GOLDEN["d1"][0])})
    out = {r.did: r for r in S.apply_error_guard(dialogues, S.score_bullets(b, gold, ["did"]), ["did"]).collect()}
    assert out["d1"].score == 3
    for did in ("d6", "d7"):
        r = out[did]
        assert (r.score, r.weighted_score, r.penalty_score, r.reward_score) == (-1, -1, -1.0, -1.0)
        assert r.referred_gold_label == "Error." and r.reasons == "Error."


VOCAB = ["Hypertension", "Sudden Severe Hypertension", "Dyspnea", "Exertional Dyspnea", "Fatigue", "Fatig",
         "", "-Fatigue", "- Fatigue", "Cough", "ension", "Not in Gold Label", "Gold", "Pain", "Chest Pain"]
GOLDS = {
    "D": GOLD_D,
    "E": [("Pain", "h"), ("Chest Pain", "m"), ("Pain", "m"), ("Cough", "h")],
    "G": [("Gold", "m"), ("Fatigue", "h")],
}


def _random_dialogues(seed, n):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        disease = rnd.choice(["D", "E", "G", "unknown"])
        out[f"x{i}"] = (disease, [rnd.choice(VOCAB) for _ in range(rnd.randint(1, 12))])
    return out


@pytest.mark.parametrize("mode", [S.SUBSTRING, S.EXACT])
def test_forms_agree_with_rule(spark, mode):
    dialogues = _random_dialogues(7 if mode == S.SUBSTRING else 11, 300)
    gold = _gold(spark, GOLDS)
    b = _bullets(spark, dialogues)
    forms = {f: {r.did: r for r in score_by(b, gold, ["did"], mode=mode, form=f).collect()}
             for f in ("package", "window")}
    for did, (disease, answers) in dialogues.items():
        reasons = [f"r{i}" for i in range(len(answers))]
        want = score_dialogue(answers, GOLDS.get(disease, []), reasons, exact=(mode == S.EXACT))
        for f, got in forms.items():
            r = got[did]
            assert (r.score, r.weighted_score, r.penalty_score, r.reward_score, r.label_trace,
                    r.reason_trace) == want, (f, did, disease, answers)


def test_invariants_and_partition_count(spark):
    dialogues = _random_dialogues(3, 200)
    gold = _gold(spark, GOLDS)
    b = _bullets(spark, dialogues)
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            shuffled = b.orderBy(F.rand(5))
            results.append(sorted(tuple(r) for r in S.score_bullets(shuffled, gold, ["did"]).drop("break_pos")
                                  .collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert results[0] == results[1]
    for r in results[0]:
        _, _, n, n_live, score, weighted, penalty, reward = r[:8]
        if score >= 0:
            assert score <= weighted <= 2 * score
            assert penalty <= score <= reward
            assert penalty + reward == 2 * score


def test_labels_over_two_lines(spark):
    gold = _gold(spark, {"M": [("Fever", "m"), ("Chest pain\nat rest", "h")]})
    b = _bullets(spark, {"m1": ("M", ["Fever", "Chest pain\nat rest"]), "m2": ("M", ["Chest pain"])})
    got = {r.did: r for r in S.score_bullets(b, gold, ["did"]).collect()}
    assert (got["m1"].score, got["m1"].weighted_score, got["m1"].label_trace) == (2, 3, "- Fever\n- Chest pain\nat rest\n")
    assert (got["m2"].score, got["m2"].status) == (-1, "match_error")


#: Labels that lie inside one another, over one entry or several.
LINED = {"M": [("a\n- b", "m"), ("b", "h"), ("x a", "m"), ("b\n- b\n- c", "h"), ("c", "m"), ("a", "h"), ("b\n-", "m"), ("a\n", "h"), ("b\nq", "m"), ("Label\n- a", "h")],
         "N": [("p\nq", "m"), ("q", "h"), ("p", "h")]}


@pytest.mark.parametrize("mode", [S.SUBSTRING, S.EXACT])
def test_labels_over_several_lines(spark, mode):
    rnd = random.Random(5)
    vocab = {d: [s for s, _ in rows] * 3 + ["Not in Gold Label", "zz", "Gold"] for d, rows in LINED.items()}
    dialogues = {f"m{i}": (d, [rnd.choice(vocab[d]) for _ in range(rnd.randint(1, 14))]) for i in range(400) for d in [rnd.choice(["M", "M", "N"])]}
    gold, b = _gold(spark, LINED), _bullets(spark, dialogues)
    forms = {f: {r.did: r for r in score_by(b, gold, ["did"], mode=mode, form=f).collect()} for f in ("package", "window")}
    again = 0
    for did, (disease, answers) in dialogues.items():
        want = score_dialogue(answers, LINED[disease], [f"r{i}" for i in range(len(answers))], exact=(mode == S.EXACT))
        again += want[3] > want[2]
        for f, got in forms.items():
            r = got[did]
            assert (r.score, r.weighted_score, r.penalty_score, r.reward_score, r.label_trace, r.reason_trace) == want, (f, did, answers)
    assert again > 100


def test_runs_are_exactly_the_sequences_that_hold_a_label():
    labels = [s for s, _ in LINED["M"]]
    runs = set(runs_of(labels))
    every = [*labels, "Not in Gold Label"]
    for label in labels:
        for run in [(x, y) for x in every for y in every] + [(x, y, z) for x in every for y in every for z in every]:
            text = "".join(f"- {x}\n" for x in run)
            inside = any(label in "".join(f"- {x}\n" for x in run[i:j]) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if j - i < len(run))
            assert (label in text and not inside) <= ((label, run) in runs) <= (label in text)


def test_decomposed_plan_shape(spark):
    """No window, label tables broadcast, one shuffle join (the join back)."""
    gold = _gold(spark, GOLDS)
    b = _bullets(spark, _random_dialogues(5, 20))
    plan = S.score_bullets(b, gold, ["did"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("BroadcastHashJoin") >= 3
    assert plan.count("SortMergeJoin") <= 1


def test_hot_dialogue(spark):
    """One dialogue holds a third of all statements; results still equal
    the rule (the hot key is reduced map-side and split by AQE)."""
    rnd = random.Random(9)
    dialogues = _random_dialogues(13, 200)
    n_rest = sum(len(a) for _, a in dialogues.values())
    hot = [rnd.choice(["Hypertension", "Fatigue", "Dyspnea", "Cough", "Exertional Dyspnea"]) for _ in range(n_rest // 2)]
    dialogues["hot"] = ("D", hot)
    gold = _gold(spark, GOLDS)
    got = {r.did: r for r in S.score_bullets(_bullets(spark, dialogues), gold, ["did"]).collect()}
    for did in ("hot", "x0", "x1"):
        disease, answers = dialogues[did]
        want = score_dialogue(answers, GOLDS.get(disease, []), [f"r{i}" for i in range(len(answers))])
        r = got[did]
        assert (r.score, r.weighted_score, r.penalty_score, r.reward_score, r.label_trace) == want[:5]


def test_hot_dialogue_is_split(spark):
    """The statements of a hot dialogue reach several tasks."""
    n = 9000
    hot = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 97).cast("string"))).alias("did"),
                                F.lit("D").alias("disease"), F.col("id").alias("pos"), F.lit("Fatigue").alias("resp"), F.lit("r").alias("reason"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        f = S.bullet_flags(hot, _gold(spark, GOLDS), ["did"]).where("did = 'hot'")
        parts = [r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, "true")
    assert sum(parts) == n // 3 and max(parts) < 0.6 * sum(parts)


def test_answers_are_judged_once(spark):
    """Each distinct answer is searched once, exactly as in the list's text."""
    from colloquy.operators.labels import gold_list_text
    labels = ["Fatigue", "Dry cough", "over\ntwo lines", "Dry cough", "", None, "end "]
    gold = spark.createDataFrame([("D", i, x, "h") for i, x in enumerate(labels)] + [(None, 9, "n", "m")], "disease string, ord bigint, symptom string, weight string")
    said = ["Fatigue", "atig", "end ", "end", "two lines\n-Dry", "over\ntwo", "Fatigue\n-Dry", "Fatigue\n-over", "", "none", None, "-", "\n"]
    rows = [(d, f"x{i % 3}", i, x) for d in ("D", "E", None) for i, x in enumerate(said * 3)]
    b = spark.createDataFrame(rows, "disease string, did string, pos int, resp string")
    text = {r.disease: r.gold_list for r in gold_list_text(gold).collect()}
    want = {(d, x): x is not None and d is not None and x in text.get(d, "") or x == "" for d, _, _, x in rows}
    got = S.annotate_bullets(b, gold).collect()
    assert len(got) == len(rows) and all(r.hit == want[r.disease, r.resp] for r in got)
    assert all((r.weight == "h") == (r.disease == "D" and r.resp in set(labels) - {None}) for r in got)
    known = S.known_answers(b, gold)
    assert known.count() == known.select("disease", "resp").distinct().count()


def test_states_of_short_dialogues_are_not_copied(spark):
    b = spark.createDataFrame([("a", "D", i, "Fatigue", "r") for i in range(5)], "did string, disease string, pos int, resp string, reason string")
    f = S.bullet_flags(b, _gold(spark, GOLDS), ["did"])
    assert "__salt" not in f._jdf.queryExecution().optimizedPlan().toString() and f.count() == 5


def test_short_dialogues_are_dealt_once(spark):
    """No step between the statements and their scores deals them by anything but the dialogue,
    and the runs of labels over several entries come out as in the long form."""
    rnd = random.Random(21)
    vocab = [s for s, _ in LINED["M"]] * 3 + ["Not in Gold Label", "zz"]
    b = _bullets(spark, {f"m{i}": ("M", [rnd.choice(vocab) for _ in range(12)]) for i in range(60)})
    gold = _gold(spark, LINED)
    out = S.score_bullets(b, gold, ["did"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [did" in plan and "repartitionByRange" not in plan and "__part" not in plan
    ann = S.annotate_bullets(b, gold)
    near, far = ({tuple(r) for r in S._crossing(ann, gold, ["did"], whole).groupBy("did", "symptom").agg(F.min("first_pos")).collect()} for whole in (True, False))
    assert near == far and len(near) > 20
