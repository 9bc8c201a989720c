"""Test bindings: how the driver tables play the parts of the domain tables.

B1 bullets      = events (one dialogue per user, statements in time order)
B2 dialogues    = conversations (one dialogue per conversation, by turn)
B3 results      = documents LEFT JOIN labels (scored and diagnosed dialogues)
C  evaluation   = orders (dialogues), part (labels), customer (profiles)
B4 lookups      = orders, customer, nation, region, lineitem
B5 replies      = model replies built from documents

Every binding is a projection of whole tables; nothing is filtered to a
subset to make a check cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------- B1
# Fixed binding parameter: the label list of the five test diseases, in
# file order.  d0 repeats "click" with another weight (first one counts);
# d4 has "hard error", which makes the answer "error" a non-exact hit.
B1_GOLD_ROWS: list[tuple[str, int, str, str]] = []
for _k in range(5):
    for _sym, _w in [("view", "m"), ("repeat view", "h"), ("click", "m"), ("purchase", "h")]:
        B1_GOLD_ROWS.append((f"d{_k}", len(B1_GOLD_ROWS) + 1, _sym, _w))
    if _k == 0:
        B1_GOLD_ROWS.append(("d0", len(B1_GOLD_ROWS) + 1, "click", "h"))
    if _k == 4:
        B1_GOLD_ROWS.append(("d4", len(B1_GOLD_ROWS) + 1, "hard error", "h"))

B1_KEYS = ["dialogue_id"]


def inline_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """Small parameter table as an inline VALUES relation: unlike a table
    made from a Python list (an RDD of unknown size), its size is known to
    the planner, so size-checked broadcasts apply."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v}L" if isinstance(v, int) else repr(v)
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    names = ", ".join(f.name for f in schema.fields)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def b1_gold(spark: SparkSession) -> DataFrame:
    return inline_table(spark, B1_GOLD_ROWS, schemas.GOLD)


def b1_disease(user_col: str = "user_id"):
    return F.concat(F.lit("d"), (F.col(user_col) % 5).cast("string"))


def b1_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per event, in time order; answers above 50 are the
    'repeat' form of the event type."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("dialogue_id"),
        b1_disease().alias("disease"),
        "event_id",
        # (user_id, ts) is unique, so the timestamp alone orders a dialogue;
        # a primitive position keeps every aggregate hash-based
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
        .alias("pos"),
        F.when(F.col("value") > 50, F.concat(F.lit("repeat "), F.col("event_type")))
        .otherwise(F.col("event_type")).alias("resp"),
        F.col("props").alias("reason"),
    )


def b1_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("dialogue_id")).distinct().withColumn(
        "disease", b1_disease("dialogue_id"))


# --------------------------------------------------------------------- B3
# Scored and diagnosed dialogues: run = (model = source, turn = 2..5),
# organizer outcome by doc_id % 5 (format error, early stop, generic
# error, missing, bullets), scores as simple functions of n_chars.
B3_ORGANIZED = ["QA format Error.", "Early Stop Error.", "Error", None, "bullets"]


def b3_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels")
    # every document is a dialogue; one without a label has no judgement
    r = d.join(lab, "doc_id", "left")
    k = F.col("doc_id") % 5
    n = F.col("n_chars")
    organized = (F.when(k == 0, F.lit(B3_ORGANIZED[0])).when(k == 1, F.lit(B3_ORGANIZED[1]))
                 .when(k == 2, F.lit(B3_ORGANIZED[2])).when(k == 3, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("- "), F.col("lang"))))
    guarded = k < 3
    score = F.when(guarded, F.lit(-1)).otherwise(n % 7 - 1).cast("bigint")
    r = r.select(
        F.col("source").alias("model"),
        (F.col("doc_id") % 4 + 2).cast("bigint").alias("turn"),
        F.col("doc_id").alias("pid"), "lang", "quality", "toxic",
        organized.alias("organized_QA"),
        score.alias("score"),
        F.when(score == -1, F.lit(-1)).otherwise(score + (n % 2) * score).cast("bigint").alias("weighted_score"),
        F.when(guarded, F.lit(-1.0)).otherwise((n % 11).cast("double") / 2).alias("penalty_score"),
        F.when(guarded, F.lit(-1.0)).otherwise((n % 13).cast("double") / 2 + 1).alias("reward_score"),
    )
    failed = F.col("score") == -1
    return r.withColumn("top1_result", F.when(failed, F.lit(False)).otherwise(F.col("quality") == 1)) \
            .withColumn("topk_result", F.when(failed, F.lit(False))
                        .otherwise((F.col("quality") == 1) | (F.col("toxic") == 1)))


# --------------------------------------------------------------------- B2
# Dialogues: one per conversation; ``turn`` is the 0-based item position
# (dense in the table), the first item is the head (chief complaint).
B2_TURNS = 2
B2_MARKER = "the"
B2_SEP = "\x1e"  # record separator used to show a list as one text

# Own prompt texts for the test bindings (the real ones are read at run
# time from the user's prompt files).
ORGANIZER_TEMPLATE = ("List every finding about {disease} stated in the dialogue below as lines "
                      "starting with '- '.\n\nDialogue:\n{input}")
DOCTOR_SYSTEM = "You interview the patient before the visit.\nPatient: {patient_information}"
PATIENT_SYSTEM = "You are the patient described here: {patient_information}"


def b2_turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("pos"), "role", "text")


def b2_disease():
    return F.concat(F.lit("d"), (F.col("conv_id") % 5).cast("string"))


def b2_dialogues(spark: SparkSession, sf_dir: str, max_items: int | None = None) -> DataFrame:
    from colloquy.operators.dialogue import assemble_dialogue
    d = assemble_dialogue(b2_turn_rows(spark, sf_dir), ["conv_id"], max_items=max_items)
    return d.withColumn("disease", b2_disease())


# --------------------------------------------------------------------- B5
# Model replies built from whole documents (the full text is used, never a
# prefix): comparer verdicts, fenced predictor YAML and judge YAML.
B5_STRIP_PAD_LEFT = "  　"
B5_STRIP_PAD_RIGHT = " \n\x1c "
B5_TEMPLATE = "Decide whether the note below is about {disease}.\n{input}\n(answer for {disease})"
B5_BATCH = 4


def b5_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def b5_verdict_reply():
    k = F.col("doc_id") % 5
    t, lang, src = F.col("text"), F.col("lang"), F.col("source")
    return (F.when(k == 0, F.concat(F.lit("Reason: "), t, F.lit("\nFinal Response: **"), lang, F.lit("**")))
            .when(k == 1, t)
            .when(k == 2, F.lit("Final Response:"))
            .when(k == 3, F.concat(F.lit("Reason: Reason: "), src, F.lit(" Final Response: "), lang,
                                   F.lit(" Final Response: "), src))
            .otherwise(F.concat(F.lit("Reason: "), t, F.lit("\nFinal Response: ** "), src, F.lit(" **"))))


def b5_predictor_reply():
    k = F.col("doc_id") % 7
    return (F.when(k == 0, F.concat(F.lit("Sure.\n```yaml\nDiseases:\n  - "), F.col("lang"), F.lit("\n  - "),
                                    F.col("source"), F.lit("\n```\n"), F.col("text")))
            .when(k == 1, F.concat(F.lit("Diseases:\n  - "), F.col("source")))
            .when(k == 2, F.concat(F.lit("```yaml\nDiseases: ["), F.col("lang"), F.lit(", 'a b', \"Crohn's\"]\nNotes:\n- none\n```")))
            .when(k == 3, F.concat(F.lit("Diseases:\n- \""), F.col("source"), F.lit("\"\n- Crohn's\n\nNotes:\n- not one\n")))
            .when(k == 4, F.lit("Diseases:\nNotes:\n- not one"))
            .when(k == 5, F.concat(F.lit("  Diseases:\n  - "), F.col("source")))
            .otherwise(F.col("text")))


def b5_judge_reply():
    k = F.col("doc_id") % 8
    return (F.when(k == 0, F.concat(F.lit("```yaml\nReasoning: "), F.col("source"), F.lit(" matches\nResult: True\n```")))
            .when(k == 1, F.concat(F.lit("Reasoning: no match\nResult: "),
                                   F.when(F.col("n_chars") % 2 == 0, F.lit("yes")).otherwise(F.lit("True/False"))))
            .when(k == 2, F.concat(F.lit("Reasoning: "), F.col("lang"), F.lit("\nResult: False")))
            .when(k == 3, F.concat(F.lit("```yaml\nReasoning: |\n  "), F.col("source"), F.lit(" fits\n    well\n  Result: False\n\nResult: True\n```")))
            .when(k == 4, F.concat(F.lit("Reasoning: >\n  "), F.col("source"), F.lit("\n  fits\nResult: no")))
            .when(k == 5, F.concat(F.lit("Reasoning: \""), F.col("lang"), F.lit("\"\n  Result: True")))
            .when(k == 6, F.concat(F.lit("Reasoning: it\n  goes on\nResult: \"True\"")))
            .otherwise(F.lit("Reasoning only")))


def b5_model_name():
    k = F.col("doc_id") % 4
    return (F.when(k == 0, F.lit("gpt-4o-mini")).when(k == 1, F.lit("claude-3-haiku"))
            .when(k == 2, F.concat(F.lit("org/"), F.col("lang"), F.lit("-model")))
            .otherwise(F.concat(F.lit("llama-"), F.col("source"))))


def b5_scrub_response():
    return F.concat(F.lit("- 체중 변화는 없다.\n- 두통이 없다.\n- 기침은 없다.\n"), F.col("text"),
                    F.lit("\n- 발열은 없다.\n- 피로감이 없다.\n"))


def b5_scrub_context():
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" 두통 피곤"))).otherwise(F.col("text"))


# --------------------------------------------------------------------- B4
# Profiles = customers (padded key, nation as disease, a few info keys),
# dialogues = orders (pid = customer key), replies = per-order line items.
def b4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.functions.text import pad_key
    from colloquy.operators.joins import broadcast_if_small
    c = table(spark, sf_dir, "customer")
    n = broadcast_if_small(table(spark, sf_dir, "nation"))
    r = broadcast_if_small(table(spark, sf_dir, "region"))
    p = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    info = F.create_map(F.lit("Chief Complaint"), F.col("c_mktsegment"), F.lit("Region"), F.col("r_name"),
                        F.lit("Name"), F.col("c_name"))
    return p.select(pad_key("c_custkey").alias("pid"), F.col("n_name").alias("disease_name"),
                    info.alias("simple_info"), "c_custkey", "c_name", "n_name", "r_name", "c_acctbal")


def b4_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("pid"), "o_orderstatus", "o_orderpriority",
                    "o_orderdate")


def b4_order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order results computed from line items (pre-aggregated before
    any join, so the join side is one row per order)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"),
                                        F.sum("l_quantity").alias("total_qty"))


# ------------------------------------------------------------ profile maps
# Profiles built from events: JSON text with a string, a list and a number
# value, the chief complaint under the Korean or the English key.
def profile_json():
    k = F.get_json_object(F.col("props"), "$.k")
    key = F.when(F.col("user_id") % 2 == 0, F.lit("주증상")).otherwise(F.lit("Chief Complaint"))
    return F.concat(F.lit('{"pid": "'), F.col("event_id").cast("string"), F.lit('", "'), key, F.lit('": "'),
                    F.col("event_type"), F.lit('", "Hx": ["'), F.col("event_type"), F.lit('", "'), k,
                    F.lit('"], "Age": '), k, F.lit(', "token": "t'), F.col("user_id").cast("string"), F.lit('"}'))


def b_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", "props",
                     F.from_json(profile_json(), "map<string,string>").alias("info"))


def list_cell():
    plain = F.concat(F.lit("['"), F.col("event_type"), F.lit("', '"), F.col("props"), F.lit("', 'u"),
                     F.col("user_id").cast("string"), F.lit("\\tx']"))
    escaped = F.concat(F.lit("['"), F.col("event_type"), F.lit("\\x41\\a', \"it's\\v\", 'u"), F.col("user_id").cast("string"),
                       F.lit("\\U0001F600\\101']"))
    return F.when(F.col("event_id") % 4 == 0, escaped).otherwise(plain)


# ---------------------------------------------------------------------- D
# Labels from parts, some over two lines, some of them parts of others; one
# statement per order, a customer's orders in key order are a dialogue.
def d_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = F.substring_index("p_type", " ", 1), F.expr("substr(p_type, instr(p_type, ' ') + 1)")
    k = F.col("p_size") % 5
    symptom = (F.when(k == 0, F.concat(first, F.lit("\n- "), rest)).when(k == 1, F.concat(first, F.lit("\n"), rest))
               .when(k == 2, first).when(k == 3, rest).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("disease"), F.col("p_partkey").alias("ord"), symptom.alias("symptom"),
                                               F.when(F.col("p_size") > 25, "h").otherwise("m").alias("weight"))


def d_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are labels of any disease, a part of one, or none."""
    gold = d_gold(spark, sf_dir)
    n = gold.count()  # one number
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dialogue_id"), k.alias("event_id"), k.alias("pos"), F.col("o_orderpriority").alias("reason"), ((k * 31) % n + 1).alias("__part"))
    j = o.join(gold.select(F.col("ord").alias("__part"), "symptom"), "__part", "left")
    said = F.when(k % 97 == 0, F.substring("symptom", 2, 100)).when(k % 11 == 0, F.lit("Not there")).otherwise(F.coalesce("symptom", F.lit("")))
    return j.withColumnRenamed("event_id", "o_orderkey").withColumn("resp", said).select("dialogue_id", d_disease().alias("disease"), F.col("o_orderkey").alias("event_id"), "pos", "resp", "reason")


def d_disease(cust_col: str = "dialogue_id"):
    c = F.col(cust_col)
    return F.concat(F.lit("Brand#"), (c % 5 + 1).cast("string"), (F.floor(c / 5) % 6 + 1).cast("string"))


def d_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dialogue_id")).distinct().withColumn("disease", d_disease())


# ---------------------------------------------------------------------- C
# The evaluation chain: one dialogue per order, labels from parts, profiles
# from customers, replies as functions of the keys.  They hold what services
# deliver: missing, doubled (the greater ``ord`` is the later) and unreadable
# replies; profiles hold doubled and absent customers and odd keys.
C_KEYS = ["o_orderkey"]
C_TURNS = 2
C_ORGANIZER = "Findings about {disease}:\n{input}"
C_COMPARER = "{disease}\n{a}\n{b}"
C_PREDICTOR_SYSTEM = "Name the likely diseases."
C_JUDGE_SYSTEM = "Judge the predictions."


def c_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("disease"), F.col("p_type").alias("symptom")).agg(
        F.min("p_partkey").alias("ord"), F.min_by(F.when(F.col("p_size") > 25, "h").otherwise("m"), "p_partkey").alias("weight"))


def c_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    first = F.concat(F.lit("Question: since "), F.col("o_orderstatus"), F.lit("?"))
    answer = F.concat(F.lit("answer "), F.col("o_custkey").cast("string"))
    two, last = F.lit("Question: how?"), F.lit("badly\n\nvery")
    both = F.lit("Question: a Question: b")
    head = F.col("o_orderpriority")
    qa = (F.when(k % 9 == 0, F.array(head, both, answer, two, last)).when(k % 9 == 1, F.array(head, first, answer, F.lit("thanks"), last))
          .when(k % 9 == 2, F.array(head, both, answer)).when(k % 2 == 0, F.array(head, first, answer, two, last, F.lit("Question: more?"), F.lit("no")))
          .otherwise(F.array(head, first, answer, two, last)))
    pid = F.when(k % 13 == 0, F.concat(F.lit("P-"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", pid.alias("pid"), F.concat(F.lit("Brand#"), (k % 27 + 1).cast("string")).alias("disease"), qa.alias("QA"))


def _twice(rows: DataFrame, again, old: str) -> DataFrame:
    """``rows`` with ``ord`` 2 and, where ``again`` holds, an older reply."""
    both = F.array_compact(F.array(F.struct(F.lit(2).alias("ord"), F.col("response")),
                                   F.when(again, F.struct(F.lit(1).alias("ord"), F.lit(old).alias("response")))))
    return rows.select("request_id", F.explode(both).alias("r")).select("request_id", "r.ord", "r.response")


def c_organizer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.operators.requests import request_id
    k = F.col("o_orderkey")
    lines = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 4), lambda i: F.concat(F.lit("- statement "), i.cast("string"))), "\n")
    rows = table(spark, sf_dir, "orders").where(k % 17 != 0).select(
        k, request_id("organize", "o_orderkey").alias("request_id"), F.when(k % 19 == 0, "Error in service").otherwise(lines).alias("response"))
    return _twice(rows, k % 5 == 0, "- old")


def c_comparer_replies(spark: SparkSession, sf_dir: str, requests: DataFrame) -> DataFrame:
    k, pos = F.col("o_orderkey"), F.col("pos")
    ends = c_gold(spark, sf_dir).groupBy(F.col("disease").alias("d")).agg(F.min("symptom").alias("lo"), F.max("symptom").alias("hi"))
    c = (k + pos) % 6
    lo, hi = F.coalesce("lo", F.lit("none")), F.coalesce("hi", F.lit("none"))
    said = (F.when(c == 2, hi).when(c == 3, F.lit("Not there")).when((c == 5) & (k % 3 == 0), F.substring(lo, F.lit(2), F.length(lo))).otherwise(lo))
    rows = requests.join(ends, F.col("disease") == F.col("d"), "left").where((k * 7 + pos) % 41 != 0).select(
        k, pos, "request_id", F.concat(F.lit("Reason: r-"), pos.cast("string"), F.lit("\nFinal Response: **"), said, F.lit("**")).alias("response"))
    return _twice(rows, c == 1, "Reason: x\nFinal Response: old")


def c_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.functions.text import pad_key
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 != 0)
    both = F.array_compact(F.array(F.struct(F.lit(2).alias("ord"), F.col("c_mktsegment").alias("said")),
                                   F.when(F.col("c_custkey") % 10 == 0, F.struct(F.lit(1).alias("ord"), F.lit("old").alias("said")))))
    c = c.select("c_custkey", "c_name", F.explode(both).alias("r"))
    info = F.create_map(F.lit("Chief Complaint"), F.col("r.said"), F.lit("Name"), F.col("c_name"), F.lit("Hx"), F.lit(None).cast("string"))
    return c.select(pad_key("c_custkey").alias("pid"), info.alias("simple_info"), F.col("r.ord").alias("ord"))


def c_predictor_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.operators.requests import request_id
    k = F.col("o_orderkey")
    named = F.concat(F.lit("Diseases:\n  - Brand#"), (k % 27 + 1).cast("string"), F.lit("\n  - Other"))
    said = (F.when(k % 8 == 0, F.lit("Sure.\n```yaml\nDiseases:\n- \"Asthma\"\n- Crohn's\nNotes:\n- none\n```"))
            .when(k % 8 == 1, F.lit("Diseases: [Asthma, 'COPD']")).when(k % 8 == 2, F.lit("no idea")).otherwise(named))
    rows = table(spark, sf_dir, "orders").where(k % 8 != 3).select(k, request_id("predict", "o_orderkey").alias("request_id"), said.alias("response"))
    return _twice(rows, k % 5 == 0, "Diseases:\n- old")


def c_judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.operators.requests import request_id
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    out = None
    for n, stage in enumerate(("judge_topk", "judge_top1")):
        c = (k + n) % 7
        said = (F.when(c == 0, F.lit("Reasoning: |\n  fine match\n  Result: False\n  more\nResult: True"))
                .when(c == 1, F.lit("```yaml\nReasoning: \"no\"\nResult: False\n```")).when(c == 3, F.lit("Reasoning only"))
                .when(c == 4, F.lit("Reasoning: plain\n  goes on\nResult: yes")).otherwise(F.lit("Reasoning: ok\nResult: True")))
        rows = _twice(o.where(c != 2).select(k, request_id(stage, "o_orderkey").alias("request_id"), said.alias("response")), k % 5 == 0, "Reasoning: old\nResult: False")
        out = rows if out is None else out.unionByName(rows)
    return out
