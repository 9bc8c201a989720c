"""Order-dependent scoring of matched statements ("bullets").

Input bullets: one row per statement with the dialogue key columns,
``disease``, an orderable ``pos`` (any sortable type, e.g. a struct of
timestamp and id), the parsed answer ``resp`` and an optional ``reason``.

Rules (per dialogue, in ``pos`` order):

* hit: ``resp`` is a substring of the disease's label-list text;
* a hit whose text is not exactly a label poisons the dialogue: scanning
  stops there (``break``), score and weighted score become -1, penalty and
  reward keep their sums so far;
* live hit: plain score +1, weighted +2 for weight ``h`` else +1;
  penalty +0.5 / reward +1.5 when the answer was already referred to
  (substring of the running trace text ``- label\\n...``), else +1 / +1;
* trace lines ``- label`` (``Not in Gold Label`` for non-hits) and
  ``- reason`` for every row before the break.

For long dialogues, only partial aggregations and equi-joins against small label tables are
used: first position per ``(dialogue, label)``, the break position, and the
"seen" test as a lookup of the earliest covering label.  No window and no
per-dialogue array of statements: a dialogue holding a third of all rows is
still split across tasks (partial aggregation; a salted join back).  A label over several lines
is found inside one entry of the trace like any other; where it can lie across entries, the
statements are numbered by a range partition and consecutive ones joined.  When no dialogue is
long, the statements are instead dealt by dialogue once for all of these steps, and a window of
at most ``HOT`` statements looks ahead for the runs.  The
tests hold the result against a running trace text in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import strip
from colloquy.operators.joins import broadcast_if_small
from colloquy.operators.labels import NOT_IN_GOLD, crossing_labels, gold_list_text, label_cover, label_runs, label_weight
from colloquy.operators.ranking import dense_index
from colloquy.session import stored

SUBSTRING = "substring"
EXACT = "exact"
#: Parts that the bullets of a dialogue of more than ``HOT`` are dealt to when its state is joined back.
SALTS, HOT = 8, 1000
#: Entries that a window looks at together; longer runs are joined step by step.
AHEAD = 16


def known_answers(bullets: DataFrame, gold: DataFrame) -> DataFrame:
    """``(disease, resp, hit, weight)`` of the distinct answers that are in
    their disease's list or have a weight.  A label is in its list; of the
    others, one without a line break is in the list if it is in one of its
    lines, so it is searched in the distinct lines only."""
    gl = gold_list_text(gold).withColumn("lines", F.array_join(F.array_distinct(F.split("gold_list", "\n", -1)), "\n"))
    gl = broadcast_if_small(gl.withColumnRenamed("disease", "__gd"))
    lw = broadcast_if_small(label_weight(gold).select(F.col("disease").alias("__wd"), F.col("symptom").alias("__ws"), "weight", F.lit(True).alias("__known")))
    a = bullets.select("disease", "resp").where("resp IS NOT NULL").distinct()
    a = a.join(lw, (F.col("disease") == F.col("__wd")) & (F.col("resp") == F.col("__ws")), "left")
    a = a.select("disease", "resp", "weight", (F.col("__known") & (strip("resp") == F.col("resp"))).alias("__label"))  # the list's end is stripped
    text = F.when(F.col("resp").contains("\n"), F.col("gold_list")).otherwise(F.col("lines"))
    a = a.join(gl, F.col("disease") == F.col("__gd"), "left")
    hit = F.coalesce(F.when(F.col("__label"), True).otherwise(F.coalesce(text, F.lit("")).contains(F.col("resp"))), F.lit(False))
    return a.select("disease", "resp", hit.alias("hit"), "weight").where("hit OR weight IS NOT NULL")


def annotate_bullets(bullets: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``hit``, ``weight``, ``poison`` and ``label`` per bullet by one
    lookup of its answer.  The answers are judged first, each once, and their
    table is stored: it is bounded by the distinct answers, and the bullets
    are moved only if it is too large to broadcast."""
    known = broadcast_if_small(stored(known_answers(bullets, gold), "answers")).select(
        F.col("disease").alias("__kd"), F.col("resp").alias("__kr"), "hit", "weight")
    b = bullets.join(known, F.col("disease").eqNullSafe(F.col("__kd")) & (F.col("resp") == F.col("__kr")), "left").drop("__kd", "__kr")
    b = b.withColumn("hit", F.coalesce("hit", F.lit(False)))
    b = b.withColumn("poison", F.col("hit") & F.col("weight").isNull())
    return b.withColumn("label", F.when(F.col("hit"), F.col("resp")).otherwise(F.lit(NOT_IN_GOLD)))


def _live(brk: Column) -> Column:
    return brk.isNull() | (F.col("pos") < brk)


def _crossing(ann: DataFrame, gold: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """``(keys, symptom, first_pos)``: where a label is first complete across
    consecutive entries of a dialogue's trace.  Only dialogues of diseases
    with such a label are numbered, and only their statements that take part
    in a run are joined, once for each further entry of the longest run.
    Where dialogues are ``whole`` in their partition and short, each statement
    looks ahead for the runs that it begins."""
    runs = stored(label_runs(gold), "runs")  # bounded by the label file
    longest = runs.agg(F.max(F.size("run"))).first()[0] or 0
    rows = ann.join(broadcast_if_small(runs.select("disease").distinct()), "disease", "left_semi").select(*keys, "disease", "pos", "label")
    if whole and 0 < longest <= AHEAD:
        return _looking_ahead(rows, runs, longest, keys)
    numbered = dense_index(rows, keys, ["pos"], "__at")
    used = runs.select("disease", F.explode("run").alias("label")).distinct()
    numbered = numbered.join(broadcast_if_small(used), ["disease", "label"], "left_semi").checkpoint()
    part = numbered.join(broadcast_if_small(runs.withColumnRenamed("disease", "__d")), (F.col("disease") == F.col("__d")) & (F.col("label") == F.get("run", F.lit(0))))
    part = part.select(*keys, "symptom", "run", "__at", F.col("pos").alias("first_pos"))
    out = None
    for n in range(1, longest):
        step = numbered.select(*keys, (F.col("__at") - 1).alias("__at"), F.col("label").alias("__l"), F.col("pos").alias("__p"))
        part = part.where(F.size("run") > n).join(step, [*keys, "__at"]).where(F.col("__l") == F.get("run", F.lit(n)))
        part = part.select(*keys, "symptom", "run", (F.col("__at") + 1).alias("__at"), F.col("__p").alias("first_pos"))
        ended = part.where(F.size("run") == n + 1).select(*keys, "symptom", "first_pos")
        out = ended if out is None else out.unionByName(ended)
    out = part.select(*keys, "symptom", "first_pos").limit(0) if out is None else out
    return out.groupBy(*keys, "symptom").agg(F.min("first_pos").alias("first_pos"))


def _looking_ahead(rows: DataFrame, runs: DataFrame, longest: int, keys: list[str]) -> DataFrame:
    """``_crossing`` of short dialogues: one sort of their statements."""
    ordered = Window.partitionBy(*keys).orderBy("pos")
    later = range(1, longest)
    j = rows.select("*", *[F.lead(c, n).over(ordered).alias(f"__{c}{n}") for n in later for c in ("label", "pos")])
    same = (F.col("disease") == F.col("__d")) & (F.col("label") == F.get("run", F.lit(0)))
    for n in later:
        same = same & ((F.size("run") <= n) | (F.col(f"__label{n}") == F.get("run", F.lit(n))))
    found = j.join(broadcast_if_small(runs.withColumnRenamed("disease", "__d")), same)
    end = F.coalesce(*[F.when(F.size("run") == n + 1, F.col(f"__pos{n}")) for n in later])
    return found.select(*keys, "symptom", end.alias("first_pos"))


def _seen_decomposed(ann: DataFrame, gold: DataFrame, keys: list[str], mode: str) -> DataFrame:
    # 0. when no dialogue is long, its statements are brought together once and
    #    the steps below need no further shuffle
    hot = stored(ann.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT).select(*keys), "hot")
    whole = hot.isEmpty()
    if whole:
        ann = ann.repartition(*keys)
    # 1. first position of each label per dialogue: partial aggregation,
    #    so a hot dialogue is reduced on the map side before the shuffle
    firsts = ann.groupBy(*keys, "disease", "label", "poison").agg(F.min("pos").alias("first_pos"))
    # 2. labels whose trace line covers each symptom (small broadcast side);
    #    poison labels get no cover row and carry the break position instead
    if mode == EXACT:
        cover = firsts.select("*", F.when(~F.col("poison"), F.col("label")).alias("symptom"))
    else:
        lc = broadcast_if_small(stored(label_cover(gold), "cover").withColumnRenamed("disease", "__cd"))
        cover = firsts.join(lc, (F.col("disease") == F.col("__cd")) & (F.col("label") == F.col("cover"))
                            & ~F.col("poison"), "left")
    cover = cover.select(*keys, "symptom", "first_pos", "poison")
    if mode != EXACT and not crossing_labels(gold).isEmpty():
        cover = cover.unionByName(_crossing(ann, gold, keys, whole).withColumn("poison", F.lit(False)))
    per_symptom = cover.groupBy(*keys, "symptom").agg(
        F.min(F.when(~F.col("poison"), F.col("first_pos"))).alias("cover_pos"),
        F.min(F.when(F.col("poison"), F.col("first_pos"))).alias("brk"))
    # 3. one state row per dialogue: break position and a symptom -> earliest
    #    cover map with at most one entry per label of its disease
    state = per_symptom.groupBy(*keys).agg(
        F.min("brk").alias("brk"),
        F.map_from_entries(F.collect_list(F.when(F.col("symptom").isNotNull() & F.col("cover_pos").isNotNull(),
                                                 F.struct("symptom", "cover_pos")))).alias("cover_map"))
    # 4. the single shuffle of whole bullets: join the state back by dialogue.
    #    Only long dialogues are dealt to several tasks, by a salt (AQE cannot
    #    split this join, as its other side is an aggregate); a state copied for
    #    every dialogue would be most of what is moved
    if whole:
        j = ann.join(state, keys, "left")
    else:
        hot = broadcast_if_small(hot.withColumn("__hot", F.lit(True)))
        parts = F.sequence(F.lit(0), F.when(F.col("__hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
        salted = state.join(hot, keys, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
        salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        j = ann.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot").join(salted, [*keys, "__salt"], "left").drop("__salt")
    seen = F.coalesce(F.try_element_at(F.col("cover_map"), F.col("resp")) < F.col("pos"), F.lit(False))
    if mode != EXACT:
        seen = seen | (F.col("resp") == "")  # '' is inside any text, even an empty one
    return j.withColumn("live", _live(F.col("brk"))).withColumn("seen", seen).drop("cover_map")


def bullet_flags(bullets: DataFrame, gold: DataFrame, keys: list[str],
                 mode: str = SUBSTRING) -> DataFrame:
    """Per-bullet ``hit, weight, poison, label, brk, live, seen``.  The
    bullets are read several times: store those that come out of joins."""
    return _seen_decomposed(annotate_bullets(bullets, gold), gold, keys, mode)


def score_bullets(bullets: DataFrame, gold: DataFrame, keys: list[str],
                  mode: str = SUBSTRING, carry: list[str] | None = None) -> DataFrame:
    """One row per dialogue: ``n_bullets, n_live, break_pos, score,
    weighted_score, penalty_score, reward_score, label_trace,
    reason_trace, status`` (``clean`` or ``match_error``); with ``carry``
    also ``break_row``, the carried columns of the poisoning bullet."""
    return score_flags(bullet_flags(bullets, gold, keys, mode), keys, carry)


def trace_rows(f: DataFrame, keys: list[str]) -> DataFrame:
    """The traces as a table, from per-bullet flags: one row per live
    statement with its label and reason.  A dialogue of any length stays
    rows; the trace texts of ``score_bullets`` are the export form."""
    reason = F.col("reason") if "reason" in f.columns else F.lit(None).cast("string")
    return f.where("live").select(*keys, "pos", "label", reason.alias("reason"))


def score_flags(f: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """The scores from per-bullet flags."""
    carry = list(carry or [])
    live_hit = F.col("live") & F.col("hit")
    has_reason = "reason" in f.columns
    f = f.select(
        *keys, "disease", "pos", *carry,
        F.col("live"), live_hit.alias("live_hit"), "brk",
        F.when(live_hit, F.when(F.col("weight") == "h", 2).otherwise(1)).alias("__w"),
        F.when(live_hit, F.when(F.col("seen"), 0.5).otherwise(1.0)).alias("__p"),
        F.when(live_hit, F.when(F.col("seen"), 1.5).otherwise(1.0)).alias("__r"),
        F.when(F.col("live"), F.concat(F.lit("- "), F.col("label"), F.lit("\n"))).alias("__lt"),
        (F.when(F.col("live"), F.concat(F.lit("- "), F.col("reason"), F.lit("\n"))) if has_reason
         else F.lit(None).cast("string")).alias("__rt"),
    )
    agg = f.groupBy(*keys).agg(
        F.any_value("disease").alias("disease"),
        F.count(F.lit(1)).alias("n_bullets"),
        F.count_if("live").alias("n_live"),
        F.max("brk").alias("break_pos"),
        F.count_if("live_hit").alias("__hits"),
        F.sum("__w").alias("__wsum"),
        F.sum("__p").alias("__psum"),
        F.sum("__r").alias("__rsum"),
        F.expr("listagg(__lt, '') WITHIN GROUP (ORDER BY pos)").alias("__ltrace"),
        F.expr("listagg(__rt, '') WITHIN GROUP (ORDER BY pos)").alias("__rtrace"),
        *([F.min_by(F.struct(*carry), F.when(F.col("pos") == F.col("brk"), F.col("pos"))).alias("break_row")]
          if carry else []),
    )
    poisoned = F.col("break_pos").isNotNull()
    return agg.select(
        *keys, "disease", "n_bullets", "n_live", "break_pos", *(["break_row"] if carry else []),
        F.when(poisoned, F.lit(-1).cast("bigint")).otherwise(F.col("__hits")).alias("score"),
        F.when(poisoned, F.lit(-1).cast("bigint")).otherwise(F.coalesce(F.col("__wsum"), F.lit(0)).cast("bigint"))
        .alias("weighted_score"),
        F.coalesce(F.col("__psum"), F.lit(0.0)).alias("penalty_score"),
        F.coalesce(F.col("__rsum"), F.lit(0.0)).alias("reward_score"),
        F.coalesce(F.col("__ltrace"), F.lit("")).alias("label_trace"),
        F.coalesce(F.col("__rtrace"), F.lit("")).alias("reason_trace"),
        F.when(poisoned, F.lit("match_error")).otherwise(F.lit("clean")).alias("status"),
    )


def apply_error_guard(dialogues: DataFrame, scored: DataFrame, keys: list[str],
                      organized_col: str = "organized_QA") -> DataFrame:
    """Attach scores to dialogues; a dialogue whose organizer output
    contains ``Error`` (or is missing) gets -1 for all four scores and the
    trace ``Error.`` (it was never scored)."""
    guard = F.coalesce(F.col(organized_col).contains("Error"), F.lit(True))
    s = scored.select(*keys, "label_trace", "reason_trace", "score", "weighted_score", "penalty_score",
                      "reward_score")
    j = dialogues.join(s, keys, "left")
    neg = F.lit(-1)
    return j.select(
        *[F.col(c) for c in dialogues.columns],
        F.when(guard, F.lit("Error.")).otherwise(F.col("label_trace")).alias("referred_gold_label"),
        F.when(guard, F.lit("Error.")).otherwise(F.col("reason_trace")).alias("reasons"),
        F.when(guard, neg.cast("bigint")).otherwise(F.col("score")).alias("score"),
        F.when(guard, neg.cast("bigint")).otherwise(F.col("weighted_score")).alias("weighted_score"),
        F.when(guard, neg.cast("double")).otherwise(F.col("penalty_score")).alias("penalty_score"),
        F.when(guard, neg.cast("double")).otherwise(F.col("reward_score")).alias("reward_score"),
    )
