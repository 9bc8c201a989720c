"""Diagnosis stage: profile lookup, judge inputs, result attachment and the
defaults for dialogues that failed earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X

# The headings of the judge's and the predictor's input.
PREDICTIONS, GOLDEN = "model_predictions: \n", "\ngolden_standard: \n"
PATIENT_INFO, HISTORY = "patient_info: \n", "\nmedical_history: \n"


def profile_key(col) -> Column:
    """Dialogue pid (number or text) -> the 8-digit profile key."""
    return X.pad_key(col)


def join_profile(dialogues: DataFrame, profiles: DataFrame, pid_col: str = "pid",
                 how: str = "left") -> DataFrame:
    """Dialogues with their profile on the padded key; a dialogue without
    one keeps its row with a NULL ``profile_key``.  ``profiles`` holds each
    pid once (``last_profiles``)."""
    p = profiles.withColumnRenamed("pid", "profile_key")
    d = dialogues.withColumn("__key", profile_key(F.col(pid_col)))
    return d.join(p, F.col("__key") == F.col("profile_key"), how).drop("__key")


def last_profiles(profiles: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per pid, the last one by ``order_col`` (file order, as
    numbered at ingest); without it, the greatest by its JSON text."""
    values = [c for c in profiles.columns if c not in ("pid", order_col)]
    packed = F.struct(*values)
    order = F.col(order_col) if order_col else F.to_json(packed)
    return profiles.groupBy("pid").agg(F.max_by(packed, order).alias("__p")).select("pid", "__p.*")


def unmatched_profiles(dialogues: DataFrame, profiles: DataFrame, pid_col: str = "pid") -> DataFrame:
    """Dialogues without a profile (the original stops with a KeyError)."""
    keys = profiles.select(F.col("pid").alias("__pk"))
    d = dialogues.withColumn("__key", profile_key(F.col(pid_col)))
    return d.join(keys, F.col("__key") == F.col("__pk"), "left_anti").drop("__key")


def dedup_last(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Last row per key by ``order_col`` (a dict built in file order keeps
    the last duplicate).  ``max_by`` on a struct: a partial aggregation,
    no window over a whole key (Spark sorts each task's rows for it).  With
    one other column the aggregate is hash-based."""
    others = [c for c in df.columns if c != key]
    if len(others) == 1:
        return df.groupBy(key).agg(F.max_by(others[0], F.col(order_col)).alias(others[0]))
    packed = F.struct(*[F.col(c) for c in others])
    agg = df.groupBy(key).agg(F.max_by(packed, F.col(order_col)).alias("__last"))
    return agg.select(key, *[F.col("__last")[c].alias(c) for c in others])


def judge_input(predictions: Column, disease: Column) -> Column:
    """``model_predictions: \\n<p>\\ngolden_standard: \\n<g>``."""
    return F.concat(F.lit(PREDICTIONS), predictions, F.lit(GOLDEN), disease)


def predictor_input(profile_text: Column, history: Column) -> Column:
    """``patient_info: \\n<profile>\\nmedical_history: \\n<history>``."""
    return F.concat(F.lit(PATIENT_INFO), profile_text, F.lit(HISTORY), history)


def python_list_text(arr: Column) -> Column:
    """``str(list)`` of a list of strings (how the predictions are shown to
    the judge): ``['a', "Crohn's"]``; the quote is chosen as ``repr`` does."""
    def quoted(x):
        body = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            body = F.replace(body, F.lit(raw), F.lit(shown))
        double = x.contains("'") & ~x.contains('"')
        return (F.when(double, F.concat(F.lit('"'), body, F.lit('"')))
                .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(F.transform(arr, quoted), ", "), F.lit("]"))


def top_k(predictions: Column, k: int = 1) -> Column:
    """First ``k`` predictions (``model_predictions[:k]``)."""
    return F.slice(predictions, 1, k)


def sentinel_default(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Dialogues with score -1 are not diagnosed: NULL predictions and
    reasons, both results false, no model call."""
    failed = F.col(score_col).eqNullSafe(-1)
    cols = []
    for c in df.columns:
        if c in ("model_predictions", "topk_reason", "top1_reason"):
            cols.append(F.when(failed, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c in ("topk_result", "top1_result"):
            cols.append(F.when(failed, F.lit(False)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols, F.when(failed, F.lit(0)).otherwise(F.lit(3)).cast("bigint").alias("n_calls"))


def attach_results(base: DataFrame, results: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Side-by-side attachment of stage results by key (never by position)."""
    return base.join(results, keys, how)
