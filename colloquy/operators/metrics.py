"""Roll-up of scored and diagnosed dialogues into run metrics.

Input: one row per dialogue with ``model, turn`` (the run), ``organized_QA``,
the four scores and the two judge booleans.  Everything is one
``groupBy(model, turn)`` over all rows with conditional aggregates, so all
runs come out of one job and every aggregate is computed partially before
the shuffle (``percentile`` keeps one count per distinct value, which stays
small for scores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_COLS = ["score", "weighted_score", "penalty_score", "reward_score"]
RUN_KEYS = ["model", "turn"]

# Organizer outcomes the error counts test for.
EARLY_STOP = "Early Stop Error."
FORMAT_ERROR = "QA format Error."


def is_clean(score_col: str = "score") -> Column:
    """``score != -1`` with pandas semantics: a missing score is kept."""
    return ~F.col(score_col).eqNullSafe(-1)


def clean_rows(df: DataFrame) -> DataFrame:
    return df.where(is_clean())


def _has_error(org: Column) -> Column:
    return F.coalesce(org.contains("Error"), F.lit(False))


def error_flags(org_col: str = "organized_QA") -> dict[str, Column]:
    """The four counted classes (independent predicates, as the original
    counts them) and ``other_error`` for rows in none of them."""
    org = F.col(org_col)
    flags = {
        "clean": is_clean(),
        "early_stop": F.coalesce(org == EARLY_STOP, F.lit(False)),
        "format_error": F.coalesce(org == FORMAT_ERROR, F.lit(False)),
        "matching_error": ~_has_error(org) & F.coalesce(F.col("score") == -1, F.lit(False)),
    }
    any_flag = flags["clean"] | flags["early_stop"] | flags["format_error"] | flags["matching_error"]
    flags["other_error"] = ~any_flag
    return flags


def status_column(org_col: str = "organized_QA") -> Column:
    """One exclusive status per dialogue, first matching class wins."""
    f = error_flags(org_col)
    out = F.lit("other_error")
    for name in ["matching_error", "format_error", "early_stop", "clean"]:
        out = F.when(f[name], F.lit(name)).otherwise(out)
    return out


def error_guard(org_col: str = "organized_QA") -> Column:
    """True when the organizer output is an error text (or missing): such a
    dialogue is not compared and gets the -1 sentinel everywhere."""
    return F.coalesce(F.col(org_col).contains("Error"), F.lit(True))


def _pct(x: Column, q) -> Column:
    return F.percentile(x, F.array(*[F.lit(v) for v in q]) if isinstance(q, list) else F.lit(q))


def _stat_aggs(col: str, clean: Column, describe: bool) -> list[Column]:
    x = F.when(clean, F.col(col).cast("double"))
    out = [
        F.avg(x).alias(f"{col}_mean"),
        _pct(x, 0.5).alias(f"{col}_median"),
        F.stddev_samp(x).alias(f"{col}_std"),
    ]
    if describe:
        q = _pct(x, [0.25, 0.5, 0.75])
        out += [
            F.count(x).alias(f"{col}_count"),
            F.min(x).alias(f"{col}_min"),
            q[0].alias(f"{col}_p25"),
            q[2].alias(f"{col}_p75"),
            F.max(x).alias(f"{col}_max"),
        ]
    return out


def score_stats(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """mean / median / sample std of the four scores over clean rows."""
    clean = is_clean()
    return df.groupBy(*keys).agg(*[a for c in SCORE_COLS for a in _stat_aggs(c, clean, False)])


def score_describe(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """pandas ``describe()`` of each score over clean rows, long format:
    ``keys, metric, count, mean, std, min, p25, p50, p75, max``."""
    clean = is_clean()
    wide = df.groupBy(*keys).agg(*[a for c in SCORE_COLS for a in _stat_aggs(c, clean, True)])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}_{n}").alias(m) for n, m in (
        ("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "p25"), ("median", "p50"), ("p75", "p75"), ("max", "max"))])
        for c in SCORE_COLS])
    # runs without a clean row have no describe, as an empty frame has none
    return wide.where(F.greatest(*[F.col(f"{c}_count") for c in SCORE_COLS]) > 0).select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")


def _rate(flag: Column, clean: Column) -> Column:
    return F.try_divide(F.count_if(clean & flag).cast("double"), F.count_if(clean).cast("double"))


def accuracy_aggs() -> list[Column]:
    clean = is_clean()
    return [
        _rate(F.col("top1_result").eqNullSafe(True), clean).alias("top1_accuracy"),
        _rate(F.col("topk_result").eqNullSafe(True), clean).alias("topk_accuracy"),
    ]


def count_aggs(org_col: str = "organized_QA") -> list[Column]:
    f = error_flags(org_col)
    return [F.count_if(f[k]).alias(f"{k}_len") for k in
            ["clean", "early_stop", "format_error", "matching_error", "other_error"]] + [
        F.count(F.lit(1)).alias("total_len")]


def accuracy_rates(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Share of clean rows the judge marked true (NULL with no clean row)."""
    return df.groupBy(*keys).agg(*accuracy_aggs())


def error_counts(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(*count_aggs())


def run_leaderboard(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """All run metrics in one aggregation: one row per (model, turn)."""
    clean = is_clean()
    aggs = [a for c in SCORE_COLS for a in _stat_aggs(c, clean, False)] + accuracy_aggs() + count_aggs()
    return df.groupBy(*keys).agg(*aggs)


def metrics_struct(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """The per-run metrics document as a nested struct column ``metrics``
    (same layout as the original JSON; NULL where pandas writes NaN)."""
    clean = is_clean()
    aggs = []
    for c in SCORE_COLS:
        aggs += _stat_aggs(c, clean, True)
    aggs += accuracy_aggs() + count_aggs()
    flat = df.groupBy(*keys).agg(*aggs)

    def block(c):
        return F.struct(
            F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_median").alias("median"),
            F.col(f"{c}_std").alias("std_dev"),
            F.struct(F.col(f"{c}_count").cast("double").alias("count"), F.col(f"{c}_mean").alias("mean"),
                     F.col(f"{c}_std").alias("std"), F.col(f"{c}_min").alias("min"),
                     F.col(f"{c}_p25").alias("25%"), F.col(f"{c}_median").alias("50%"),
                     F.col(f"{c}_p75").alias("75%"), F.col(f"{c}_max").alias("max")).alias("describe"))

    doc = F.struct(*[block(c).alias(c) for c in SCORE_COLS],
                   F.col("top1_accuracy"), F.col("topk_accuracy"),
                   F.col("clean_len"), F.col("early_stop_len"), F.col("format_error_len"),
                   F.col("matching_error_len"), F.col("other_error_len"))
    return flat.select(*keys, doc.alias("metrics"))


def metrics_json(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """``keys, metrics_json``: the metrics document as JSON text (nulls
    kept as ``null``)."""
    return metrics_struct(df, keys).select(
        *keys, F.to_json("metrics", {"ignoreNullFields": "false"}).alias("metrics_json"))
