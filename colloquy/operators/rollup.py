"""Leaderboards from mergeable states, and exact quantiles without a map per group.

A batch's state says how often each value of each score occurs among the clean rows of a run, and how
many rows fall into each outcome: ``keys, name, value, n``.  States of batches merge by adding ``n``,
so a roll-up reads states only, never the rows of earlier batches, and is the same however the
rows were dealt to batches.  A state has as many rows as there are different values.

Quantiles are found by selection: the value counts are range-partitioned by (group, value), so a
group of any size is spread over many tasks; sums per partition place every value's ranks, and only
the values that hold a wanted rank are kept.  No task holds a group, or a map of its values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import broadcast_if_small
from colloquy.operators.metrics import RUN_KEYS, SCORE_COLS, error_flags, is_clean

_LENGTHS = ["clean", "early_stop", "format_error", "matching_error", "other_error"]


def states(df: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """``keys, name, value, n`` of one batch of scored and diagnosed dialogues.  ``name`` is a score (with
    its values over clean rows) or a counter (``value`` is NULL)."""
    clean, flags = is_clean(), error_flags()
    scores = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), (clean & F.col(c).isNotNull()).alias("on")) for c in SCORE_COLS]
    counters = {**{f"{k}_len": flags[k] for k in _LENGTHS}, "total_len": F.lit(True), "top1": clean & F.col("top1_result").eqNullSafe(True), "topk": clean & F.col("topk_result").eqNullSafe(True)}
    counted = [F.struct(F.lit(k).alias("name"), F.lit(None).cast("double").alias("value"), v.alias("on")) for k, v in counters.items()]
    rows = df.select(*keys, F.explode(F.array(*scores, *counted)).alias("s")).where("s.on")
    return rows.groupBy(*keys, F.col("s.name").alias("name"), F.col("s.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """States of several batches as one."""
    return parts.groupBy(*keys, "name", "value").agg(F.sum("n").alias("n"))


def add_batch(df: DataFrame, path: str, batch: int, keys=RUN_KEYS) -> None:
    """Write a batch's state beside those of the others; written again, it replaces itself."""
    out = states(df, keys).withColumn("batch", F.lit(batch).cast("bigint"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def value_quantiles(counts: DataFrame, keys: list[str], q: list[float], value: str = "value", n: str = "n") -> DataFrame:
    """``keys, quantiles``: exact quantiles of values that occur ``n`` times, interpolated as ``percentile``
    does it.  ``counts`` has a row for each different value of a group."""
    rows = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.col(n).cast("bigint").alias("__n"))
    ranged = rows.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("__part", *keys).agg(F.sum("__n").alias("__s"))  # a row for each partition that a group spans
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    other = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy("__part", *keys).orderBy("__v")
    # a partition's share of a group: the window never holds more than a partition
    placed = ranged.withColumn("__to", F.sum("__n").over(inside))
    off = offsets.select(F.col("__part").alias("__p"), *other, "__before")
    placed = placed.join(broadcast_if_small(off), (F.col("__part") == F.col("__p")) & same).withColumn("__to", F.col("__to") + F.col("__before")).drop("__p", "__before", *[f"__k{i}" for i in range(len(keys))])
    total = sums.groupBy(*keys).agg(F.sum("__s").alias("__total"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(x) * (F.col("__total") - 1)).alias("at")) for i, x in enumerate(q)]))
    wanted = total.select(*other, place.alias("w")).select(*[f"__k{i}" for i in range(len(keys))], "w.i", "w.at")
    lower, upper = F.floor("at"), F.ceil("at")
    hit = placed.join(broadcast_if_small(wanted), same & (F.col("__to") > lower) & (F.col("__to") - F.col("__n") <= upper))
    low = F.max(F.when((F.col("__to") - F.col("__n") <= lower) & (lower < F.col("__to")), F.col("__v"))).alias("low")
    high = F.max(F.when((F.col("__to") - F.col("__n") <= upper) & (upper < F.col("__to")), F.col("__v"))).alias("high")
    each = hit.groupBy(*keys, "i", "at").agg(low, high)
    result = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((upper - F.col("at")) * F.col("low") + (F.col("at") - lower) * F.col("high"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", result.alias("r")))), lambda x: x["r"])
    return each.groupBy(*keys).agg(listed.alias("quantiles"))


def exact_quantiles(df: DataFrame, keys: list[str], col: str, q: list[float]) -> DataFrame:
    """``keys, quantiles`` of a column: equal values are counted before the shuffle, then as above."""
    counts = df.groupBy(*keys, F.col(col).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return value_quantiles(counts, keys, q)


def leaderboard(parts: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """The rows of ``metrics.run_leaderboard`` from the states of any number of batches."""
    keys = list(keys)
    whole = merge(parts, keys).checkpoint()
    values = whole.where(F.col("name").isin(SCORE_COLS))
    means = values.groupBy(*keys, "name").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("count"))
    names = [*keys, "name"]

    def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"__{k}") for k in on], *[c for c in b.columns if c not in on])
        same = F.lit(True)
        for k in on:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return a.join(b, same, "left").drop(*[f"__{k}" for k in on])

    spread = joined(values, means, names).groupBy(*names).agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2))).alias("ss"), F.max("mean").alias("mean"), F.max("count").alias("count"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("ss") / (F.col("count") - 1)))
    stats = joined(spread, value_quantiles(values, names, [0.5]), names)
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, v)).alias(f"{c}_{k}") for c in SCORE_COLS for k, v in (("mean", F.col("mean")), ("median", F.col("quantiles")[0]), ("std", std))])

    def count(name: str):
        return F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0))

    rate = [F.try_divide(count(a).cast("double"), count("clean_len")).alias(f"{a}_accuracy") for a in ("top1", "topk")]
    lengths = [count(f"{k}_len").alias(f"{k}_len") for k in [*_LENGTHS, "total"]]
    return joined(whole.groupBy(*keys).agg(*rate, *lengths), wide, keys)


def roll_up(spark: SparkSession, path: str, keys=RUN_KEYS) -> DataFrame:
    """The leaderboard of all batches whose states are in ``path``."""
    return leaderboard(spark.read.parquet(path).drop("batch"), keys)
