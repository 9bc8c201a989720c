"""Dense position numbering without a window over a whole key.

``row_number() OVER (PARTITION BY k ORDER BY o)`` sends every row of a key
to one task; with one key holding a third of the data that task is the job.
Here the rows are range-partitioned on ``(k, o)`` (a hot key is split over
many partitions), numbered inside each partition, and the per-partition
counts of each key are turned into offsets on a table that has at most one
row per (partition, key).  The numbered rows are checkpointed to the shared
checkpoint folder first so both passes see the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import ensure_checkpoint_dir


def dense_index(df: DataFrame, partition_cols: list[str], order_cols: list[str], out_col: str,
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``out_col``: 0-based position of the row within its
    ``partition_cols`` key in ``order_cols`` order (ties must be broken by
    the caller: ``order_cols`` should make rows unique)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = list(partition_cols)
    cols = [F.col(c) for c in keys + list(order_cols)]
    # without a number, AQE sizes the partitions from the data
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    ordered = ranged.sortWithinPartitions(*cols)
    numbered = ordered.withColumn("__part", F.spark_partition_id()) \
                      .withColumn("__local", F.monotonically_increasing_id() - (F.col("__part").cast("bigint") * (1 << 33)))
    numbered = numbered.checkpoint(eager=True)
    counts = numbered.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"),
                                                   F.min("__local").alias("__first"))
    # at most one row per (partition, key): a hot key has as many rows here
    # as partitions it spans, so this window is small for every key
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    off = offsets.select(F.col("__part").alias("__p2"), *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
                         "__offset", "__first")
    cond = F.col("__part") == F.col("__p2")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    out = numbered.join(off, cond).drop("__p2", *[f"__k_{i}" for i in range(len(keys))])
    return out.withColumn(out_col, (F.col("__offset") + F.col("__local") - F.col("__first")).cast("bigint")) \
              .drop("__part", "__local", "__offset", "__first")
