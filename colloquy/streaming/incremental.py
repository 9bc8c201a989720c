"""Resumable runs.

Batch: the finished rows live in an append-only table; a resumed run
takes the pending rows with a key-based anti join (not a count of rows
done, which is wrong when rows finish out of order), processes them and
appends.  Streaming: a file-source stream over the input folder with
``foreachBatch`` and a checkpoint; ``availableNow`` processes what is new
and stops, so a second run sees only files that arrived since.  Each
micro-batch overwrites its own ``batch_id`` partition, so a batch that is
re-run after a failure does not duplicate rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.sources.sinks import append_rows, ensure_table


def pending_rows(todo: DataFrame, done: DataFrame, keys: list[str], failed: str | None = None) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``; rows of ``done`` for
    which the condition ``failed`` holds (a model call that ended in an
    error) don't count and are done again."""
    if failed is not None:
        done = done.where(~F.coalesce(F.expr(failed), F.lit(False)))
    return todo.join(done.select(*keys), keys, "left_anti")


def resume_batch(spark: SparkSession, todo: DataFrame, process: Callable[[DataFrame], DataFrame],
                 out_path: str, keys: list[str], out_schema: StructType, partition_cols=(),
                 failed: str | None = None) -> DataFrame:
    """Process the rows of ``todo`` not yet in ``out_path``, or there only as
    ``failed``, and append them; returns the result table, in which a failed
    row gives way to a later one of its key."""
    ensure_table(spark, out_path, out_schema, partition_cols)
    done = spark.read.schema(out_schema).parquet(out_path)
    new = process(pending_rows(todo, done, keys, failed))
    append_rows(new.select(*out_schema.fieldNames()), out_path, partition_cols)
    out = spark.read.schema(out_schema).parquet(out_path)
    if failed is None:
        return out
    bad = F.coalesce(F.expr(failed), F.lit(False))
    good = out.where(~bad)
    lost = out.where(bad).join(good.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return good.unionByName(lost.select(*out_schema.fieldNames()))


def resume_stream(spark: SparkSession, source_dir: str, source_schema: StructType,
                  process: Callable[[DataFrame], DataFrame], sink_path: str, checkpoint: str,
                  max_files_per_trigger: int | None = None) -> None:
    """One ``availableNow`` run of the stream: every file that arrived in
    ``source_dir`` since the last run is processed once."""
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        out = process(df).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
