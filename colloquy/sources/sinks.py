"""Writers: append-only result tables, per-stage tables with idempotent
partition overwrite, metrics documents and legacy CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from colloquy.operators.metrics import metrics_struct


def ensure_table(spark: SparkSession, path: str, schema: StructType, partition_cols=()) -> None:
    """Create an empty table when the path does not exist yet."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partition_cols).parquet(path)


def append_rows(df: DataFrame, path: str, partition_cols=("model", "turn")) -> None:
    """Append finished rows; the commit protocol replaces the file lock."""
    df.write.mode("append").partitionBy(*partition_cols).parquet(path)


def stage_write(df: DataFrame, path: str, partition_cols=("model", "turn")) -> None:
    """Write a stage table to its own folder (never the folder being read);
    only the partitions present in ``df`` are replaced, so re-running a
    stage for one run is idempotent."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def write_metrics_json(df: DataFrame, path: str, keys=("model", "turn")) -> None:
    """One JSON document per run (nulls written, never NaN)."""
    doc = metrics_struct(df, list(keys))
    (doc.select(*keys, "metrics.*").write.mode("overwrite").option("ignoreNullFields", "false")
     .partitionBy(*keys).json(path))


def to_csv_frame(df: DataFrame) -> DataFrame:
    """Arrays become JSON text so a CSV cell holds them."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_cols=()) -> None:
    """pandas-readable CSV (header, ``""`` escapes, multi-line cells)."""
    (to_csv_frame(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", True).partitionBy(*partition_cols).csv(path))


def export_sorted(df: DataFrame, path: str, order_cols: list[str]) -> None:
    """Export in key order: a range-partitioned sort, part files in order
    (no single-task global sort)."""
    write_csv(df.orderBy(*order_cols), path)


def write_legacy_runs(df: DataFrame, base: str, keys=("model", "turn")) -> list[str]:
    """Write one ``{model}_turn_{n}.csv`` folder per run (the legacy name
    layout): a partitioned write, then one rename per run folder (metadata
    only; the number of renames is the number of runs).  The model name
    keeps its last ``/`` segment, as run files are named; two models that
    would share a name are an error, raised before anything is written."""
    spark = df.sparkSession
    short = F.substring_index(F.col(keys[0]), "/", -1)
    shared = df.select(*keys).distinct().groupBy(short.alias("m"), F.col(keys[1])).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if shared:
        raise ValueError(f"several models share a run file name: {[tuple(r)[:2] for r in shared]}")
    staging = base.rstrip("/") + "/_partitioned"
    write_csv(df, staging, partition_cols=keys)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(staging)
    fs = root.getFileSystem(conf)
    out = []
    for m in fs.listStatus(root):
        name = m.getPath().getName()
        if not m.isDirectory() or not name.startswith(f"{keys[0]}="):
            continue
        unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        model = unescape(name.split("=", 1)[1]).split("/")[-1]
        for t in fs.listStatus(m.getPath()):
            tname = t.getPath().getName()
            if not t.isDirectory() or not tname.startswith(f"{keys[1]}="):
                continue
            target = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{model}_turn_{tname.split('=', 1)[1]}.csv")
            if fs.exists(target) or not fs.rename(t.getPath(), target):
                raise OSError(f"could not move a run to {target}")
            out.append(target.toString())
    return out


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each partition as one JSON array file (the profile file layout);
    an array never spans more than one partition's rows."""
    import pandas as pd

    def arrays(batches):
        opened = False
        for pdf in batches:  # one line per row: the array is never held as a whole
            lines = pdf["j"].tolist()
            if lines:
                yield pd.DataFrame({"value": [("," if opened or i else "[") + x for i, x in enumerate(lines)]})
                opened = True
        if opened:
            yield pd.DataFrame({"value": ["]"]})

    from colloquy.session import ship_package
    ship_package(df.sparkSession)
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    rows.mapInPandas(arrays, "value string").write.mode("overwrite").text(path)
