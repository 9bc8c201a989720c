"""Readers for the legacy file layouts, with explicit schemas.

* dialogue / result CSV files written by pandas (header, quoted cells with
  newlines, doubled quotes); a file of any size is read by many tasks
  (``sources.records``),
* the gold-label CSV, numbered in file order at ingest,
* patient profiles as a JSON array,
* a directory of run files named ``{model}_turn_{n}.csv``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from colloquy import schemas
from colloquy.operators.joins import broadcast_if_small
from colloquy.operators.ranking import dense_index
from colloquy.sources import records as R

# Fixed value: run file names are ``{model}_turn_{n}.csv``; a Spark-written
# run is a folder of that name.
RUN_FILE_PATTERN = r"([^/]+)_turn_(\d+)\.csv(?:/[^/]*)?$"


# pandas-compatible cells: ``""`` is the quote escape (Spark's default ``\\``
# corrupts such cells), line breaks inside quotes stay as they are.
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": "__bad"}


def _by_name(names: list[str], places: list[int]):
    def pick(cells: Column) -> Column:
        return F.struct(*[cells[f"c{j}"].alias(c) for c, j in zip(names, places)], cells["__bad"].isNotNull().alias("__bad"))
    return pick


def read_by_name(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """CSV columns selected by the names in each file's header, in any order
    and among others.  Cells are read as text and cast: whole numbers may be
    written as ``3.0``.  ``parse_error`` lists the columns whose cell does not
    fit its type (the value is then NULL), or says that a row has another
    number of cells than its header; it is NULL for sound rows.  A missing
    column is an error.  Besides, ``__file``, and ``__start`` and ``__n``, by
    which a file's rows are in order."""
    rows, heads = R.records(spark, path, R.CSV)
    kinds: dict[tuple, list[str]] = {}
    for file, head in sorted(heads.items()):  # one row per file
        kinds.setdefault(tuple(R.names(head)), []).append(file)
    if not kinds:
        raise ValueError(f"{path} has no file with a header")
    for found, files in kinds.items():
        lacking = [c for c in schema.fieldNames() if c not in found]
        if lacking:
            raise ValueError(f"{files[0]} has no column {', '.join(lacking)}")
    which = F.lit(0) if len(kinds) == 1 else F.col("__kind")
    if len(kinds) > 1:
        known = spark.createDataFrame([(f, i) for i, files in enumerate(kinds.values()) for f in files], "__f string, __kind int")
        rows = rows.join(broadcast_if_small(known), F.col("file") == F.col("__f"))
    wanted = schema.fieldNames()
    picked = None
    for i, found in enumerate(kinds):
        cells = F.from_csv("text", ", ".join([*(f"c{j} string" for j in range(len(found))), "__bad string"]), CSV_OPTIONS)
        one = F.transform(F.array(cells), _by_name(wanted, [found.index(c) for c in wanted]))[0]  # parsed once
        picked = F.when(which == i, one) if picked is None else picked.when(which == i, one)
    raw = rows.select(picked.alias("__cells"), F.col("file").alias("__file"), F.col("start").alias("__start"), F.col("n").alias("__n"))
    cast, wrong = [], [F.when(F.col("__cells")["__bad"], F.lit("number of cells"))]
    for f in schema.fields:
        c = F.col("__cells")[f.name]
        if isinstance(f.dataType, StringType):
            value = c
        elif isinstance(f.dataType, IntegralType):
            whole = c.try_cast("double")
            value = F.coalesce(c.try_cast(f.dataType), F.when(whole == F.floor(whole), whole).try_cast(f.dataType))
        else:
            value = c.try_cast(f.dataType)
        cast.append(value.alias(f.name))
        wrong.append(F.when(c.isNotNull() & value.isNull(), F.lit(f.name)))
    error = F.concat_ws(",", *wrong)
    return raw.select(*cast, F.when(error != "", error).alias("parse_error"), "__file", "__start", "__n")


def scan_dialogues(spark: SparkSession, path: str | list[str], schema: StructType = schemas.DIALOGUE_CSV) -> DataFrame:
    """Dialogues with ``parse_error`` as in ``read_by_name``."""
    return read_by_name(spark, path, schema).drop("__file", "__start", "__n")


def language_paths(base: str, language: str = "korean") -> dict[str, str]:
    """Files of a language: the English ones carry ``_en`` before the suffix."""
    # The file names of the evaluation's inputs.
    mark = "" if language == "korean" else "_en"
    names = {"profiles": "data/patient_profile{}.json", "gold": "data/gold_label{}.csv", "patient_prompt": "prompt/patient_prompt{}.txt",
             "organizer_prompt": "prompt/organizer_prompt{}.txt", "comparer_prompt": "prompt/comparer_prompt{}.txt"}
    same = {"doctor_prompt": "prompt/doctor_prompt.txt", "prediction_prompt": "prompt/disease_prediction_prompt.txt",
            "evaluation_prompt": "prompt/disease_evaluation_prompt.txt"}
    root = base.rstrip("/")
    return {k: f"{root}/{v.format(mark)}" for k, v in names.items()} | {k: f"{root}/{v}" for k, v in same.items()}


def load_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file as one text, exactly as it stands (one small file)."""
    return spark.read.text(path, wholetext=True).first()["value"]


def land(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """Landing step: CSV or JSON files are parsed once; everything after it
    reads the Parquet copy."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels ``(disease, ord, symptom, weight)``; ``ord`` is the
    0-based row position in file order (files in path order)."""
    raw = read_by_name(spark, path, schemas.GOLD_CSV).drop("parse_error")
    numbered = dense_index(raw, [], ["__file", "__start", "__n"], "ord")
    return numbered.select("disease", "ord", "symptom", "weight")


def gold_errors(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a gold file that are not as they should be: ``(disease,
    symptom, weight, error)``."""
    raw = read_by_name(spark, path, schemas.GOLD_CSV)
    # The weights of a label.
    weight = F.when(~F.coalesce(F.col("weight").isin("h", "m"), F.lit(False)), F.lit("weight"))
    empty = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("disease", "symptom")]
    error = F.concat_ws(",", "parse_error", *empty, weight)
    return raw.select("disease", "symptom", "weight", error.alias("error")).where("error <> ''")


def scan_profiles(spark: SparkSession, path: str | list[str], schema: StructType = schemas.PROFILE) -> DataFrame:
    """Profiles from JSON array files (or JSON lines), also where a whole
    array is one line.  Lists and objects in ``simple_info`` come as compact
    JSON text.  An object that is no sound JSON is a row of NULLs."""
    rows, _ = R.records(spark, path, R.JSON)
    return rows.select(F.from_json(F.substr("text", F.locate("{", F.col("text"))), schema).alias("r")).select("r.*")


def run_identity(path_col: Column) -> tuple[Column, Column]:
    """(model, turn) from a run file path; anchored on the last
    ``*_turn_N.csv`` segment (a model name containing ``turn`` is fine)."""
    model = F.regexp_extract(path_col, RUN_FILE_PATTERN, 1)
    turn = F.regexp_extract(path_col, RUN_FILE_PATTERN, 2)
    return (F.when(model != "", model),
            F.when(turn != "", turn.cast("bigint")))


def scan_runs(spark: SparkSession, pattern: str, schema: StructType = schemas.SCORED_CSV) -> DataFrame:
    """All run files matching ``pattern`` as one DataFrame with ``model``
    and ``turn`` columns taken from each file's name, columns by name.  One
    pass finds the headers of all files; the number of jobs does not grow
    with the number of runs."""
    out = read_by_name(spark, pattern, schema)
    model, turn = run_identity(F.col("__file"))
    return out.select(model.alias("model"), turn.alias("turn"), *schema.fieldNames(), "parse_error")
