"""Gold-label tables: per-disease list text, first weight per label, the
1:N dialogue-to-labels join and the label cover relation used by scoring.

All inputs are gold tables ``(disease, ord, symptom, weight)``; ``ord`` is
the file order numbered at ingest.  These tables are bounded by the size
of the label file, never by the number of dialogues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip

# Fixed value: label written for an answer that is not in the list.
NOT_IN_GOLD = "Not in Gold Label"


def gold_list_text(gold: DataFrame) -> DataFrame:
    """``(disease, gold_list)``: ``-symptom`` lines in file order, stripped
    (the text the comparer sees and the containment test runs against)."""
    return gold.groupBy("disease").agg(
        strip(F.expr("listagg(concat('-', symptom), '\n') WITHIN GROUP (ORDER BY ord)")).alias("gold_list"))


def label_weight(gold: DataFrame) -> DataFrame:
    """``(disease, symptom, weight)``: weight of the first row (by ``ord``)
    of each label; later duplicates are ignored."""
    return gold.groupBy("disease", "symptom").agg(F.min_by("weight", "ord").alias("weight"))


#: Parts that the dialogues of a disease are dealt to, and tasks of a join by disease.
SALTS, TASKS = 32, 512


def deal_by_disease(dialogues: DataFrame, labels: DataFrame, disease_col: str = "disease") -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by disease, whose result is far larger than its
    input: dialogues dealt to ``SALTS`` parts of their disease, ``labels``
    (``__gd`` is the disease) copied to each part.  The number of tasks is
    given, as AQE sizes tasks by their input; a task holds the rows of a few
    diseases, each together, so that what they repeat is stored once per file.
    A label file is small, often one task, so it is dealt before it is copied."""
    plain = [F.col(f.name) for f in dialogues.schema.fields if "map<" not in f.dataType.simpleString()]
    d = dialogues.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    g = labels.repartition(SALTS, *[c for c, kind in labels.dtypes if "map<" not in kind]).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.repartition(TASKS, disease_col, "__salt"), g.repartition(TASKS, "__gd", "__salt")


def join_gold(dialogues: DataFrame, gold: DataFrame, disease_col: str = "disease") -> DataFrame:
    """Each dialogue with every label of its disease (1:N, left: an unknown
    disease keeps its row with NULL label columns).

    The result has dialogues times labels rows.  A merge join holds the
    dialogues of one part and streams the labels, so a label's columns come in
    runs and the dialogues in a short cycle, which files store in few bytes."""
    g = gold.withColumnRenamed("disease", "__gd")
    shown = [*dialogues.columns, *[c for c in gold.columns if c != "disease"]]
    d, many = deal_by_disease(dialogues, g, disease_col)
    same = F.col(disease_col) == F.col("__gd")
    found = many.withColumnRenamed("__salt", "__gs").hint("merge").join(d, same & (F.col("__salt") == F.col("__gs"))).select(*shown)
    alone = dialogues.join(g.select("__gd").distinct(), same, "left_anti")
    kinds = {f.name: f.dataType for f in gold.schema.fields}
    return found.unionByName(alone.select(*dialogues.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in shown[len(dialogues.columns):]]))


def dialogue_lists(dialogues: DataFrame, gold: DataFrame, disease_col: str = "disease") -> DataFrame:
    """Each dialogue with the ``gold_list`` of its disease (NULL for an
    unknown one), the rows of a disease together."""
    d, gl = deal_by_disease(dialogues, gold_list_text(gold).withColumnRenamed("disease", "__gd"), disease_col)
    gl = gl.withColumnRenamed("__salt", "__gs").hint("merge")
    j = d.join(gl, (F.col(disease_col) == F.col("__gd")) & (F.col("__salt") == F.col("__gs")), "left")
    return j.drop("__gd", "__gs", "__salt")


def label_cover(gold: DataFrame) -> DataFrame:
    """``(disease, symptom, cover)``: trace labels whose trace entry
    ``- <cover>\\n`` contains ``symptom`` (cover ranges over the disease's
    labels plus the not-in-list label).

    The trace text is the sequence of these entries, so the substring "seen
    before" test becomes an equi-join on this small table.  A symptom that
    holds a line break and a dash behind it may also be found across entries;
    ``label_runs`` has these."""
    syms = gold.select("disease", "symptom").distinct()
    covers = syms.select("disease", F.col("symptom").alias("cover")).unionByName(
        syms.select("disease").distinct().withColumn("cover", F.lit(NOT_IN_GOLD)))
    pairs = syms.join(covers, "disease")
    return pairs.where(F.concat(F.lit("- "), F.col("cover"), F.lit("\n")).contains(F.col("symptom")))


def crossing_labels(gold: DataFrame) -> DataFrame:
    """The labels that can be found across several entries of a trace."""
    return gold.where(F.col("symptom").contains("\n-"))


def runs_of(labels: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    """(label, run): the sequences of two or more trace entries, by their labels, that hold a label
    across their borders, for the labels of one disease.

    A label is matched entry by entry: the first one ends with its beginning, those in between are
    the next part of it, whole, and the last one begins with the rest."""
    entries = {x: f"- {x}\n" for x in [*dict.fromkeys(labels), NOT_IN_GOLD]}
    out = []
    for label in dict.fromkeys(x for x in labels if "\n-" in x):
        ends = [i + 1 for i, c in enumerate(label[:-1]) if c == "\n"]
        open_ = [(p, (x,)) for p in ends for x, t in entries.items() if t.endswith(label[:p])]
        while open_:
            at, run = open_.pop()
            for x, t in entries.items():
                if t.startswith(label[at:]):
                    out.append((label, (*run, x)))
                elif label[at:].startswith(t):
                    open_.append((at + len(t), (*run, x)))
    return list(dict.fromkeys(out))


def label_runs(gold: DataFrame) -> DataFrame:
    """``(disease, symptom, run)``: consecutive trace labels across whose
    entries ``symptom`` is found.  Bounded by the label file: only diseases
    with such a label are looked at, each one's labels together."""
    def find(frame):
        import pandas as pd
        found = runs_of(frame.sort_values("ord")["symptom"].tolist())
        return pd.DataFrame({"disease": frame["disease"].iloc[0], "symptom": [s for s, _ in found], "run": [list(r) for _, r in found]})

    some = gold.join(crossing_labels(gold).select("disease").distinct(), "disease", "left_semi").where("symptom IS NOT NULL")
    some = some.groupBy("disease", "symptom").agg(F.min("ord").alias("ord"))
    return some.groupBy("disease").applyInPandas(find, "disease string, symptom string, run array<string>")


def first_rows(df: DataFrame, keys: list[str], order_col: str, value_cols: list[str]) -> DataFrame:
    """First row per key by ``order_col`` as a partial aggregation, without
    a window.  With several value columns Spark aggregates by sorting."""
    if len(value_cols) == 1:  # plain values keep the aggregate hash-based
        return df.groupBy(*keys).agg(F.min_by(value_cols[0], F.col(order_col)).alias(value_cols[0]), F.count(F.lit(1)).alias("n_rows"))
    packed = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(*keys).agg(F.min_by(packed, F.col(order_col)).alias("__first"),
                                F.count(F.lit(1)).alias("n_rows"))
    return agg.select(*keys, *[F.col("__first")[c].alias(c) for c in value_cols], "n_rows")
