"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one bit per
failed rule.  A policy is a versioned mask: a document fails it when it fails any rule of the
mask.  ``apply_policies`` and ``ablate`` work on the stored bits alone; no text is read again.

Nulls and empty texts have no words (all measurements 0, ``too_few_words`` set); texts of any
length are handled whole; repeated rows stay rows of their own; other columns of the input are
carried through unless they clash with a name of the ledger, which then wins.  An empty table gives
an empty ledger.

``quality_ledger`` stores the ledger as a table and answers from it; ``passing``, which hands on the
texts, takes its verdicts in the one pass in which it reads them, as storing the bits there would
cost a join of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, staging_path, text_batches
from .words import windows, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measured for rules alone: lines with a word, words equal to the one before.
OTHERS = ["n_lines", "n_stutter"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: Rule: (bit, SQL condition of failure over the measurements).
RULES = {
    "too_few_words": (0, "n_words < 20"),
    "repeated_words": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbol_noise": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "n_dup_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    "word_length": (4, "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "too_many_words": (5, "n_words > 1000000"),
    "stutter": (6, "n_words >= 20 and 10 * n_stutter > 3 * n_words"),
}
#: Policy version: the rules that reject a document.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbol_noise", "repeated_lines", "word_length"),
    "v2": ("too_few_words", "repeated_words", "symbol_noise", "repeated_lines", "word_length", "stutter"),
    "v3": ("too_few_words", "repeated_words", "symbol_noise", "repeated_lines", "word_length", "stutter", "too_many_words"),
}
CURRENT = "v2"


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULES[r][0] for r in names)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of a batch of texts."""
    w = words(texts)
    n = len(w.hash)
    text_of = np.repeat(np.arange(len(texts)), w.count)
    # code points: bytes that are no UTF-8 continuation
    points = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((w.buf & 0xC0) != 0x80, out=points[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(symbol[w.buf], out=symbols[1:])
    h, whole = windows(w, WINDOW)
    at = np.flatnonzero(whole)
    order = at[np.lexsort((h[at], text_of[at]))]
    same = np.zeros(len(order) + 1, bool)
    if len(order):
        same[1:-1] = (h[order[1:]] == h[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    repeat = order[same[1:] | same[:-1]]
    cover = np.zeros(n + WINDOW, np.int64)
    np.add.at(cover, repeat, 1)
    np.add.at(cover, repeat + WINDOW, -1)
    covered = np.cumsum(cover)[:n] > 0
    again = np.zeros(n, bool)  # words equal to the one before
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (text_of[1:] == text_of[:-1])
    dup_lines, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            kept = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines[i], dup_lines[i] = len(kept), len(kept) - len(set(kept))
        else:
            lines[i] = w.count[i] > 0
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": np.bincount(text_of, points[w.end] - points[w.start], len(texts)).astype(np.int64),
        "n_symbols": symbols[w.base[1:]] - symbols[w.base[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(text_of, covered, len(texts)).astype(np.int64),
        "n_lines": lines,
        "n_stutter": np.bincount(text_of, again, len(texts)).astype(np.int64),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, "__text"):
        found = measure(texts)
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(v) for v in found.values()], keep + list(found))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: all), the measurements and
    ``failed``, the bitmask of failed rules."""
    prepare(docs.sparkSession)
    own = [*MEASURES, *OTHERS, "failed"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{m} bigint" for m in [*MEASURES, *OTHERS]])
    bits = [F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, cond in RULES.values()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return source.mapInArrow(_measured, fields).withColumn("failed", failed)


def apply_policies(rows: DataFrame, policies: tuple[str, ...] = (CURRENT,)) -> DataFrame:
    """Adds ``kept_<policy>`` for each named policy from the stored bits."""
    return rows.withColumns({f"kept_{p}": F.col("failed").bitwiseAND(F.lit(mask(p))) == 0 for p in policies})


def ablate(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (they would come back
    if the rule were left out), and the union and the common part of all their failure bits."""
    m = mask(policy)
    seen = F.col("failed").bitwiseAND(F.lit(m))
    per_mask = rows.groupBy(seen.alias("bits")).agg(F.count("*").alias("n"))  # at most 2**rules rows
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy]])
    rule = per_mask.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rule.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.bit_or(F.when(hit, F.col("bits"))).alias("any_bits"),
        F.bit_and(F.when(hit, F.col("bits"))).alias("all_bits"),
    )


def passing(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns, also those whose names
    clash with the ledger's."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = apply_policies(ledger(docs.toDF(*own), own[docs.columns.index(text)]), (policy,))
    return rows.where(F.col(f"kept_{policy}")).select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns)])


def stored(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder, without the texts."""
    path = staging_path(docs.sparkSession, "ledger")
    ledger(docs, text, keep).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def quality_ledger(docs: DataFrame) -> DataFrame:
    """The contract's row per document: measurements, base verdict and the current policy's.  For the
    ablation of that policy, only_rule is the rule that alone rejects the document (null if none
    does), and alike the number of documents with the same failures of its rules."""
    rows = apply_policies(stored(docs, ["doc_id"]), ("base", CURRENT))
    rows = rows.withColumn("bits", F.col("failed").bitwiseAND(F.lit(mask(CURRENT))))
    alike = rows.groupBy(F.col("bits").alias("b")).agg(F.count("*").alias("alike"))  # at most 2**rules rows
    rows = rows.join(F.broadcast(alike), F.col("bits") == F.col("b"))
    only = F.coalesce(*[F.when(F.col("bits") == 1 << RULES[r][0], F.lit(r)) for r in POLICIES[CURRENT]])
    return rows.select("doc_id", *MEASURES, (~F.col("kept_base")).alias("base_failed"), F.col(f"kept_{CURRENT}").alias("kept"), "failed", only.alias("only_rule"), "alike")


_WORD = r"'[^\x20\x09-\x0D]+'"

#: DuckDB SQL for the rows of quality_ledger over documents.
MEASURE_SQL = rf"""
  SELECT doc_id, length(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (length(ls) - length(list_distinct(ls)))::BIGINT AS n_dup_lines,
    length(ls)::BIGINT AS n_lines, ws, rid,
    length(list_filter(range(2, length(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutter
  FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
      regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls
    FROM {{docs}})"""
ORACLE = rf"""
WITH m AS ({MEASURE_SQL.format(docs="documents")}),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(length(ws) - 6, 1)::BIGINT)) AS i FROM m)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
r AS (SELECT m.doc_id, m.n_words::BIGINT AS n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_lines, m.n_stutter,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
  + (CASE WHEN n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN n_words > 1000000 THEN 32 ELSE 0 END)
  + (CASE WHEN n_words >= 20 AND 10 * n_stutter > 3 * n_words THEN 64 ELSE 0 END) AS b FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (b & 3) <> 0 AS base_failed, (b & 95) = 0 AS kept, b::BIGINT AS failed,
  CASE b & 95 WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbol_noise' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'word_length' WHEN 64 THEN 'stutter' END AS only_rule,
  count(*) OVER (PARTITION BY b & 95) AS alike FROM f"""
