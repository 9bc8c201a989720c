"""Records of quoted CSV files and JSON arrays, read by many tasks per file.

A record may hold line breaks (in quoted cells) or lie anywhere in one long line (a JSON array), so
a byte range alone does not tell where its first record begins.  Two passes do:

1. Survey.  Spark's text source splits the files into byte ranges and, at a separator (line feed for
   CSV, ``}`` for JSON), each range into pieces.  Every range reports how it changes the state: the
   parity of its quotes and, for JSON, the change of nesting depth, for either state in which it may
   begin.  Walking along the ranges of each file then fixes the state in which every one begins: one
   short row per byte range (``spark.sql.files.maxPartitionBytes``) passes the driver.
2. Cut.  Every range is cut into records with its known state.  What it holds of a record that began
   earlier, and of one that goes on behind it, are put together by range, two fragments per
   range at most.

The records are texts; Spark's ``from_csv`` and ``from_json`` parse them.  A lost task repeats its
byte ranges.  A file that ends inside a record gives what there is of it as its last record.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV, JSON = "csv", "json"
# What ends a piece of either kind.
SEPARATOR = {CSV: "\n", JSON: "}"}
_ESCAPED = re.compile(r"\\.", re.S)


def _pieces(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    text = spark.read.option("lineSep", SEPARATOR[kind]).text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, start), pieces) in order; a range's pieces come in several lists."""
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        first = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or starts[i] != starts[first] or files[i] != files[first]:
                yield (files[first], starts[first]), values[first:i]
                first = i


def step(kind: str, piece: str, state: tuple[int, int]) -> tuple[int, int]:
    """The state (inside quotes, depth) behind a piece and its separator."""
    inside, depth = state
    if kind == CSV:
        return inside ^ (piece.count('"') & 1), 0
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    opened = sum(p.count("{") for p in parts[inside::2])
    inside ^= (len(parts) - 1) & 1
    if depth + opened == 0:  # what stands around the array's objects
        return inside, 0
    return inside, depth + opened - (not inside)


def _survey(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """quotes: parity; out, in: change of depth of a range that begins outside or inside quotes;
        head: the first record of a CSV file."""
        now, rows = None, []

        def report() -> pa.RecordBatch:
            names = ["file", "start", "quotes", "out", "in", "head"]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for at, values in _ranges(batches):
            if at != now:
                if len(rows) > 1000:
                    yield report()
                now = at
                rows.append([*at, 0, 0, 0, "" if kind == CSV and at[1] == 0 else None])
                heading = rows[-1][5] is not None
            row = rows[-1]
            for piece in values:
                if kind == CSV:
                    if heading:
                        row[5] += ("\n" if row[2] else "") + piece
                    row[2] ^= piece.count('"') & 1
                    heading = heading and bool(row[2])
                    continue
                parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
                change = (len(parts) - 1) & 1
                for begins in (0, 1):  # the state in which the range began
                    inside = begins ^ row[2]
                    row[3 + begins] += sum(p.count("{") for p in parts[inside::2]) - (not inside ^ change)
                row[2] ^= change
        if rows:
            yield report()

    return run


def _walk(rows: list) -> tuple[dict, dict]:
    """State in which every range begins, and the head of every file."""
    states, heads, file = {}, {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth = r["file"], 0, 0
        states[file, r["start"]] = (inside, depth)
        if r["head"] is not None:
            heads[file] = r["head"]
        depth += r["in"] if inside else r["out"]
        inside ^= r["quotes"]
    return states, heads


def _cut(kind: str, known):
    whole, lead, tail = "whole", "lead", "tail"
    sep = SEPARATOR[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = known.value
        now, state, held, part, n = None, (0, 0), [], whole, 0
        out: list[tuple] = []

        def put(what: str) -> None:
            nonlocal n, held
            if held:
                text = (sep if kind == CSV else "").join(held)
                out.append((*now, n, what, text))
                n += 1
            held = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["file", "start", "n", "part", "text"])
            out.clear()
            return batch

        for at, values in _ranges(batches):
            if at != now:
                if held:
                    put(lead if part == lead else tail)
                now, state, n = at, states[at], 0
                part = lead if any(state) else whole
            for piece in values:
                after = step(kind, piece, state)
                if kind == CSV or any(state) or any(after) or "{" in piece:  # not what stands around objects
                    held.append(piece if kind == CSV else piece + sep)
                    if not any(after):
                        put(part)
                        part = whole
                state = after
            yield flush()
        if held:
            put(lead if part == lead else tail)
        yield flush()

    return run


def records(spark: SparkSession, paths: str | list[str], kind: str) -> tuple[DataFrame, dict[str, str]]:
    """(file, start, n, text) of every record, in file order by (start, n), and for CSV the first
    record of every file, which is not among them."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    pieces = _pieces(spark, paths, kind)
    found = pieces.mapInArrow(_survey(kind), "file string, start bigint, quotes int, out bigint, in bigint, head string").collect()  # a row for each byte range
    states, heads = _walk(found)
    cut = pieces.mapInArrow(_cut(kind, spark.sparkContext.broadcast(states)), "file string, start bigint, n bigint, part string, text string")
    bits = cut.where("part <> 'whole'")
    # a tail opens a group that the leads behind it go on with: two rows per range at most
    order = Window.partitionBy("file").orderBy("start", "n")
    bits = bits.withColumn("g", F.sum((F.col("part") == "tail").cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("start", "n", "text")))
    joined = bits.groupBy("file", "g").agg(listed.alias("bits"))
    joined = joined.select("file", F.col("bits")[0]["start"].alias("start"), F.col("bits")[0]["n"].alias("n"),
                           F.array_join(F.transform("bits", lambda b: b["text"]), SEPARATOR[kind] if kind == CSV else "").alias("text"))
    out = cut.where("part = 'whole'").select("file", "start", "n", "text").unionByName(joined)
    if kind == CSV:
        out = out.where("NOT (start = 0 AND n = 0)").withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text <> ''")
    return out, heads


def names(head: str) -> list[str]:
    """The column names of a CSV file's first record."""
    return next(csv.reader([head.removeprefix("﻿").removesuffix("\r")]), [])
