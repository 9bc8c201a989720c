"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source's documents, in a fixed shuffled order, form a stream of words that repeats; the
stream is cut into blocks of ``BLOCK`` words.  The schedule has one slot per block that the mix
takes.  Slot j's van der Corput point (the bits of j reversed) falls into one source's part of
the cumulative weights; the slot's rank within that source names the block it takes.

A source's parts of the first K points differ from its share by at most about log2(K) / 3 + 1
slots.  The few surplus slots of some sources are handed to the sources that are short of as
many, in slot order, so every source gets exactly its blocks; the last block of a source is cut
where its target ends.  Hence each source's taken words are its target, rounded down.

No window runs over a whole source: streams are numbered by (source, hash bucket) and slots by
(source, chunk of slots), and only the per-bucket totals are summed along a source.

Null and empty texts have size 0 and are never taken.  A null source is a source of its own, the
last one.  Repeated rows are rows of their own.  Null ids are allowed; order in the stream comes
from a hash of id and text.  Texts of any length are counted whole.  An empty table gives an empty mix.  Other columns of the input, clashing
names included, are not carried by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import prepare

#: Words of a block.
BLOCK = 128
#: Slots of a chunk in which ranks are counted.
CHUNK = 1 << 16
#: Cells of the cumulative weights in which a point looks up its source.
CELLS = 4096
#: A source gives at most this many times its words.
REPEATS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to target words: weights 1, 2, 3, repeating by code point (null
    last) share the total; a target stops at ``repeats`` times its source's size and the excess
    is shared by weight among the others until none is above.

    The level of that water-filling is found in one pass over the sources in the order of
    cap / weight: the first k sources are capped if the level over the others is above the cap of
    the k-th."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * repeats)
    every = W.partitionBy()
    up_to = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    w = (w.withColumn("total", F.sum("source_size").over(every))
         .withColumn("before", F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
         .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
         .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("rest"))
         .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap")))
    # the level that counts is that of the first source that isn't capped
    w = w.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("before"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def streams(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Every row with size, ``start`` (the words before it in its source's shuffled stream),
    ``row`` (its number in its bucket) and its source's columns; and the sources, numbered, with
    size and target.  Texts are read once: what is kept of a row is narrow and checkpointed."""
    prepare(docs.sparkSession)
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("m_source"), size_of(F.col(f"`{text}`")).alias("size"), order.alias("m_at"))
    rows = rows.checkpoint().withColumn("m_bucket", F.substring("m_at", 1, 3))
    sums = rows.groupBy("m_source", "m_bucket").agg(F.sum("size").alias("words")).checkpoint()
    targets = source_targets(sums.groupBy(F.col("m_source").alias("source")).agg(F.sum("words").alias("source_size")))
    targets = targets.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).checkpoint()
    before = W.partitionBy("m_source").orderBy("m_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = sums.alias("s").join(targets.alias("t"), F.expr("s.m_source <=> t.source"))
    plan = plan.select(F.col("m_source").alias("p_source"), F.col("m_bucket").alias("p_bucket"), "before", "source_no", "source_size", "target")
    inside = W.partitionBy("m_source", "m_bucket").orderBy("m_at", "size", F.xxhash64(*keep))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("row", F.row_number().over(inside))
    rows = rows.join(plan, F.expr("m_source <=> p_source AND m_bucket = p_bucket"))
    return rows.withColumn("start", F.col("start") + F.col("before")).drop("p_source", "p_bucket", "m_source", "before", "m_at"), targets


def _ranked(slots: DataFrame) -> DataFrame:
    """Adds ``rank``, the number of earlier slots of the same source."""
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("source_no", "chunk").orderBy("slot")
    slots = slots.withColumn("own", F.row_number().over(inside) - 1)
    return slots.join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("own") + F.col("before")).alias("rank"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, block): which source a slot takes from, and the block of its repeating
    stream.  ``targets`` has source_no, target per source."""
    spark = targets.sparkSession
    need = targets.select("source_no", F.ceil(F.floor("target") / block).alias("need")).where("need > 0")
    total = need.agg(F.sum("need")).first()[0] or 0  # one number
    bits = max(1, math.ceil(math.log2(max(2, total))))
    cum = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)
    span = need.withColumn("hi", F.sum("need").over(cum) / F.lit(float(max(1, total)))).withColumn("lo", F.col("hi") - F.col("need") / F.lit(float(max(1, total))))
    last = F.max("source_no").over(W.partitionBy())
    span = span.withColumn("hi", F.when(F.col("source_no") == last, 1.0).otherwise(F.col("hi")))
    prev = F.coalesce(F.lag("hi").over(W.orderBy("source_no")), F.lit(0.0))
    span = span.withColumn("lo", prev)
    cells = span.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / float(1 << bits)
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    slots = slots.join(cells.select("cell", "source_no", "lo", "hi"), "cell").where("point >= lo AND point < hi").select("slot", "source_no")
    ranked = _ranked(slots).join(need, "source_no")
    fit = ranked.where("rank < need").select("slot", "source_no", F.col("rank").alias("block"))
    surplus = ranked.where("rank >= need").select("slot", F.row_number().over(W.orderBy("slot")).alias("k"))
    got = fit.groupBy("source_no").agg(F.count("*").alias("got"))
    short = need.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    short = short.select("source_no", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("block"))
    short = short.withColumn("k", F.row_number().over(W.orderBy("source_no", "block")))
    return fit.unionByName(surplus.join(short, "k").select("slot", "source_no", "block"))


def _blocks(docs: DataFrame, keep: list[str], text: str, source: str, block: int) -> DataFrame:
    """For every row, copy of it in the repeating stream (``epoch``; null if none is reached) and block
    that the copy touches: the words there, and the slot that takes them."""
    rows, targets = streams(docs, keep, text, source)
    slots = schedule(targets.select("source_no", "target"), block)
    # copies of a document in the repeating stream, then the blocks that each copy touches
    end = F.floor("target")
    size, whole = F.col("size"), F.col("source_size")
    epochs = F.when((size > 0) & (F.col("start") < end), F.sequence(F.lit(0).cast("long"), F.floor((end - 1 - F.col("start")) / whole)))
    copies = rows.withColumn("epoch", F.explode_outer(epochs))
    copies = copies.withColumn("from", F.col("start") + F.col("epoch") * whole)
    copies = copies.withColumn("to", F.least(F.col("from") + size, end))
    parts = copies.withColumn("block", F.explode_outer(F.when(F.col("epoch").isNotNull(), F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))))
    words = F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)
    return parts.withColumn("words", words).join(slots, ["source_no", "block"], "left")


_ROW = ["size", "source_size", "target", "source_no", "m_bucket", "row"]


def _taken() -> Column:
    return F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("taken")


def mix(docs: DataFrame, keep: list[str] | None = None, text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """Every row of ``docs``: the columns ``keep`` (default doc_id), size, source_size, target, taken
    (the words that the scheduled blocks take from it, repeats counted) and first_slot (the
    first slot that takes from it; null if none does)."""
    keep = ["doc_id"] if keep is None else keep
    joined = _blocks(docs, keep, text, source, block).groupBy(*keep, *_ROW).agg(_taken(), F.min("slot").alias("first_slot"))
    return joined.select(*keep, "size", "source_size", "target", "taken", "first_slot")


def copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(__key, slot): the whole copies of ``docs`` that make the mix, each with the first slot that takes
    from it.  ``docs`` has a column ``__key``.  Only the last copy that a source's target reaches can be
    taken in part; it stays if at least half of it is, which comes nearest to the target.  The first
    document of a source's stream always stays, so no source with a target is left empty."""
    parts = _blocks(docs, ["__key"], "text", "source", block).where("epoch IS NOT NULL")
    per = parts.groupBy("__key", *_ROW, "start", "epoch").agg(_taken(), F.min("slot").alias("slot"))
    return per.where((2 * F.col("taken") >= F.col("size")) | ((F.col("start") == 0) & (F.col("epoch") == 0))).select("__key", "slot")


def repeat(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` mixed: a row for every copy that ``copies`` tells, in the order of the schedule over the
    partitions of the result, so that any stretch of it holds the sources in about their shares.
    Rows equal in id and text count as one row of all their words.  Texts without words are never
    taken.  Other columns stay, whatever their names."""
    key = "__mix_key"
    rows = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias(key), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = copies(rows.select(F.col(key).alias("__key"), *[F.col("__row")[c].alias(c) for c in ("doc_id", "text", "source")]), block)
    out = rows.dropDuplicates([key]).join(found, F.col(key) == F.col("__key"))
    out = out.repartitionByRange("slot", "__key").sortWithinPartitions("slot", "__key")
    return out.select("__row.*")


#: DuckDB SQL of the rows of mix over a table of documents.  ``m``: taken words by the closed form of
#: the schedule, the first floor(target) words of each source's repeating stream.  ``SLOTS``: the
#: schedule itself and the first slot of every document.
SQL = r"""
WITH RECURSIVE d AS (SELECT {keep}, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS pos FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
fill(round, source, source_size, weight, capped, level) AS (
  SELECT 0, source, source_size, weight, FALSE, sum(source_size) OVER () / (sum(weight) OVER ())::DOUBLE FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, c,
    ((sum(source_size) OVER ()) - coalesce(sum(CASE WHEN c THEN 3 * source_size END) OVER (), 0)) / nullif(sum(CASE WHEN NOT c THEN weight END) OVER (), 0)::DOUBLE
  FROM (SELECT *, capped OR level * weight > 3 * source_size AS c, bool_or(NOT capped AND level * weight > 3 * source_size) OVER () AS again FROM fill) WHERE again),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE level * weight END::DOUBLE AS target FROM fill WHERE round = (SELECT max(round) FROM fill)),
p AS (SELECT d.*, row_number() OVER () AS rid, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY pos, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT rid, {keep}, size::BIGINT AS size, source_size, target,
  (greatest(least(start + size, floor(target)) - start, 0) + greatest(least(start + size + source_size, floor(target)) - start - source_size, 0)
   + greatest(least(start + size + 2 * source_size, floor(target)) - start - 2 * source_size, 0))::BIGINT AS taken FROM p)
"""
SLOTS = f""",
need AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS no, ceil(floor(target) / {BLOCK})::BIGINT AS need FROM t),
wanted AS (SELECT *, sum(need) OVER (ORDER BY no) AS upto, sum(need) OVER () AS total FROM need WHERE need > 0),
span AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY no), 0) AS lo FROM (SELECT *, CASE WHEN no = max(no) OVER () THEN 1 ELSE upto / total::DOUBLE END AS hi FROM wanted)),
bits AS (SELECT greatest(1, ceil(log2(greatest(2, max(total)))))::INT AS b, max(total)::BIGINT AS total FROM wanted),
points AS (SELECT slot, list_sum(list_transform(range(b), lambda i: ((slot >> i) & 1) << (b - 1 - i))) / (1::BIGINT << b)::DOUBLE AS point
  FROM (SELECT unnest(range(total)) AS slot, b FROM bits)),
falls AS (SELECT slot, no, need, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS r FROM points JOIN span ON point >= lo AND point < hi),
late AS (SELECT slot, row_number() OVER (ORDER BY slot) AS k FROM falls WHERE r >= need),
short AS (SELECT no, block, row_number() OVER (ORDER BY no, block) AS k
  FROM (SELECT no, unnest(range(got, need)) AS block FROM (SELECT w.no, w.need, count(f.slot) AS got FROM wanted w LEFT JOIN falls f ON f.no = w.no AND f.r < f.need GROUP BY ALL) WHERE got < need)),
plan AS (SELECT slot, no, r AS block FROM falls WHERE r < need UNION ALL SELECT slot, no, block FROM late JOIN short USING (k)),
copy AS (SELECT rid, no, start + e * source_size AS a, least(start + e * source_size + size, floor(target)::BIGINT) AS z
  FROM (SELECT p.*, no, unnest(range(3)) AS e FROM p JOIN need ON p.source IS NOT DISTINCT FROM need.source) WHERE size > 0),
touched AS (SELECT rid, no, unnest(range((a // {BLOCK})::BIGINT, ((z - 1) // {BLOCK})::BIGINT + 1)) AS block FROM copy WHERE a < z),
first AS (SELECT rid, min(slot) AS first_slot FROM touched JOIN plan USING (no, block) GROUP BY rid)
"""
ORACLE = SQL.format(keep="doc_id", docs="documents") + SLOTS + "SELECT doc_id, size, source_size, target, taken, first_slot FROM m LEFT JOIN first USING (rid)"
