"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, (offset + k * skip)
modulo the size.  Shards take turns claiming their next free slot until the table is full, so
slot counts differ by one at most, and a change of one shard moves few other slots.  A record's
slot is its key's hash modulo the size.  The table has as many rows as the prime, whatever the
data's size, and is broadcast; no record is shuffled.

A null key is hashed as its own value; equal keys go to one shard (that is the promise of
placement by key), so spread rows of a hot key by adding columns to the key.  Texts of any length are
carried as they are, and not read unless they are the key.  Empty tables give
empty results.  The added columns ``slot`` and ``shard`` replace input columns of those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Slots of the table, a prime well above the number of shards.
SLOTS = 2053
SHARDS = 16


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup(shards: int | list[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot to shard number.  Shards may be named; by default their names are shard-0 and so on."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or not _prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime, and no fewer than the shards")
    offset = [_number(f"{n}/offset") % slots for n in names]
    skip = [_number(f"{n}/skip") % (slots - 1) + 1 for n in names]
    table, step, left = [-1] * slots, [0] * len(names), slots
    while left:
        for i in range(len(names)):
            if not left:
                break
            while table[(offset[i] + step[i] * skip[i]) % slots] >= 0:
                step[i] += 1
            table[(offset[i] + step[i] * skip[i]) % slots] = i
            left -= 1
    return table


def table(spark: SparkSession, shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = list(enumerate(lookup(shards, slots)))
    return spark.createDataFrame(rows, T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False)]))


def assign(df: DataFrame, keys: list[str], shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` added."""
    parts = [F.coalesce(F.concat(F.length(F.col(f"`{k}`").cast("string")).cast("string"), F.lit("|"), F.col(f"`{k}`").cast("string")), F.lit("-")) for k in keys]
    number = F.conv(F.substring(F.md5(F.concat_ws(";", *parts)), 1, 8), 16, 10).cast("long")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    keyed = df.select(*rest, (number % slots).cast("int").alias("slot"))
    return keyed.join(F.broadcast(table(df.sparkSession, shards, slots)), "slot").select(*rest, "slot", "shard")


def write(df: DataFrame, path: str, keys: list[str], shards: int | list[str] = SHARDS, slots: int = SLOTS) -> None:
    """One folder per shard.  Tasks write into every shard's folder, so nothing is shuffled and
    no shard passes through a single task."""
    assign(df, keys, shards, slots).drop("slot").write.partitionBy("shard").mode("overwrite").parquet(path)


#: The claims as SQL: each step, the shard whose turn it is takes its first free slot.
SQL = r"""
shards AS (SELECT i, ('0x' || substr(md5('shard-' || i || '/offset'), 1, 8))::BIGINT % {slots} AS off,
    ('0x' || substr(md5('shard-' || i || '/skip'), 1, 8))::BIGINT % ({slots} - 1) + 1 AS skip FROM range({shards}) r(i)),
claims(step, owner) AS (
  SELECT 0, list_transform(range({slots}), lambda x: -1)
  UNION ALL
  SELECT step + 1, list_concat(list_concat(owner[1:free], [i]), owner[free + 2:]) FROM (
    SELECT step, owner, i, (off + skip * list_filter(range({slots}), lambda k: owner[(off + k * skip) % {slots} + 1] = -1)[1]) % {slots} AS free
    FROM claims JOIN shards ON i = step % {shards} WHERE step < {slots})),
lut AS (SELECT unnest(owner) AS shard, unnest(range({slots})) AS slot FROM claims WHERE step = {slots})
""".format(slots=SLOTS, shards=SHARDS)
SLOT_SQL = f"(('0x' || substr(md5(coalesce(length(doc_id::VARCHAR) || '|' || doc_id::VARCHAR, '-')), 1, 8))::BIGINT % {SLOTS})"
ORACLE = f"WITH RECURSIVE {SQL} SELECT d.doc_id, l.slot::INT AS slot, l.shard::INT AS shard FROM documents d JOIN lut l ON l.slot = {SLOT_SQL}"
