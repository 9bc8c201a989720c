"""Exact duplicates by a cuckoo-filter index that takes insertions and deletions.

Texts are equal when they are so after the characters 0x20 and 0x09-0x0D are deleted.  Their
SHA-256 and digest (its first 8 bytes) stand for them; texts never cross the network.

The index is a folder of tables:

- ``rows``: id, hash and code points of every live row, spread as they came;
- ``state``: the index proper, dealt by hash into parts of about ``PART_KEYS`` distinct texts.  A
  part has a cuckoo filter (buckets of four 16-bit fingerprints, two buckets for a digest) over
  its live digests, and its bucketed content: for each digest the full hashes that have it, with
  their number of rows and the row that stays;
- ``manifest``: what each version consists of.  A version counts once its line is there.

An insertion first combines equal texts within each task, so a text that a third of all rows hold
arrives as one line per task.  A part's task then takes the lines one by one: if the filter
does not know the digest, the text is new; a hit is verified against the content under the digest,
and either adds to the text found there or, for a false hit, is a new text too.  When no bucket
has room for a fingerprint after ``KICKS`` moves, the filter is doubled and filled anew from the
part's stored keys.  A deletion looks its texts up in the same way, takes its rows off, and
removes the digest from the filter with the last text that has it.  When parts have become twice
as large as they should, the index is dealt into more of them.

An update reads and writes the narrow state (about 100 bytes per distinct text); a task holds a
part, or one batch of lines.  Versions are written whole before they count, from stored rows
alone, so lost tasks are just repeated.

Null texts are empty ones, and all empty texts equal.  Of equal texts the row with the most code
points in the original text stays, then the one with the least id (null last), then any one:
repeated rows are rows of their own, of which exactly one stays.  Texts of any length are hashed
whole.  Empty tables give empty results.  Other columns, clashing names included, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import prepare

#: Fixed value: the characters that do not count.
SPACE = " \t\n\v\f\r"
#: Distinct texts that a part holds on average (some 20 MB in its task), twice as many at most.
PART_KEYS = 1 << 16
#: Distinct texts that a task combines before it hands them on.
COMBINE = 1 << 17
SLOTS = 4
KICKS = 200
LEAST_BITS = 6


class Filter:
    """Cuckoo filter over 64-bit digests; ``bits``: log2 of its buckets.  An empty slot is 0."""

    def __init__(self, bits: int = LEAST_BITS, slots: bytes | None = None):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.slots = memoryview(bytearray(slots or bytes(SLOTS << bits << 1))).cast("H")

    def _places(self, digest: int) -> tuple[int, int]:
        mark = (digest >> 48) or 1
        return mark, ((digest * 0x9E3779B97F4A7C15) >> 24) & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & self.mask)

    def _find(self, bucket: int, mark: int) -> int:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[at] == mark:
                return at
        return -1

    def __contains__(self, digest: int) -> bool:
        mark, one = self._places(digest)
        return self._find(one, mark) >= 0 or self._find(self._other(one, mark), mark) >= 0

    def add(self, digest: int) -> bool:
        """False if there was no room; a fingerprint is lost then, so the filter must be filled anew."""
        mark, one = self._places(digest)
        for bucket in (one, self._other(one, mark)):
            if (at := self._find(bucket, 0)) >= 0:
                self.slots[at] = mark
                return True
        for kick in range(KICKS):
            at = bucket * SLOTS + kick * 7 % 11 % SLOTS
            mark, self.slots[at] = self.slots[at], mark
            bucket = self._other(bucket, mark)
            if (at := self._find(bucket, 0)) >= 0:
                self.slots[at] = mark
                return True
        return False

    def remove(self, digest: int) -> None:
        """Takes one fingerprint of a digest off that is in the filter."""
        mark, one = self._places(digest)
        at = self._find(one, mark)
        self.slots[at if at >= 0 else self._find(self._other(one, mark), mark)] = 0


class Part:
    """One part of the index: the filter, and the content by digest: [hash, rows, best row] lists."""

    def __init__(self, digest_bytes: int = 8):
        self.size = digest_bytes
        self.filter: Filter | None = None
        self.content: dict[int, list[list]] = {}
        self.resized = self.false_hits = 0

    def digest(self, sha: bytes) -> int:
        return int.from_bytes(sha[: self.size], "big") << (64 - 8 * self.size)

    def fill(self, bits: int) -> None:
        """A filter of at least ``bits`` from the stored keys."""
        while True:
            self.filter = Filter(bits)
            if all(map(self.filter.add, self.content)):
                return
            bits += 1

    def _found(self, digest: int, sha: bytes) -> list | None:
        """The text's entry: only a digest that the filter knows is looked for in the content."""
        if digest not in self.filter:
            return None
        for entry in self.content.get(digest, ()):
            if entry[0] == sha:
                return entry
        self.false_hits += 1
        return None

    def insert(self, sha: bytes, n: int, best: tuple) -> None:
        digest = self.digest(sha)
        if entry := self._found(digest, sha):
            entry[1] += n
            entry[2] = min(entry[2], best, key=rank)
        elif digest in self.content:  # another text with this digest
            self.content[digest].append([sha, n, best])
        else:
            self.content[digest] = [[sha, n, best]]
            if not self.filter.add(digest):
                self.resized += 1
                self.fill(self.filter.bits + 1)

    def delete(self, sha: bytes, n: int, best: tuple) -> None:
        """Takes n rows off; ``best`` is the best of those that are left."""
        digest = self.digest(sha)
        if entry := self._found(digest, sha):
            entry[1] -= n
            entry[2] = best
            if entry[1] <= 0:
                self.content[digest].remove(entry)
                if not self.content[digest]:
                    del self.content[digest]
                    self.filter.remove(digest)


def rank(best: tuple) -> tuple:
    """(code points, id, version, row) in the order of staying: the least stays."""
    points, doc_id, version, row = best
    return -points, doc_id is None, doc_id if doc_id is not None else 0, version, row


_BEST = ["points", "doc_id", "version", "row"]
_STATE = ["part", "kind", "sha", "n", *_BEST, "bits", "slots"]
#: Kinds of lines of a part, in the order in which its task needs them.
_FILTER, _KEY, _PUT, _TAKE = range(4)


class Index:
    """The index in folder ``path``, which all executors reach; opened at its last version, or new.
    ``digest_bytes`` (8 at most) and ``part_keys`` are of the folder's first version."""

    def __init__(self, spark: SparkSession, path: str, kind: T.DataType | None = None, digest_bytes: int = 8, part_keys: int = PART_KEYS):
        prepare(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.digest_bytes, self.part_keys = digest_bytes, part_keys
        self.version, self.parts, self.rows_at, self.state_at = 0, 0, [], None
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            last = spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
            self.version, self.parts, self.rows_at, self.state_at = last["version"], last["parts"], list(last["rows"]), last["state"]
            self.digest_bytes, self.part_keys = last["digest_bytes"], last["part_keys"]
            kind = self.rows().schema["doc_id"].dataType
        self.kind = kind or T.LongType()

    # -- tables -----------------------------------------------------------------------------

    @property
    def _lines(self) -> T.StructType:
        of = {"part": T.LongType(), "kind": T.IntegerType(), "sha": T.BinaryType(), "n": T.LongType(), "points": T.LongType(), "doc_id": self.kind,
              "version": T.IntegerType(), "row": T.LongType(), "bits": T.IntegerType(), "slots": T.BinaryType()}
        return T.StructType([T.StructField(c, of[c]) for c in _STATE])

    def rows(self) -> DataFrame:
        """Live rows: doc_id, sha, points, version, row."""
        fields = [T.StructField("doc_id", getattr(self, "kind", T.LongType())), T.StructField("sha", T.BinaryType()), T.StructField("points", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("row", T.LongType())]
        return self.spark.read.parquet(*self.rows_at) if self.rows_at else self.spark.createDataFrame([], T.StructType(fields))

    def state(self) -> DataFrame:
        return self.spark.read.parquet(self.state_at) if self.state_at else self.spark.createDataFrame([], self._lines)

    def keys(self) -> DataFrame:
        """Live texts: sha, n (rows), and the row that stays: keep_id, keep_version, keep_row."""
        return self.state().where(F.col("kind") == _KEY).select("sha", "n", F.col("doc_id").alias("keep_id"), F.col("version").alias("keep_version"), F.col("row").alias("keep_row"))

    def _hashed(self, docs: DataFrame, text: str) -> DataFrame:
        whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        return docs.select(F.col("doc_id").cast(self.kind), F.unhex(F.sha2(F.translate(whole, SPACE, ""), 256)).alias("sha"), F.length(whole).cast("long").alias("points"))

    def _part(self, parts: int):
        return F.pmod(F.xxhash64("sha"), F.lit(parts)).alias("part")

    def _commit(self, rows_at: list[str], state_at: str, parts: int) -> None:
        version = self.version + 1
        line = self.spark.createDataFrame([(version, parts, rows_at, state_at, self.digest_bytes, self.part_keys)], "version int, parts long, rows array<string>, state string, digest_bytes int, part_keys int")
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version, self.parts, self.rows_at, self.state_at = version, parts, rows_at, state_at

    # -- updates ----------------------------------------------------------------------------

    def insert(self, docs: DataFrame, text: str = "text") -> None:
        """Adds every row of ``docs``."""
        at = f"{self.path}/rows-{self.version + 1:06d}"
        rows = self._hashed(docs, text).withColumns({"version": F.lit(self.version + 1), "row": F.monotonically_increasing_id()})
        rows.write.mode("overwrite").parquet(at)
        stored = self.spark.read.parquet(at)
        lines = stored.mapInArrow(_combine, self._schema("sha binary, n bigint, points bigint, doc_id {}, version int, row bigint"))
        self._apply(lines.withColumn("kind", F.lit(_PUT)), stored.count(), [*self.rows_at, at])

    def delete(self, docs: DataFrame, text: str = "text") -> None:
        """Takes off every live row that equals a row of ``docs`` in id and normalised text; others
        are no matter."""
        if not self.rows_at:
            return
        gone = self._hashed(docs, text).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))
        at = f"{self.path}/rows-{self.version + 1:06d}"
        self.rows().join(gone, same, "left_anti").write.mode("overwrite").parquet(at)
        left = self.spark.read.parquet(at)
        taken = self.rows().join(gone, same, "left_semi").groupBy("sha").agg(F.count("*").alias("n"))
        order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "version", "row")
        best = left.join(taken.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.min(order).alias("best"))
        lines = taken.join(best, "sha", "left").select("sha", "n", (-F.col("best.points")).alias("points"), *(F.col(f"best.{c}").alias(c) for c in _BEST[1:]), F.lit(_TAKE).alias("kind"))
        self._apply(lines, 0, [at])

    def _schema(self, text: str) -> str:
        return text.format(self.kind.simpleString())

    def _apply(self, lines: DataFrame, more: int, rows_at: list[str]) -> None:
        held = self.state().where(F.col("kind") == _KEY).count() if self.state_at else 0
        parts = self.parts
        if not parts or held + more > 2 * parts * self.part_keys:
            parts = (held + more) // self.part_keys + 1
        state = self.state()
        if parts != self.parts:  # the filters are filled anew from the stored keys
            state = state.where(F.col("kind") == _KEY).withColumn("part", self._part(parts))
        none = {"bits": F.lit(None).cast("int"), "slots": F.lit(None).cast("binary")}
        lines = lines.withColumns(none).withColumn("part", self._part(parts)).select(*_STATE)
        work = state.select(*_STATE).unionByName(lines).repartition("part").sortWithinPartitions("part", "kind", "sha")
        at = f"{self.path}/state-{self.version + 1:06d}"
        work.mapInArrow(_update(self.digest_bytes), self._lines).write.mode("overwrite").parquet(at)
        self._commit(rows_at, at, parts)

    # -- answers ----------------------------------------------------------------------------

    def groups(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every live row."""
        several = self.keys().where("n > 1")
        rows = self.rows().join(several, "sha", "left")
        alone = F.col("n").isNull()
        return rows.select(
            "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (alone | ((F.col("version") == F.col("keep_version")) & (F.col("row") == F.col("keep_row")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    def lookup(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """doc_id, text_sha256, live_rows (of the same text in the index) and keep_id of every row of
        ``docs``.  Only texts whose digest the filters know are looked for in the content."""
        rows = self._hashed(docs, text).select("doc_id", "sha")
        if not self.state_at:
            known = self.keys().select("sha", "n", "keep_id")
        else:
            asked = rows.select("sha").distinct().select(self._part(self.parts), F.lit(_PUT).alias("kind"), "sha", F.lit(None).cast("int").alias("bits"), F.lit(None).cast("binary").alias("slots"))
            filters = self.state().where(F.col("kind") == _FILTER).select("part", "kind", "sha", "bits", "slots")
            hits = filters.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "sha").mapInArrow(_hits(self.digest_bytes), "sha binary")
            known = hits.join(self.keys(), "sha").select("sha", "n", "keep_id")
        return rows.join(known, "sha", "left").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), F.coalesce("n", F.lit(0)).alias("live_rows"), "keep_id")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    kind = pa.int64()

    def done() -> pa.RecordBatch:
        best = list(zip(*(v[1] for v in held.values()))) or [()] * 4
        arrays = [pa.array(held, pa.binary()), pa.array((v[0] for v in held.values()), pa.int64()), *(pa.array(b, t) for b, t in zip(best, (pa.int64(), kind, pa.int32(), pa.int64())))]
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, ["sha", "n", *_BEST])

    for batch in batches:
        kind = batch.column("doc_id").type
        for sha, *best in zip(*(batch.column(c).to_pylist() for c in ("sha", *_BEST))):
            if entry := held.get(sha):
                entry[0] += 1
                entry[1] = min(entry[1], best, key=rank)
            else:
                held[sha] = [1, best]
        if len(held) > COMBINE:
            yield done()
    if held:
        yield done()


def _update(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines come sorted by part and kind; parts are loaded, updated and handed on one by one."""
        now, part, schema = None, Part(digest_bytes), None

        def done() -> pa.RecordBatch:
            f = part.filter
            if f is None:
                part.fill(LEAST_BITS)
                f = part.filter
            lines = [(now, _FILTER, None, None, None, None, None, None, f.bits, f.slots.tobytes())]
            lines += [(now, _KEY, sha, n, *best, None, None) for entries in part.content.values() for sha, n, best in entries]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), schema.types)], schema.names)

        for batch in batches:
            schema = batch.schema
            for at, kind, sha, n, *best, bits, slots in zip(*(batch.column(c).to_pylist() for c in _STATE)):
                if at != now:
                    if now is not None:
                        yield done()
                    now, part = at, Part(digest_bytes)
                if kind == _FILTER:
                    part.filter = Filter(bits, slots)
                elif kind == _KEY:
                    part.content.setdefault(part.digest(sha), []).append([sha, n, tuple(best)])
                else:
                    if part.filter is None:
                        part.fill(LEAST_BITS)
                    (part.insert if kind == _PUT else part.delete)(sha, n, tuple(best))
        if now is not None:
            yield done()

    return run


def _hits(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, Part(digest_bytes)
        for batch in batches:
            out = []
            for at, kind, sha, bits, slots in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "sha", "bits", "slots"))):
                if at != now:
                    now, part = at, Part(digest_bytes)
                if kind == _FILTER:
                    part.filter = Filter(bits, slots)
                elif part.filter and part.digest(sha) in part.filter:
                    out.append(sha)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sha"])

    return run


def groups(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``, by a new index in
    ``path``, which stays there for later insertions and deletions."""
    index = Index(docs.sparkSession, path, docs.schema["doc_id"].dataType)
    index.insert(docs, text)
    return index.groups()


#: DuckDB SQL of the groups of ``documents``.
ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, translate(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY points DESC, doc_id NULLS LAST)"""
