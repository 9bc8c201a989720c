"""Repair of the turn structure of conversations, by a Viterbi search in parallel chunks.

A conversation's role initials must read ``(s?(ua)+)?``.  Edits: Keep a row (0), Rerole it to user or
assistant (3), Delete it (4; required for blank and duplicate rows), Insert a user or assistant row
without text anywhere (3); a truncated row that is not deleted adds 3.  Of the cheapest edits those
whose initials, in order, are least in ASCII (D, I, K, R) are taken.

A row's first fault counts: blank (nothing but 0x20 and 0x09-0x0D), duplicate (role and text
seen earlier in the conversation), truncated (the last other character is not ``.!?``).

The states of the search are what the output ends in: nothing, s, u or a.

1. Rows are ordered by a range partition, narrow (roles, hashes and flags), so a conversation of
   any length is spread over many tasks.  Each becomes one byte: its initial and its fault.  The
   bytes of a conversation are cut into chunks of at most ``CHUNK`` rows.
2. Backward costs.  Every chunk computes its cost vectors from its end to its beginning.  A chunk
   with another one behind it starts from a speculative vector.  Fix-up passes start those
   chunks anew whose speculation differs from the vector that the next chunk arrived at, by more
   than a constant, until there are none.  Few rows make any two vectors parallel, so a pass
   seldom changes more than the last ones; passes end after as many as a conversation has chunks.
3. Stitched together, the vectors are the costs to go up to a constant per chunk, and only their
   differences matter for the least-audit tracing, forwards: in each state the first letter that
   lies on a cheapest way.  Where a trace leaves a chunk depends on where it enters; these maps of
   four states are composed by doubling until they are constant, mostly at once.
4. The texts are shuffled once, behind their conversation's audit, and streamed through the edits.
   ``repaired_sha256`` is one hash over a conversation's whole output, which only one task after
   the other can compute: a very long conversation is streamed by one task there, in bounded
   memory but for its audit of about one byte per row.

Rows come by turn, nulls first, ties by role and the text's hash.  Null roles and texts are one
space; a null conv_id is a conversation of its own.  Repeated rows are duplicates.  Roles with other
initials (or none) can be reroled or deleted.  Texts of any length are taken whole.  Empty tables
give empty results.  Other columns, clashing names included, are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare, staging_path

#: Rows of a chunk at most.
CHUNK = 4096
#: Fixed value: the characters that make a text blank.
SPACE = " \t\n\v\f\r"
DELETE, OTHER = 4, 3  # costs: Delete; Rerole, Insert and a truncated row
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: By state (nothing, s, u, a): the state after the next user or assistant row.
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: Costs at the end of a conversation: the rows that are still to be inserted.
FINAL = (0, 6, 3, 0)
GUESS = (0, 0, 0, 0)


def _kept(initial: int, state: int) -> int | None:
    """The state after a row of an initial (0 s, 1 u, 2 a, 3 any other) is kept."""
    if initial == 0:
        return 1 if state == 0 else None
    return NEXT[state] if initial == (2 if state == 2 else 1) else None


def _ways(code: int, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: letter, cost, state."""
    initial, fault = code & 3, code >> 2
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = OTHER if fault == TRUNCATED else 0
        kept = _kept(initial, state)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", OTHER + more, NEXT[state]))
    return out


def _costs(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    v = [min(c + after[to] for _, c, to in _ways(code, q)) for q in range(4)]
    u, a = min(v[2], OTHER + v[3]), min(v[3], OTHER + v[2])  # one insertion leads from u to a and back
    return min(v[0], OTHER + u), min(v[1], OTHER + u), u, a


@cache
def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost vector in front of a row, from the one behind it; vectors that differ by a constant
    are one, with 0 as the least cost."""
    v = _costs(code, after)
    return tuple(x - min(v) for x in v)


@cache
def letters(code: int, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """The least audit of a row with the insertions in front of it: letters, cost, state."""
    v, word, paid = _costs(code, after), "", 0
    while True:
        ways = {x: (c, to) for x, c, to in _ways(code, state)}
        for x in "DIKR":
            if x == "I" and v[state] == OTHER + v[NEXT[state]]:
                word, paid, state = word + x, paid + OTHER, NEXT[state]
                break
            if x in ways and v[state] == ways[x][0] + after[ways[x][1]]:
                return word + x, paid + ways[x][0], ways[x][1]


def head(codes: bytes, start: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector in front of a chunk from the one behind it."""
    for c in reversed(codes):
        start = before(c, start)
    return start


def trace(codes: bytes, start: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """Audit, cost and state behind a chunk that is entered in ``state``."""
    after = [start]
    for c in reversed(codes[1:]):
        after.append(before(c, after[-1]))
    words, paid = [], 0
    for c, v in zip(codes, reversed(after)):
        word, cost, state = letters(c, v, state)
        words.append(word)
        paid += cost
    if last:
        n = FINAL[state] // OTHER
        words.append("I" * n)
        paid += FINAL[state]
    return "".join(words), paid, state


# -- chunks -------------------------------------------------------------------------------------


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mark (the text's hash)."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("mark"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Every row's place ``pos`` in the order of all rows, its initial and its fault but for
    duplicates, stored."""
    spark = rows.sparkSession
    shown = F.translate("text", SPACE, "")
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    order = ["conv_id", "turn", "role", "mark", "row"]  # rows alike in all else are kept apart by their number
    narrow = rows.select("conv_id", "turn", "role", "mark", F.monotonically_increasing_id().alias("row"), initial.alias("initial"), fault.alias("fault"))
    path = staging_path(spark, "turns")
    narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("turn", "row").write.parquet(path)
    return spark.read.parquet(path)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, no, codes, opens, ends): the rows' bytes by conversation and chunk.  ``no`` counts
    chunks through all rows; a conversation's chunks have consecutive ones.  ``opens`` and ``ends``:
    whether it is the first or last conversation of its chunk, which others may continue."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = _ordered(rows)
    firsts = placed.groupBy("conv_id", "role", "mark").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "first")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    part, local = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    flagged = placed.join(firsts, _same("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
    flagged = flagged.select("conv_id", "pos", (fault * 4 + F.col("initial")).cast("int").alias("code"), part.alias("part"), F.floor(local / size).alias("local"))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.ceil(F.count("*") / size).alias("n")).collect())  # a row for each partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    offsets = spark.createDataFrame(offsets, "part long, offset long")
    numbered = flagged.join(F.broadcast(offsets), "part").select("conv_id", "pos", "code", (F.col("offset") + F.col("local")).alias("no"))
    path = staging_path(spark, "chunks")
    cut = numbered.repartition("no").sortWithinPartitions("no", "pos").mapInArrow(_cut, f"conv_id {kind}, no bigint, codes binary, opens boolean, ends boolean")
    cut.write.parquet(path)
    return spark.read.parquet(path)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []  # conv_id, no, codes, opens
    schema = None

    def done(last: bool) -> pa.RecordBatch:
        """All but the last run, of which more may come; its chunk tells whether it ends there."""
        out = held if last else held[:-1]
        ends = [i + 1 == len(held) or held[i + 1][1] != x[1] for i, x in enumerate(out)]
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], schema.field("conv_id").type), pa.array([x[1] for x in out], pa.int64()), pa.array([bytes(x[2]) for x in out], pa.binary()), pa.array([x[3] for x in out], pa.bool_()), pa.array(ends, pa.bool_())],
                                           ["conv_id", "no", "codes", "opens", "ends"])
        del held[: len(out)]
        return batch

    for batch in batches:
        schema = batch.schema
        for conv, no, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "no", "code"))):
            if not held or held[-1][1] != no or held[-1][0] != conv:
                held.append([conv, no, bytearray(), not held or held[-1][1] != no])
            held[-1][2].append(code)
        if len(held) > 1:
            yield done(False)
    if held:
        yield done(True)


# -- passes -------------------------------------------------------------------------------------


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(head(c, tuple(s))) for c, s in zip(batch.column("codes").to_pylist(), batch.column("start").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "no", "more", "start")), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "no", "more", "start", "head"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a trace leaves each chunk, by the state in which it enters (0 if none comes before)."""
    for batch in batches:
        out = []
        for codes, start, more, enters in zip(*(batch.column(c).to_pylist() for c in ("codes", "start", "more", "enters"))):
            ends = [trace(codes, tuple(start), q, not more)[2] for q in (range(4) if enters else (0,))]
            out.append(ends if enters else ends * 4)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("no"), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "no", "exits"])


def _shifted(df: DataFrame, by: int, *columns: str) -> DataFrame:
    """(c, n, columns) for a join that gives row ``no`` what stands at ``no`` - ``by``."""
    return df.select(F.col("conv_id").alias("c"), (F.col("no") + by).alias("n"), *(F.col(x).alias(f"its_{x}") for x in columns))


def _at() -> Column:
    return _same("conv_id", "c") & (F.col("no") == F.col("n"))


def _vector(v: tuple[int, ...]) -> Column:
    return F.array(*(F.lit(x).cast("int") for x in v))


def stitched(cut: DataFrame) -> tuple[DataFrame, int]:
    """For chunks that others may continue: start (the vector behind the chunk), state (in which it
    is entered), more (whether another one follows); and the number of fix-up passes."""
    spark = cut.sparkSession
    kind = cut.schema["conv_id"].dataType.simpleString()
    edge = cut.where("opens OR ends")
    follows, comes = (_shifted(edge.where(w), by, "no") for w, by in (("opens", -1), ("ends", 1)))
    edge = edge.join(follows, _at(), "left").withColumn("more", F.col("ends") & F.col("its_no").isNotNull()).drop("c", "n", "its_no")
    edge = edge.join(comes, _at(), "left").withColumn("enters", F.col("opens") & F.col("its_no").isNotNull()).drop("c", "n", "its_no")
    edge = edge.select("conv_id", "no", "codes", "more", "enters").checkpoint()
    shape = f"conv_id {kind}, no bigint, more boolean, start array<int>, head array<int>"
    now = edge.withColumn("start", F.when(F.col("more"), _vector(GUESS)).otherwise(_vector(FINAL))).mapInArrow(_heads, shape).checkpoint()
    passes = 0
    while True:
        ahead = now.join(_shifted(now, -1, "head"), _at(), "left").withColumn("wrong", F.col("more") & (F.col("its_head") != F.col("start"))).checkpoint()
        wrong = ahead.where("wrong").select("conv_id", "no", F.col("its_head").alias("start"))
        if wrong.isEmpty():
            break
        passes += 1
        wrong = wrong.select(F.col("conv_id").alias("c"), F.col("no").alias("n"), "start")
        again = edge.join(wrong, _at()).drop("c", "n").mapInArrow(_heads, shape)
        now = ahead.where("NOT coalesce(wrong, false)").select("conv_id", "no", "more", "start", "head").unionByName(again).checkpoint()
    plan = now.select(F.col("conv_id").alias("c"), F.col("no").alias("n"), "start")
    work = edge.join(plan, _at()).drop("c", "n")
    maps = work.mapInArrow(_exits, f"conv_id {kind}, no bigint, exits array<int>").checkpoint()
    exits, by = maps, 1
    while not exits.where(F.size(F.array_distinct("exits")) > 1).isEmpty():
        earlier = exits.join(_shifted(exits, by, "exits"), _at(), "left")
        through = F.transform("its_exits", lambda q: F.element_at("exits", q + 1))
        exits = earlier.select("conv_id", "no", F.coalesce(through, F.col("exits")).alias("exits")).checkpoint()
        by *= 2
    entered = work.join(_shifted(exits, 1, "exits"), _at(), "left")
    state = F.when(F.col("enters"), F.element_at("its_exits", 1)).otherwise(0)
    return entered.select("conv_id", "no", "codes", "start", state.alias("state"), "more"), passes


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for codes, start, state, more in zip(*(batch.column(c).to_pylist() for c in ("codes", "start", "state", "more"))):
            audit, cost, _ = trace(codes, tuple(start), state, not more)
            faults = [x >> 2 for x in codes]
            out.append((audit, cost, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED)))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("no"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["conv_id", "no", "audit", "cost", "blank", "duplicate", "truncated"])


def audits(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, no, audit, cost, blank, duplicate, truncated) of every chunk; ``rows``: as ``_plain``
    gives them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    cut = chunks(rows, size)
    edge, _ = stitched(cut)
    whole = cut.where("NOT (opens OR ends)").select("conv_id", "no", "codes", _vector(FINAL).alias("start"), F.lit(0).alias("state"), F.lit(False).alias("more"))
    return edge.unionByName(whole).mapInArrow(_audits, f"conv_id {kind}, no bigint, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint")


# -- results ------------------------------------------------------------------------------------

_SUMS = ["cost", "blank", "duplicate", "truncated"]


class Conversation:
    """Takes a conversation's chunks, then its rows in order, and gives the repaired rows."""

    def __init__(self, conv):
        self.conv, self.words, self.sums = conv, [], [0, 0, 0, 0]
        self.audit, self.at, self.state, self.n = None, 0, 0, 0
        self.illegal, self.initial = 0, None
        self.turn = self.low = None
        self.turns = 0
        self.digest = hashlib.sha256()

    def chunk(self, audit: str, sums: list[int]) -> None:
        self.words.append(audit)
        self.sums = [a + b for a, b in zip(self.sums, sums)]

    def _out(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        self.n += 1
        return self.n - 1, role, text, edit

    def _inserted(self) -> Iterator[tuple]:
        if self.audit is None:
            self.audit = "".join(self.words)
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = ROLES[self.state], NEXT[self.state]
            self.at += 1
            yield self._out(role, "", "I")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = turn
            self.turns += 1
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role = ROLES[self.state]
        if edit != "D":
            self.state = 1 if edit == "K" and initial == "s" else NEXT[self.state]
            yield self._out(role, text, edit)

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()
        if self.at != len(self.audit):
            raise ValueError(f"the rows of conversation {self.conv} differ from its audit")

    def facts(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        cost, blank, duplicate, truncated = self.sums
        return self.conv, gaps, blank, duplicate, truncated, self.illegal, cost, self.audit, self.digest.hexdigest()


def _streamed(turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines come sorted by conversation: its chunks, then its rows."""
        now: Conversation | None = None
        out: list[tuple] = []
        names = ["conv_id", "position", "role", "text", "edit"] if turns else ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        schema = None

        def put(made: Iterator[tuple]) -> None:
            for x in made:
                if turns:
                    out.append((now.conv, *x))

        def close() -> None:
            put(now.end())
            if not turns:
                out.append(now.facts())

        def flush() -> pa.RecordBatch:
            kinds = [schema.field("conv_id").type, *([pa.int64(), pa.string(), pa.string(), pa.string()] if turns else [*[pa.int64()] * 6, pa.string(), pa.string()])]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(names), kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            schema = batch.schema
            for conv, kind, audit, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "audit", *_SUMS, "turn", "role", "text"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        close()
                    now = Conversation(conv)
                if kind == 0:
                    now.chunk(audit, rest[:4])
                else:
                    put(now.row(*rest[4:]))
            yield flush()
        if now is not None:
            close()
            yield flush()

    return run


def _lines(rows: DataFrame, size: int, ids: DataFrame | None) -> DataFrame:
    spark = rows.sparkSession
    prepare(spark)
    rows = _plain(rows)
    found = audits(rows, size)
    if ids is not None:
        none = [F.lit("").alias("audit"), *(F.lit(0).cast("long").alias(c) for c in _SUMS)]
        found = found.unionByName(ids.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("no"), *none))
    empty = {"turn": rows.schema["turn"].dataType, "role": "string", "text": "string", "mark": "binary"}
    found = found.select("conv_id", F.lit(0).alias("kind"), "no", "audit", *_SUMS, *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    rows = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("no"), F.lit(None).cast("string").alias("audit"), *(F.lit(None).cast("long").alias(c) for c in _SUMS), "turn", "role", "text", "mark")
    return found.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "no", "turn", "role", "mark")


def repaired(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text and edit (K, R or I)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _lines(rows, size, None).mapInArrow(_streamed(True), f"conv_id {kind}, position bigint, role string, text string, edit string")


def report(rows: DataFrame, ids: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """conv_id, gaps (turns that are missing between the first and last), blank, duplicate,
    truncated and illegal (adjacent initials other than su, ua, au) as found, cost, audit and
    repaired_sha256 of every conversation; those of ``ids`` that have no rows, too."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _lines(rows, size, ids).mapInArrow(_streamed(False), shape)


def damaged(rows: DataFrame) -> DataFrame:
    """Stand-in for conversations with faults: by crc32 of ``conv_id:turn`` modulo 20, rows are dropped
    (0), emptied (1), robbed of ``.!?`` (2), repeated (3) or made user rows (4)."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    fate = F.crc32(name) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).where("fate <> 0")
    out = out.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("col")
