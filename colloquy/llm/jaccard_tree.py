"""N-gram Jaccard join with signature trees.

1. Blocking.  All shingles have one order: those of one set alone first, then by the number of sets
   that hold them, very frequent ones last.  Two sets with Jaccard similarity t or more share
   one of their first n - ceil(t n) + 1 shingles in that order, each set's ``prefix``; else
   fewer than t n could be common.  Shingles of one set alone can't be shared, so only the
   others of the prefix are keys, mostly none at all.  Sets that share a key are chained, and
   the components of the chains are the blocks: a linked pair never lies across two blocks.  A
   passage or boilerplate that many documents hold comes late in the order, so it seldom chains.
   Most sets have no near copy, and a part of their shingles shows it: with as many in no other
   set as the prefix is long, a set has no keys and links with nothing.  So the shingles of the
   least hashes (``SHARE`` prefixes of them) are counted first, and only a number for each set
   comes back.  Sets that it does not settle go on, with their texts and all their shingles.
   The numbers are counted exactly: distinct shingles of each task's sets are sent to the slice
   of their hash, ``NAMED`` bytes each, with their sets.  Very frequent shingles (by a table of
   counters, the only thing broadcast) stay at home, so no slice is large.  Shingles that share
   a name by chance only make a key more frequent, or chain two sets too many.
2. Tree.  Within a block, distinct sets are the leaves of a tree whose nodes hold the OR of their
   sets' token bitmaps, their size range, and whether they all are already joined.  A dual
   traversal visits pairs of nodes and leaves out those whose sizes or largest possible overlap
   cannot reach t, and those whose sets are already connected.  What remains is compared exactly.
3. Blocks of more than ``LEAVES`` shingles are cut into parts by hash, each a task of its own that
   also holds the block's hub, the set of least hash.  That joins most of a large group of near
   copies at once.  Sets outside the block's largest class so far are then dealt to tiles, each
   with one of the parts, so every pair that is not joined yet meets in a task.
4. The links found are a spanning forest of the linked sets, and its components are the classes.

Equal sets collapse into one leaf first.  Nothing is sampled and no block or key is capped.  Cost
of a block of g shingles, r of them in sets that the first round leaves outside: g / LEAVES tasks,
then (r / LEAVES) * (g / LEAVES) before pruning.

Documents without words or text have an empty set, link with nothing and are their own class, as
equal empty texts are too.  Sets are known by their hash, not by an id: rows without an id, and
rows that share an id but not a text, are each matched by their text.  A class's id is the least
id that is not null; if none of its rows has one, it is null.  So unrelated texts that share an id
can have equal class ids, and ``keep_one`` goes by the classes themselves.  Repeated rows stay
rows of their own.  Empty tables give empty results;
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import prepare, stored, text_batches, tidy
from .components import components
from .words import mix, shingle_sets, words

_U = np.uint64
#: Shingles and distinct sets of a block that one side of a task holds (2 MB), one set at least.
LEAVES, SETS = 200_000, 500
#: Text bytes per counter of shingle hashes, and the binary logarithms of the least and the largest
#: number of counters.  A shingle is very frequent if its counter is ``FREQUENT`` times the mean.
PER_COUNTER, COUNTERS = 512, (12, 24)
FREQUENT = 8
#: Shingles that a task sends at once, and those of a slice on average (100 MB in its task).
PACK = SLICE = 1 << 21
#: Bytes of a shingle's name inside its slice.
NAMED = 5
#: Shingles of a set that are counted first, as a multiple of its prefix.
SHARE = 4
#: Bits of a key's bitmap for each of the keys wanted, and the binary logarithms of its least and its
#: largest size (8 MB, broadcast).
PER_KEY, BITS = 16, (15, 26)
#: Keys that a task combines before it hands them on.
KEYS = 1 << 19
#: Sets under one lowest node, and nodes under a higher one.
FAN = 32
#: What names a set: whether no row has an id, the least id (else 0), its two hashes.  The least
#: name of a class so holds the class's id.
NAME = ["none", "least", "one", "two"]


class Threshold:
    """Similarity num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many first shingles of a set of n (in the common order) a linked set must meet."""
        return n + (-self.num * n) // self.den + 1

    def prefix_sql(self, n: str) -> str:
        return f"{n} - ({self.num} * {n} + {self.den - 1}) div {self.den} + 1"

    @property
    def limit(self) -> int:
        """Shingles up to this hash are counted first."""
        return min((1 << 64) - 1, SHARE * (self.den - self.num) * (1 << 64) // self.den)

    def linked(self, common: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    one = np.array([np.bitwise_xor.reduce(mix(s)) ^ _U(len(s)) for s in sets], np.uint64)
    two = np.array([np.add.reduce(mix(s + _U(77))) for s in sets], np.uint64)
    return mix(one).view(np.int64), mix(two).view(np.int64)


def _describe(k: int, docs: DataFrame, text: str, keep: list[str], bits: int) -> DataFrame:
    """doc_id, the columns ``keep``, n (set size), one, two (set hashes) per row; and rows with
    ``counter`` and ``weight``: how many shingles a task saw of each counter that stands out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, schema = np.zeros(1 << bits, np.int64), None
        names = ["doc_id", *keep, "n", "one", "two", "counter", "weight"]

        def rows(m: int, own: list, n: tuple, counts: tuple) -> pa.RecordBatch:
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([*own, *(n or (none,) * 3), *(counts or (none,) * 2)], names)

        for batch, texts in text_batches(batches, "__text"):
            schema = batch.schema
            sets = shingle_sets(words(texts, lower=True), k)
            one, two = set_keys(sets)
            first = np.unique(one, return_index=True)[1]  # copies of a text count once
            at, n = np.unique(np.concatenate([sets[i] for i in first]) & _U((1 << bits) - 1), return_counts=True)
            total[at.astype(np.int64)] += n
            yield rows(len(sets), [batch.column(c) for c in ("doc_id", *keep)], (pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)), ())
        at = np.flatnonzero(total >= 6 + 2 * total.mean())
        if len(at):
            yield rows(len(at), [pa.nulls(len(at), schema.field(c).type) for c in ("doc_id", *keep)], (), (pa.array(at), pa.array(total[at])))

    return docs.select("doc_id", *keep, F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"doc_id {kind}, {''.join(f'{c} bigint, ' for c in keep)}n bigint, one bigint, two bigint, counter bigint, weight bigint")


def _levels(counted: DataFrame, bits: int, total: int) -> np.ndarray:
    """By counter: 0, or how frequent (in powers of two) its shingles are if they are very frequent."""
    mean = total / (1 << bits)
    found = counted.groupBy("counter").agg(F.sum("weight").alias("n")).where(F.col("n") > FREQUENT * (mean + 4)).toPandas()  # at most 1 / FREQUENT of the counters
    out = np.zeros(1 << bits, np.uint8)
    out[found["counter"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(np.int64)).astype(np.uint8) + 1
    return out


def named(sets: list[np.ndarray], slices: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of sorted sets: slice (``slices``: their binary logarithm) and name in one number of each of the
    distinct shingles that are not very frequent, whose set each is, how many each set has of them,
    and each set's very frequent ones in their order."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), size)
    often = level[(flat & _U(len(level) - 1)).astype(np.int64)]
    rare = often == 0
    last = np.searchsorted(own[~rare], np.arange(len(sets) + 1))
    x, o = flat[~rare], often[~rare]
    late = [x[s:e][np.lexsort((x[s:e], o[s:e]))] for s, e in zip(last[:-1], last[1:])]
    name, own = flat[rare] >> _U(64 - 8 * NAMED - slices), own[rare]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
    return name[new], own[new], np.bincount(own[new], minlength=len(sets)), late


def _slices(total: int) -> int:
    """Binary logarithm of the number of slices for so many shingles."""
    return min(23, max(0, total // SLICE).bit_length())


def _key(name: np.ndarray) -> np.ndarray:
    return mix(name + _U(0x5851F42D4C957F2D)).view(np.int64)


def _gathered(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Hashes of distinct sets and the sets, of about PACK shingles at a time."""
    held: dict[int, np.ndarray] = {}
    size = 0
    for _, texts in text_batches(batches, "__text"):
        sets = [s for s in shingle_sets(words(texts, lower=True), k) if len(s)]
        for key, s in zip(set_keys(sets)[0].tolist(), sets):
            if key not in held:
                held[key] = s
                size += len(s)
        if size > PACK:
            yield np.array(list(held), np.int64), list(held.values())
            held.clear()
            size = 0
    if held:
        yield np.array(list(held), np.int64), list(held.values())


def _dealt(one: np.ndarray, name: np.ndarray, own: np.ndarray, slices: int) -> tuple[list, list, list, list]:
    """By slice: its number, the sets' hashes, how many of the slice's shingles each has, and their names."""
    part = (name >> _U(8 * NAMED)).astype(np.uint16 if slices <= 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    raw = name[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAMED]
    cut = np.searchsorted(part[order], np.arange((1 << slices) + 1))
    at, x, y, z = [], [], [], []
    for i in np.flatnonzero(np.diff(cut)).tolist():
        whose, n = np.unique(own[order[cut[i] : cut[i + 1]]], return_counts=True)
        at.append(i)
        x.append(one[whose].tobytes())
        y.append(n.astype(np.uint32).tobytes())
        z.append(raw[cut[i] : cut[i + 1]].tobytes())
    return at, x, y, z


def _opened(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Names and set hashes of one slice's rows of ``_dealt``."""
    names = np.frombuffer(b"".join(z for _, _, z in held), np.uint8).reshape(-1, NAMED)
    wide = np.zeros((len(names), 8), np.uint8)
    wide[:, :NAMED] = names
    own = np.repeat(np.frombuffer(b"".join(x for x, _, _ in held), np.int64), np.frombuffer(b"".join(y for _, y, _ in held), np.uint32))
    return wide.view("<u8").ravel(), own


def _offer(k: int, slices: int, limit: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles up to ``limit`` by slice and ``chunk``, the sets that were gathered together."""
        first = TaskContext.get().partitionId() << 32
        for chunk, (one, sets) in enumerate(_gathered(k, batches), first):
            name, own, _, _ = named([s[: np.searchsorted(s, _U(limit), "right")] for s in sets], slices, level.value)
            at, *rest = _dealt(one, name, own, slices)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(at), pa.int64()), pa.array(at, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], ["chunk", *_SENT[:4]])

    return run


def _lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice.  The answer to each row: how many of its sets' shingles no other set has."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        _, own, n = numbered(*_opened([row for _, *row in held]))
        one, m = np.unique(own[n == 1], return_counts=True)
        x, y = [], []
        for _, sets, _, _ in held:
            asked = np.frombuffer(sets, np.int64)
            at = np.searchsorted(one, asked)
            asked, at = asked[at < len(one)], at[at < len(one)]
            hit = one[at] == asked
            x.append(asked[hit].tobytes())
            y.append(m[at[hit]].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c for c, *_ in held], pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["chunk", "sets", "lone"])

    for batch in batches:
        for i, *row in zip(*(batch.column(c).to_pylist() for c in ("slice", "chunk", *_SENT[1:4]))):
            if i != now:
                if held:
                    yield done()
                    tidy()
                now, held = i, []
            held.append(row)
    if held:
        yield done()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk.  Sums over the slices by chunk and set."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        sets, n = np.frombuffer(b"".join(x for x, _ in held), np.int64), np.frombuffer(b"".join(y for _, y in held), np.uint32)
        one, at = np.unique(sets, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.bincount(at, n, len(one)).astype(np.int64))], ["set", "lone"])

    for batch in batches:
        for i, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sets", "lone"))):
            if i != now:
                if held:
                    yield done()
                now, held = i, []
            held.append(row)
    if held:
        yield done()


def _unsettled(k: int, t: Threshold, docs: DataFrame, text: str, sets: DataFrame, level, slices: int) -> DataFrame:
    """The rows of ``sets`` that may link: too few of their shingles counted first are in no other set."""
    sent = docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(_offer(k, slices, t.limit, level), "chunk bigint, slice bigint, sets binary, counts binary, names binary")
    lone = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(_lone, "chunk bigint, sets binary, lone binary")
    lone = lone.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "set bigint, lone bigint")
    lone = lone.groupBy("set").agg(F.max("lone").alias("lone"))  # a set in several chunks has its whole sum in each
    return sets.join(lone, F.col("one") == F.col("set"), "left").where(f"coalesce(lone, 0) < {t.prefix_sql('n')}").drop("set", "lone")


def _looked_up(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the column ``key`` of ``wanted``.  A bitmap of the keys comes first, so
    that hardly any other rows are shuffled."""
    wanted = wanted.select(key).distinct()
    bits = 1 << min(BITS[1], max(BITS[0], (PER_KEY * wanted.count()).bit_length()))
    page, at = F.floor(F.pmod(F.col(key), F.lit(bits)) / 32768).cast("int"), F.pmod(F.col(key), F.lit(32768))  # 4 KB a page
    maps = wanted.select(page.alias("__page"), at.cast("long").alias("at")).groupBy("__page").agg(F.bitmap_construct_agg("at").alias("__map"))
    marked = F.expr("(shiftright(cast(conv(hex(substring(__map, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1) = 1")
    near = rows.withColumn("__page", page).withColumn("__at", at).join(F.broadcast(maps), "__page").where(marked).drop("__page", "__at", "__map")
    return near.join(wanted, key)


def _ship(k: int, t: Threshold, slices: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles by slice.  Each set's numbers (rare shingles, prefix), and keys that are known here,
        go along."""
        for one, sets in _gathered(k, batches):
            name, own, rare, late = named(sets, slices, level.value)
            prefix = t.prefix(np.array([len(s) for s in sets], np.int64))
            at, x, y, z = _dealt(one, name, own, slices)
            parts = len(at)
            at += (one % (1 << slices)).tolist()
            extra = [s[:n] for s, n in zip(late, np.maximum(0, prefix - rare).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(x + [None] * len(one), pa.binary()), pa.array(y + [None] * len(one), pa.binary()), pa.array(z + [None] * len(one), pa.binary()),
                 pa.array([None] * parts + one.tolist(), pa.int64()), pa.array([None] * parts + rare.tolist(), pa.int64()), pa.array([None] * parts + prefix.tolist(), pa.int64()),
                 pa.array([None] * parts + [_key(s).tolist() for s in extra], pa.list_(pa.int64()))], _SENT)

    return run


_SENT = ["slice", "sets", "counts", "names", "one", "rare", "prefix", "late"]
_SENT_SQL = "slice bigint, sets binary, counts binary, names binary, one bigint, rare bigint, prefix bigint, late array<bigint>"


def numbered(names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, set and the number of sets that have the name, once for each set."""
    order = np.lexsort((own, names))
    names, own = names[order], own[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (own[1:] != own[:-1])
    names, own = names[new], own[new]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.array([], np.int64)
    n = np.diff(np.append(first, len(names)))
    return names, own, np.repeat(n, n)


def shared(names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of names that two sets or more have."""
    names, own, n = numbered(names, own)
    return names[n > 1], own[n > 1], n[n > 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice, and are counted slice by slice.  A set's own row (kind 0: ``name`` is
    its prefix, ``n`` its rare shingles) and keys that are already known (kind 2) pass through."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        name, whose, n = shared(*_opened(held))
        key = _key(name + _U(now << 8 * NAMED))
        order = np.argsort(whose, kind="stable")  # a set's rows together, which the shuffle compresses best
        return pa.RecordBatch.from_arrays([pa.array(whose[order]), pa.array(np.ones(len(key), np.int8)), pa.array(key[order]), pa.array(n[order])], ["one", "kind", "name", "n"])

    for batch in batches:
        at = batch.column("slice").to_pylist()
        sets, counts, names = (batch.column(c).to_pylist() for c in ("sets", "counts", "names"))
        for i, x, y, z in zip(at, sets, counts, names):
            if x is None:
                continue
            if i != now:
                if held:
                    yield done()
                    tidy()
                now, held = i, []
            held.append((x, y, z))
        own = batch.filter(batch.column("one").is_valid())
        yield pa.RecordBatch.from_arrays([own.column("one"), pa.array(np.zeros(own.num_rows, np.int8)), own.column("prefix"), own.column("rare")], ["one", "kind", "name", "n"])
        late = own.column("late")
        n = np.array([len(x) for x in late.to_pylist()], np.int64)
        one = np.repeat(own.column("one").to_numpy(zero_copy_only=False), n)
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.full(len(one), 2, np.int8)), late.flatten(), pa.array(np.zeros(len(one), np.int64))], ["one", "kind", "name", "n"])
    if held:
        yield done()


def prefix_keys(one: np.ndarray, kind: np.ndarray, name: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of rows sorted by set, kind, n, name: the shared names within each set's prefix.  Of its
    rare shingles those that no other set has come first."""
    if not len(one):
        return one, one
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    group = np.cumsum(np.concatenate([[True], one[1:] != one[:-1]])) - 1
    common = np.bincount(group[kind == 1], minlength=len(first))
    begin = first + np.bincount(group[kind == 0], minlength=len(first))
    rare, prefix = n[first], name[first]  # equal texts of several tasks have equal rows
    take = np.minimum(prefix, rare) - (rare - common)
    use = (kind == 1) & (np.arange(len(one)) - begin[group] < take[group])
    use |= kind == 2
    return name[use], one[use]


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted as ``prefix_keys`` needs them.  Of the keys found, (key, set) with kind 0, and
    (set, set) with kind 1 where several sets met here have a key."""
    left = [np.array([], t) for t in (np.int64, np.int8, np.int64, np.int64)]
    keys, owns, size = [], [], 0

    def done() -> pa.RecordBatch:
        key, own = np.concatenate(keys), np.concatenate(owns)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        leader = own[lead][np.cumsum(lead) - 1]
        links = np.unique(np.stack([leader[~lead], own[~lead]], 1), axis=0)
        links = links[links[:, 0] != links[:, 1]]
        kind = np.zeros(int(lead.sum()) + len(links), np.int8)
        kind[int(lead.sum()):] = 1
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([key[lead], links[:, 0]])), pa.array(np.concatenate([own[lead], links[:, 1]]))], ["kind", "a", "b"])

    def more(columns: list[np.ndarray]) -> None:
        nonlocal size
        key, own = prefix_keys(*columns)
        keys.append(key)
        owns.append(own)
        size += len(key)

    for batch in batches:
        columns = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(left, ("one", "kind", "name", "n"))]
        whole = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0  # the last set may go on
        more([c[:whole] for c in columns])
        left = [c[whole:] for c in columns]
        if size > KEYS:
            yield done()
            keys, owns, size = [], [], 0
    more(left)
    yield done()
    tidy()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; the first set of a key leads the others, also across batches."""
    last = lead = None
    for batch in batches:
        kind, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ready = kind == 1
        out_a, out_b = [a[ready]], [b[ready]]
        a, b = a[~ready], b[~ready]
        if len(a):
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            if last is not None and a[0] == last:
                new[0] = False
            group = np.cumsum(new)
            leads = np.concatenate([[0 if lead is None else lead], b[new]])[group]
            out_a.append(leads[~new])
            out_b.append(b[~new])
            last, lead = a[-1], leads[-1]
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _chains(k: int, t: Threshold, texts: DataFrame, level, slices: int) -> DataFrame:
    """(a, b): hashes of sets that share a key, chained by the least one of each key."""
    sent = texts.select(F.col("text").alias("__text")).mapInArrow(_ship(k, t, slices, level), _SENT_SQL)
    counted = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(_count, "one bigint, kind tinyint, name bigint, n bigint")
    order = ["one", "kind", "n", "name"]
    keys = counted.repartition("one").sortWithinPartitions(*order).mapInArrow(_choose, "kind tinyint, a bigint, b bigint")
    return keys.repartition("kind", "a").sortWithinPartitions("kind", "a", "b").mapInArrow(_chain, "a bigint, b bigint")


class Tree:
    """Signature tree over sets.  Trees that are traversed together need the same ``most``, the size
    of their largest set, so that their bitmaps are alike."""

    def __init__(self, sets: list[np.ndarray], most: int):
        size = np.array([len(s) for s in sets], np.int64)
        least = np.array([s[0] for s in sets], np.uint64)
        self.order = np.lexsort((least, size))  # near sets mostly share size and least shingle
        self.sets = [sets[i] for i in self.order]
        self.size = size[self.order]
        self.bits = 1 << min(16, max(9, (16 * most).bit_length()))
        maps = np.zeros((len(sets), self.bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = (s % _U(self.bits)).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 6, _U(1) << (at & 63).astype(np.uint64))
        self.maps = [maps]
        # shingles of a set that share a bit with another one of it
        self.extra = [self.size - np.bitwise_count(maps).sum(1).astype(np.int64)]
        self.low, self.high = [self.size], [self.size]
        while len(self.low[-1]) > 1:
            cut = np.arange(0, len(self.low[-1]), FAN)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], cut, axis=0))
            self.extra.append(np.maximum.reduceat(self.extra[-1], cut))
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
        self.flat = np.concatenate(self.sets) if sets else np.array([], np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def common(self, s: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Exact overlaps of sorted set ``s`` with sets lo to hi."""
        part = self.flat[self.at[lo] : self.at[hi]]
        spot = np.minimum(np.searchsorted(s, part), len(s) - 1)
        return np.add.reduceat((s[spot] == part).astype(np.int64), self.at[lo:hi] - self.at[lo])


def possible(u: Tree, v: Tree, level: int, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
    """Which pairs of nodes (i of u, j of v) can hold a linked pair of sets."""
    la, ha, lb, hb = u.low[level][i], u.high[level][i], v.low[level][j], v.high[level][j]
    ok = (t.den * ha >= t.num * lb) & (t.den * hb >= t.num * la)
    both = np.bitwise_count(u.maps[level][i] & v.maps[level][j]).sum(-1).astype(np.int64)
    most = both + np.minimum(u.extra[level][i], v.extra[level][j])
    most = np.minimum(most, np.minimum(ha, hb))
    # overlap c links sizes a, b only if c * (num + den) >= num * (a + b)
    return ok & (most * (t.num + t.den) >= t.num * (la + lb))


class Joined:
    """Which of a task's sets are connected already; ``root``: equal numbers for those that are."""

    def __init__(self, root: np.ndarray):
        _, first, at = np.unique(root, return_index=True, return_inverse=True)
        self.parent = first[at]

    def of(self, i: np.ndarray) -> np.ndarray:
        top = self.parent[i]
        while True:
            up = self.parent[top]
            if (up == top).all():
                self.parent[i] = top
                return top
            top = up

    def join(self, i: int, j: int) -> bool:
        """False if they were already."""
        a, b = self.of(np.array([i, j])).tolist()
        self.parent[b] = a
        return a != b


def traverse(u: Tree, v: Tree, at_u: np.ndarray, at_v: np.ndarray, joined: Joined, t: Threshold) -> list[tuple[int, int]]:
    """Links (position in u, position in v) that connect all linked sets of the two trees, given what
    is already connected.  ``at_u`` and ``at_v``: the sets' numbers in ``joined``."""
    links = []
    same = u is v
    top = min(len(u.maps), len(v.maps)) - 1
    stack = [(top, a, b) for a in range(len(u.maps[top])) for b in range(a if same else 0, len(v.maps[top]))]
    stack.sort(key=lambda x: (x[1] == x[2]))  # a node with itself comes off the stack first
    while stack:
        level, a, b = stack.pop()
        if level > 1:
            ia, ib = (np.arange(x * FAN, min((x + 1) * FAN, len(w.maps[level - 1]))) for x, w in ((a, u), (b, v)))
            i, j = (x.ravel() for x in np.meshgrid(ia, ib, indexing="ij"))
            if same:
                i, j = i[i <= j], j[i <= j]
            ok = possible(u, v, level - 1, i, j, t)
            stack += sorted(zip([level - 1] * int(ok.sum()), i[ok].tolist(), j[ok].tolist()), key=lambda x: x[1] == x[2])
            continue
        alo, ahi = (a * FAN, min((a + 1) * FAN, len(u.sets))) if level else (a, a + 1)
        blo, bhi = (b * FAN, min((b + 1) * FAN, len(v.sets))) if level else (b, b + 1)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(alo, ahi), np.arange(blo, bhi), indexing="ij"))
        ok = joined.of(at_u[i]) != joined.of(at_v[j])
        if same:
            ok &= i < j
        i, j = i[ok], j[ok]
        ok = possible(u, v, 0, i, j, t)
        i, j = i[ok], j[ok]
        for x in np.unique(i).tolist():
            near = j[i == x]
            near = near[joined.of(at_v[near]) != joined.of(at_u[[x]])]
            if not len(near):
                continue
            hit = t.linked(v.common(u.sets[x], blo, bhi)[near - blo], len(u.sets[x]), v.size[near])
            for y in near[hit].tolist():
                if joined.join(at_u[x], at_v[y]):
                    links.append((x, y))
    return links


_LINKS = ", ".join(f"{x}_{c} bigint" for x in "ab" for c in NAME)


def _block_links(k: int, t: Threshold, frame: pd.DataFrame) -> pd.DataFrame:
    """Links within one task's sets (``side`` 0: among themselves, else between the two sides), given
    the sets that are connected already (``root``)."""
    batch = pa.RecordBatch.from_arrays([pa.array(frame["text"], pa.string())], ["text"])
    # the texts in small slices, as hashing takes many times their size
    sets = [s for _, texts in text_batches(iter([batch])) for s in shingle_sets(words(texts, lower=True), k)]
    # a row key shared by chance may have brought another text along, a repeated row the same one
    key = pd.DataFrame(dict(zip(("one", "two"), set_keys(sets))) | {"side": frame["side"].to_numpy()})
    keep = np.flatnonzero((key["one"].to_numpy() == frame["one"].to_numpy()) & (key["two"].to_numpy() == frame["two"].to_numpy()) & ~key.duplicated().to_numpy())
    sets, side, name = [sets[i] for i in keep], frame["side"].to_numpy()[keep], frame[NAME].to_numpy(np.int64)[keep]
    joined = Joined(frame["root"].to_numpy(np.int64)[keep])
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    most = max(map(len, sets), default=0)
    u = Tree([sets[i] for i in left], most) if len(left) else None
    if (side == 0).all() and u:
        out = [(left[u.order[i]], left[u.order[j]]) for i, j in traverse(u, u, left[u.order], left[u.order], joined, t)]
    elif u and len(right):
        v = Tree([sets[i] for i in right], most)
        out = [(left[u.order[i]], right[v.order[j]]) for i, j in traverse(u, v, left[u.order], right[v.order], joined, t)]
    else:
        out = []
    at = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame(np.hstack([name[at[:, 0]], name[at[:, 1]]]), columns=[f"{x}_{c}" for x in "ab" for c in NAME])


def _linked(k: int, t: Threshold, tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Links found in every tile (block, x, y); ``tiles``: rep, NAME, n, block, x, y, side, root."""
    total = tiles.agg(F.sum("n")).first()[0] or 0  # one number
    # tasks by the shingles that they compare, not by bytes
    work = tiles.join(texts, "rep").repartition(int(total // LEAVES) + 1, "block", "x", "y")
    return work.groupBy("block", "x", "y").applyInPandas(lambda f: _block_links(k, t, f), _LINKS).checkpoint()


def _within_blocks(k: int, t: Threshold, reps: DataFrame, texts: DataFrame, leaves: int) -> DataFrame:
    """Links that connect all linked sets; ``reps``: rep, NAME, n, block of every distinct set."""
    parts = F.greatest(F.ceil(F.sum("n") / leaves), F.ceil(F.count("*") / SETS))
    sizes = reps.groupBy("block").agg(parts.alias("parts"), F.min("one").alias("hub"))
    reps = reps.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("one"), F.col("parts"))).checkpoint()
    # the hub goes to every part
    copies = F.when((F.col("one") == F.col("hub")) & (F.col("parts") > 1), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))
    first = reps.withColumn("x", F.explode(copies)).select("rep", *NAME, "n", "block", "x", F.lit(-1).cast("long").alias("y"), F.lit(0).alias("side"), F.col("one").alias("root"))
    links = _linked(k, t, first, texts)
    several = reps.where("parts > 1")
    if several.isEmpty():
        return links
    joined = components(links, "a_one", "b_one")
    several = several.join(joined, F.col("one") == F.col("node"), "left").withColumn("root", F.coalesce("component", "one")).drop("node", "component").checkpoint()
    largest = several.groupBy("block", "root").agg(F.sum("n").alias("w")).groupBy("block").agg(F.max(F.struct("w", "root")).alias("main"))
    rest = several.join(largest, "block").where("root <> main.root").drop("main").checkpoint()
    if rest.isEmpty():
        return links
    share = rest.groupBy("block").agg(parts.alias("others"))
    rest = rest.join(share, "block").withColumn("x", F.pmod(F.xxhash64("one"), F.col("others")))
    a = rest.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("side", F.lit(1))
    b = several.join(share, "block").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumn("y", F.col("part")).withColumn("side", F.lit(2))
    columns = ["rep", *NAME, "n", "block", "x", "y", "side", "root"]
    return links.unionByName(_linked(k, t, a.select(*columns).unionByName(b.select(*columns)), texts))


def row_key(text: str):
    return F.xxhash64("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least id (one
    of those without an id, if none has one), of rows equal in id and text one.  Texts without
    words stay.  Columns keep their names, whatever they are."""
    rows = docs.select(row_key("text").alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = _classed(rows.select("__key", "__row.doc_id", "__row.text"), k, num, den, keep=["__key"])
    free = found.where("n = 0").select("__key")
    first = found.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("one"))
    stay = free.unionByName(first.select(F.col("one.__key").alias("__key"))).distinct()
    return rows.dropDuplicates(["__key"]).join(stay, "__key", "left_semi").select("__row.*")


def classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text", leaves: int = LEAVES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the bigint columns ``keep``, n_shingles and component_id for every row of ``docs``; ``doc_id`` must be of an
    integer type.  Sets link at Jaccard similarity num / den or more on shingles of k words."""
    keep = keep or []
    out = _classed(docs, k, num, den, text, leaves, keep)
    of_class = F.when(F.col("class.none") == 0, F.col("class.least"))
    return out.select("doc_id", *keep, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, of_class).otherwise(F.col("doc_id")).cast(docs.schema["doc_id"].dataType).alias("component_id"))


def _classed(docs: DataFrame, k: int, num: int, den: int, text: str = "text", leaves: int = LEAVES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``keep``, n (set size) and class (the least name of its sets; null
    without words) of every row."""
    prepare(docs.sparkSession)
    t = Threshold(num, den)
    keep = keep or []
    docs = docs.withColumn("__row", row_key(text))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    bits = min(COUNTERS[1], max(COUNTERS[0], (size // PER_COUNTER).bit_length()))
    described = _describe(k, docs, text, [*keep, "__row"], bits).checkpoint()
    found = described.where("counter IS NULL").select("doc_id", *keep, "__row", "n", "one", "two")
    sets = found.where("n > 0").groupBy("one", "two", "n").agg(F.min("doc_id").cast("long").alias("least"), F.min("__row").alias("rep"))
    sets = sets.withColumn("none", F.col("least").isNull().cast("long")).fillna(0, ["least"]).checkpoint()
    total = sets.agg(F.sum("n")).first()[0] or 0
    level = _levels(described.where("counter IS NOT NULL"), bits, total)
    known = docs.sparkSession.sparkContext.broadcast(level)
    left = _unsettled(k, t, docs, text, sets, known, _slices(total)).checkpoint()
    texts = docs.select("doc_id", F.col("__row").alias("rep"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    texts = _looked_up(texts, "rep", left)  # once, most often few of all
    # many rows without an id may be equal
    texts = texts.where("doc_id IS NOT NULL").unionByName(texts.where("doc_id IS NULL").dropDuplicates(["rep"])).drop("doc_id")
    texts = stored(texts.dropDuplicates(["rep", "text"]), "block-texts")
    rest = left.agg(F.sum("n")).first()[0] or 0
    blocks = components(_chains(k, t, texts, known, _slices(rest)), "a", "b")  # of set hashes
    # one row for each distinct set of a block with others in it
    reps = left.join(blocks, left["one"] == blocks["node"]).select("rep", *NAME, "n", F.col("component").alias("block"))
    links = _within_blocks(k, t, reps, texts, leaves)
    joined = components(links.select(*(F.struct(*(F.col(f"{x}_{c}").alias(c) for c in NAME)).alias(x) for x in "ab")), "a", "b")
    named_sets = sets.withColumn("name", F.struct(*NAME))
    named_sets = named_sets.join(joined, named_sets["name"] == joined["node"], "left").select(F.col("one").alias("o"), F.col("two").alias("w"), F.col("n").alias("m"), F.coalesce("component", "name").alias("class"))
    return found.join(named_sets, F.expr("one = o AND two = w AND n = m AND n > 0"), "left").select("doc_id", *keep, "n", "class")
