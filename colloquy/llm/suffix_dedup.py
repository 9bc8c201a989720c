"""Removal of repeated byte strings by column-wise suffix sorting of many texts.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Segments.  Of the ``GRAM``-byte strings inside each window of LENGTH bytes, the one with the
   least hash (the leftmost of equals) is the window's anchor.  Equal windows have equal anchors
   at equal places.  Consecutive windows with one anchor form a segment, about one per
   (LENGTH - GRAM) / 2 bytes.  Only anchors that occur twice or more can have repeated windows.
2. Equal segments of an anchor collapse into one with a count; with a count of two or more all of
   its windows are repeated.
3. Column-wise construction.  The distinct segments of an anchor are lined up at it.  From the
   last column to the first, each round inserts one symbol per segment: the order of the
   suffixes that start in a column follows from the order one column to the right by a stable
   sort on the new symbols (the collection's Burrows-Wheeler column), and the common prefix of
   two neighbours is one more than the least of those between them one column to the right.  A
   window is repeated when its suffix shares LENGTH symbols with a neighbour in that order.
   Windows at different distances from the anchor are never equal, so columns are never merged.
   The sequential external files are the sorted shuffle files: a task streams whole anchors from
   them into blocks of ``BLOCK`` segments.
4. An anchor with more than ``HOT`` distinct segments does not fit a block.  Its windows are
   told apart in three steps instead, by the content that all windows of a range of places share
   (ranges of 45 places, 9, then single windows), counted by hash with partial sums; ranges whose
   shared content occurs once are dropped.  That way is exact too.

Matches never cross documents.  Null and empty texts give zeros and the hash of nothing.  Texts
of any length are handled in overlapping chunks.  Null and repeated ids are allowed: a row is
known by a hash of id and text together with its length, so rows equal in both share a result.  An
empty table gives an empty result.
Other columns, clashing names included, are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, text_batches
from .words import mix, prefix_hash, slice_hash

LENGTH = 400
GRAM = 40
#: Text bytes whose segments are found at once.
CHUNK = 1 << 20
#: Segments whose columns are sorted together; a block holds at least one anchor's.
BLOCK = 2048
#: Distinct segments of one anchor that are sorted together at most (50 MB of symbols).
HOT = 32768
STEPS = (45, 9, 1)
_U = np.uint64
_PAD = 256
_SEGMENT = ["h", "ra", "off", "cnt"]


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width`` keys."""
    n = len(key)
    if n < width:
        return key[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) in lists of about CHUNK bytes; long texts overlap by length - 1."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            if len(t) < length:
                break
            part = t[at : at + CHUNK + length - 1]
            if size and size + len(part) > CHUNK + length:
                yield some
                some, size = [], 0
            some.append((i, at, part))
            size += len(part)
    if some:
        yield some


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Per segment: text, lo (first window), off (anchor's place after lo), cnt (windows), h (the
    anchor's hash) and ra (the hash of all its bytes)."""
    found: dict[str, list] = {n: [] for n in ("text", "lo", "off", "cnt", "h", "ra")}
    for some in _pieces(texts, length):
        buf = np.frombuffer(b"".join(p for _, _, p in some), np.uint8)
        sizes = np.array([len(p) for _, _, p in some], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        h = prefix_hash(buf)
        at = np.arange(len(buf) - gram + 1)
        grams = slice_hash(h, at, at + gram)
        key = (grams & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        anchor = (sliding_least(key, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        piece = np.repeat(np.arange(len(some)), sizes)[: len(anchor)]
        start = np.flatnonzero(np.arange(len(anchor)) + length <= base[piece + 1])
        new = np.ones(len(start), bool)
        new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        lo = start[first]
        cnt = np.diff(np.append(first, len(start)))
        a, p = anchor[lo], piece[lo]
        found["text"].append(np.array([i for i, _, _ in some], np.int64)[p])
        found["lo"].append(lo - base[p] + np.array([at for _, at, _ in some], np.int64)[p])
        found["off"].append(a - lo)
        found["cnt"].append(cnt)
        found["h"].append(grams[a])
        found["ra"].append(slice_hash(h, lo, lo + cnt - 1 + length))
    empty = {"h": np.uint64, "ra": np.uint64}
    return {n: np.concatenate(v) if v else np.array([], empty.get(n, np.int64)) for n, v in found.items()}


def columns(group: np.ndarray, off: np.ndarray, cnt: np.ndarray, data: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """Column-wise construction over segments sorted by ``group``: for each segment the runs
    [first, last, first, last ...] of its windows that another segment of its group has too."""
    n = len(data)
    left = int(off.max())
    width = left + int((cnt - 1 - off).max()) + length
    symbols = np.full((n, width), _PAD, np.uint16)
    for i, b in enumerate(data):
        symbols[i, left - off[i] : left - off[i] + len(b)] = np.frombuffer(b, np.uint8)
    symbols = np.ascontiguousarray(symbols.T)
    rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])).astype(np.int64) * 512
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    found = np.zeros((left + 1, n), bool)
    for col in range(width - 1, -1, -1):
        key = rank[order] + symbols[col][order]
        to = np.argsort(key, kind="stable")
        key = key[to]
        same = key[1:] == key[:-1]
        least = common[to]  # right for neighbours that stay neighbours
        apart = np.flatnonzero(same & (to[1:] != to[:-1] + 1))
        if len(apart):
            ends = np.stack([to[apart] + 1, to[apart + 1] + 1], 1).ravel()
            least[apart + 1] = np.minimum.reduceat(common, ends)[::2]
        common[1:n] = np.where(same, np.minimum(least[1:] + 1, length), 0)
        common[0] = 0
        order = order[to]
        if col <= left:
            hit = common[:n] >= length
            both = hit.copy()
            both[:-1] |= hit[1:]
            found[col, order[both]] = True
    out = []
    for i in range(n):
        own = found[left - off[i] : left - off[i] + cnt[i], i]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        edge[1::2] -= 1
        out.append(edge.tolist())
    return out


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor: whole anchors are gathered into blocks."""
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            h, ra, off, cnt, data = zip(*rows)
            runs = columns(np.array(h), np.array(off), np.array(cnt), list(data), length)
            keep = [i for i, r in enumerate(runs) if r]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for i in keep], t) for x, t in ((h, pa.int64()), (ra, pa.int64()), (off, pa.int32()), (cnt, pa.int32()))]
                + [pa.array([runs[i] for i in keep], pa.list_(pa.int32()))], [*_SEGMENT, "runs"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in [*_SEGMENT, "data"])):
                if len(held) >= BLOCK and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return run


def _ranges(length: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every open range of places of a segment, its parts of ``step`` places with the
        hash of the content that all windows of the part share."""
        for batch in batches:
            rows = batch.to_pylist()
            out: dict[str, list] = {n: [] for n in (*_SEGMENT, "m", "lo", "core")}
            for r in rows:
                data = np.frombuffer(r["data"], np.uint8)
                h = prefix_hash(data)
                for lo, hi in zip(r["open"][::2], r["open"][1::2]):
                    first, last = max(lo, r["off"] - r["cnt"] + 1), min(hi - 1, r["off"])
                    if first > last:
                        continue
                    los = np.arange(first // step * step, last + 1, step)
                    core = slice_hash(h, r["off"] - los, r["off"] - los - step + 1 + length)
                    for name in (*_SEGMENT, "m"):
                        out[name] += [r[name]] * len(los)
                    out["lo"] += los.tolist()
                    out["core"] += core.view(np.int64).tolist()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return run


def _hot(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated windows of anchors with very many distinct segments, as runs per segment."""
    places = length - gram + 1
    open_ = rows.withColumn("open", F.array(F.lit(0), F.lit(places)))
    for step in (s for s in STEPS if 2 * s <= length):
        parts = open_.select(*_SEGMENT, "m", "data", "open").mapInArrow(_ranges(length, step), "h bigint, ra bigint, off int, cnt int, m bigint, lo int, core bigint").checkpoint()
        often = parts.groupBy("h", "lo", "core").agg(F.sum("m").alias("s")).where("s >= 2").drop("s")
        parts = parts.join(often, ["h", "lo", "core"])
        if step > 1:
            kept = parts.groupBy(*_SEGMENT).agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("lo"), F.col("lo") + step)))).alias("open"))  # at most ``places``
            open_ = rows.join(kept, _SEGMENT)
    at = F.col("off") - F.col("lo")
    return parts.groupBy(*_SEGMENT).agg(F.flatten(F.collect_list(F.array(at, at))).cast("array<int>").alias("runs"))


def _found(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            s = segments(texts, length, gram)
            key = batch.column("key").to_numpy(zero_copy_only=False)[s["text"]]
            size = np.array([len(t) for t in texts], np.int64)[s["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s["h"].view(np.int64)), pa.array(s["ra"].view(np.int64)), pa.array(s["off"].astype(np.int32)), pa.array(s["cnt"].astype(np.int32)), pa.array(key), pa.array(size), pa.array(s["lo"])],
                [*_SEGMENT, "key", "size", "lo"])

    return run


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the segments that each text stands for."""
        for batch, texts in text_batches(batches):
            wanted = batch.column("wanted").to_pylist()
            rows = [(w, t) for ws, t in zip(wanted, texts) for w in ws]
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                arrays = [pa.array([w[n] for w, _ in part], k) for n, k in (("h", pa.int64()), ("ra", pa.int64()), ("off", pa.int32()), ("cnt", pa.int32()), ("m", pa.int64()), ("variants", pa.int64()))]
                data = pa.array([t[w["lo"] : w["lo"] + w["cnt"] - 1 + length] for w, t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, data], [*_SEGMENT, "m", "variants", "data"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        size, gone, count, digest, kept = [], [], [], [], []
        for t, spans in zip(texts, batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            rest, at = [], 0
            for a, b in merged:
                rest.append(t[at:a])
                at = b
            left = b"".join([*rest, t[at:]])
            size.append(len(t))
            gone.append(len(t) - len(left))
            count.append(len(merged))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, size, spans): the removed byte spans of every text that has any.  ``rows``: key, text."""
    every = rows.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(_found(length, gram), "h bigint, ra bigint, off int, cnt int, key bigint, size bigint, lo bigint")
    # stored, so that the join below shuffles both sides for itself and may split an anchor's segments
    often = every.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2").select("h").checkpoint()
    some = every.join(often, "h").checkpoint()
    kinds = some.groupBy(*_SEGMENT).agg(F.count("*").alias("m"), F.min(F.struct("key", "size", "lo")).alias("one")).checkpoint()
    per = kinds.groupBy("h").agg(F.count("*").alias("variants")).where("variants >= 2")
    rivals = kinds.join(per, "h")
    wanted = F.collect_list(F.struct(*_SEGMENT, "m", "variants", F.col("one.lo").alias("lo"))).alias("wanted")  # at most the text's segments
    wanted = rivals.groupBy(F.col("one.key").alias("k"), F.col("one.size").alias("z")).agg(wanted)
    data = rows.join(wanted, F.expr("key = k AND size = z")).select("text", "wanted").mapInArrow(_fetch(length), "h bigint, ra bigint, off int, cnt int, m bigint, variants bigint, data binary").checkpoint()
    data = data.dropDuplicates(_SEGMENT)  # rows equal in id and text bring theirs twice
    warm = data.where(F.col("variants") <= hot).select(*_SEGMENT, "data")
    warm = warm.repartition("h").sortWithinPartitions("h").mapInArrow(_blocks(length), "h bigint, ra bigint, off int, cnt int, runs array<int>")
    alone = data.where(F.col("variants") > hot).drop("variants")
    again = kinds.where("m >= 2").select(*_SEGMENT, F.array(F.lit(0), F.col("cnt") - 1).alias("runs"))
    runs = again.unionByName(warm)
    if not alone.isEmpty():
        runs = runs.unionByName(_hot(alone, length, gram))
    # runs of one segment found in two ways are united when spans are merged
    place = F.explode(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(
        (F.col("lo") + F.get(F.col("runs"), i * 2)).alias("start"), (F.col("lo") + F.get(F.col("runs"), i * 2 + 1) + length).alias("stop"))))
    cut = some.join(runs, _SEGMENT).select("key", "size", place.alias("s")).distinct()
    return cut.groupBy("key", "size").agg(F.collect_list("s").alias("spans"))


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("size", F.octet_length("text").cast("long"))
    found = spans(rows, length, gram, hot).select(F.col("key").alias("k"), F.col("size").alias("z"), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(found, F.expr("key = k AND size = z"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
