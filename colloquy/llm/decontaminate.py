"""Benchmark decontamination by edit distance.

Texts and items are sequences of lower-cased words of letters and digits.  A document holds an
item of m words when some stretch of it is within ``edits(m)`` word edits (a fifth of m) of it.

1. Windows.  Only stretches that can be that near are embedded: at most e edits leave at least
   m - 2 - 3 e of an item's word triples, so a window needs as many triples that occur in any
   item.  The triples are kept as a bitmap of fixed size (2 MB), which alone is broadcast.
   An item of more than ``PIECE`` words is cut into equal pieces: one of them has at most its
   share of the edits, a fifth of its words.  Windows have the sizes of ``CLASSES`` (a piece is
   compared by its first words, as many as the largest class up to its length) and begin on a
   grid of an eighth of their size.
2. Embedding.  A CGK walk writes, step after step, the word that it stands on, and moves on to
   the next one if a random bit of (step, word) says so.  Sequences that differ by an edit walk
   together again after a few steps, so a small edit distance becomes a small Hamming distance.
3. Bit sampling.  A key is a few sampled places of an embedding; windows and items with a key in
   common are candidates.  ``WALKS`` walks are sampled as often as it takes, in each class, to
   reach the target recall on mutated copies of a bounded sample of its pieces (``plan_samples``).
   A class that ``MOST`` samples do not bring there has the triples themselves as keys, one of
   which a near stretch keeps: no pair of it is missed.
4. Verification.  Each candidate's region is compared with the whole item exactly: the least
   edit distance of the item to any stretch of the region, by bit-parallel dynamic programming.

Items of fewer than ``LEAST`` words allow no edit: a document holds one if a run of its words
equals it, which is joined by the hash of the run.  Null and empty texts hold nothing; items without a text are nothing.  Long texts are handled whole.  Rows
that are equal in id and text give one result.  Null ids, of documents and of items, are reported
as null.  Repeated item ids, null among them, keep their nearest text.  Other columns are not carried.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import prepare, text_batches
from .words import NO_LETTER, Words, mix, windows, words

_U = np.uint64
LEAST = 6
#: Bits of the triple bitmap.
BITS = 1 << 24
WALKS = 6
#: Places of an embedding in a key.
PLACES = 2
#: Keys per walk at most.
MOST = 16
TARGET = 0.97
#: Pieces of a class on which its recall is measured at most, and mutated copies of them at least.
SAMPLE = 64
TRIALS = 256
#: Words of an item that are embedded as one at most.
PIECE = 47


def _classes() -> list[int]:
    out = [LEAST]
    while (c := max(out[-1] + 1, out[-1] * 13 // 10)) <= PIECE:
        out.append(c)
    return out


#: Window sizes, each about 1.3 times the one before: the last one's pieces reach up to ``PIECE``.
CLASSES = _classes()


def edits(m: int) -> int:
    """Edits allowed in an item of m words: a fifth, and no more than leave one triple whole."""
    return max(0, min(m // 5, (m - 3) // 3))


def size_class(m: int) -> int:
    return max(c for c in CLASSES if c <= m)


def pieces(first: int, m: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of m words from ``first`` on."""
    n = -(-m // PIECE)
    cut = [first + m * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def embed(tokens: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of rows of w words into 2 w steps; past its end a row writes 0."""
    n, w = tokens.shape
    padded = np.concatenate([tokens, np.zeros((n, 1), np.uint64)], 1)
    at, row = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 2 * w), np.uint64)
    for step in range(2 * w):
        word = padded[row, at]
        out[:, step] = word
        move = mix(word + _U(walk * 1_000_003 + step * 7919 + 1)) >> _U(63)
        at = np.minimum(at + move.astype(np.int64), w)
    return out


def keys(tokens: np.ndarray, samples: int) -> np.ndarray:
    """(rows, WALKS * samples) keys of rows of w words; without samples, their triples."""
    n, w = tokens.shape
    if not samples:
        key = np.full((n, w - 2), w * 100_000, np.uint64)
        for j in range(3):
            key = mix(key * _U(0xD6E8FEB86659FD93) + tokens[:, j : w - 2 + j])
        return key
    out = np.empty((n, WALKS * samples), np.uint64)
    for walk in range(WALKS):
        e = embed(tokens, walk)
        draw = np.random.Generator(np.random.PCG64(w * 64 + walk))
        for s in range(samples):
            at = draw.integers(0, 2 * w, PLACES)
            key = np.full(n, w * 100_000 + walk * 1000 + s, np.uint64)
            for a in at:
                key = mix(key * _U(0xD6E8FEB86659FD93) + e[:, a])
            out[:, walk * samples + s] = key
    return out


def mutated(item: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The item after as many random edits as are allowed."""
    body = item.tolist()
    for _ in range(edits(len(item))):
        at = int(draw.integers(0, len(body)))
        kind = int(draw.integers(0, 3))
        new = int(draw.integers(0, 1 << 62))
        body[at : at + (kind != 0)] = [new] if kind < 2 else []
    return np.array(body, np.uint64)


def plan_samples(c: int, some: list[np.ndarray]) -> int:
    """Keys per walk that find the target share of mutated pieces of class c: as many edits as
    are allowed, and a window begun up to half a grid step off.  0 if ``MOST`` do not."""
    draw = np.random.Generator(np.random.PCG64(11))
    copies = -(-TRIALS // len(some))
    near = np.empty((len(some) * copies, c), np.uint64)
    for i in range(len(near)):
        around = draw.integers(0, 1 << 62, 4 * c, dtype=np.uint64)
        text = np.concatenate([around[:c], mutated(some[i // copies], draw), around[c:]])
        off = c + int(draw.integers(-(c // 16), c // 16 + 1))
        near[i] = text[off : off + c]
    own = np.repeat(keys(np.stack([t[:c] for t in some]), MOST), copies, axis=0)
    same = (keys(near, MOST) == own).reshape(-1, WALKS, MOST).any(1)
    good = np.flatnonzero(np.logical_or.accumulate(same, axis=1).mean(0) >= TARGET)
    return int(good[0]) + 1 if len(good) else 0


def least_edits(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``item`` to a stretch of ``text`` and where the
    first such stretch ends; one machine word per column, as long as the item."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    has: dict[int, int] = {}
    for i, x in enumerate(item):
        has[x] = has.get(x, 0) | 1 << i
    plus, minus, now = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text):
        eq = has.get(x, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        now += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if now < best:
            best, end = now, j + 1
    return best, end


def tokens_of(texts: list[bytes]) -> Words:
    return words(texts, lower=True, space=NO_LETTER)


def _bit(h: np.ndarray) -> np.ndarray:
    return (h % _U(BITS)).astype(np.int64)


def _batch_pieces(w: Words) -> pd.DataFrame:
    """item (its number), start, words, c (class) and reach (how many words of the item, edits
    included, may lie beside it) of every piece of a batch."""
    rows = [(i, a, n, size_class(n), max(a - f, f + m - a - n) + edits(m) if m > n else 0) for i, (f, m) in enumerate(zip(w.first.tolist(), w.count.tolist())) if m >= LEAST for a, n in pieces(f, m)]
    return pd.DataFrame(rows, columns=["item", "start", "words", "c", "reach"], dtype="int64")


def _first_words(w: Words, part: pd.DataFrame, c: int) -> np.ndarray:
    return w.hash[part["start"].to_numpy()[:, None] + np.arange(c)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class in a batch, the largest reach and the pieces of least hash."""
    for _, texts in text_batches(batches):
        w = tokens_of(texts)
        out = []
        for c, part in _batch_pieces(w).groupby("c"):
            h = np.bitwise_xor.reduce(mix(_first_words(w, part, c) + np.arange(c, dtype=np.uint64)), axis=1)
            h, at = np.unique(mix(h), return_index=True)
            for x, i in zip(h[:SAMPLE].view(np.int64).tolist(), at[:SAMPLE]):
                a, n = part["start"].iat[i], part["words"].iat[i]
                out.append((c, part["reach"].max(), x, w.hash[a : a + n].view(np.int64).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["c", "reach", "hash", "piece"])


def _item_rows(plan: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            w = tokens_of(texts)
            found: dict[int, list[np.ndarray]] = {}
            for c, part in _batch_pieces(w).groupby("c"):
                for cut in range(0, len(part), 8192):
                    some = part[cut : cut + 8192]
                    for i, k in zip(some["item"].tolist(), keys(_first_words(w, some, c), plan[c])):
                        found.setdefault(i, []).append(k)
            own = sorted(found)
            toks = [w.hash[w.first[i] : w.first[i + 1]].view(np.int64).tolist() for i in own]
            key = [np.unique(np.concatenate(found[i])).view(np.int64).tolist() for i in own]
            yield pa.RecordBatch.from_arrays([batch.column("item_key").take(pa.array(own, pa.int64())), batch.column("item_id").take(pa.array(own, pa.int64())), pa.array(toks, pa.list_(pa.int64())), pa.array(key, pa.list_(pa.int64()))], ["item_key", "item_id", "item", "keys"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bitmaps: of the items' triples (size 0), and of the whole items of each size
    below ``LEAST``."""
    for _, texts in text_batches(batches):
        w = tokens_of(texts)
        for size in range(LEAST):
            h, whole = windows(w, size or 3)
            whole &= np.repeat(w.count == size if size else w.count >= LEAST, w.count)
            bit = np.unique(_bit(h[whole]))
            place, first = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(_U(1) << (bit & 63).astype(np.uint64), first) if len(bit) else np.array([], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), size)), pa.array(place), pa.array(value.view(np.int64))], ["size", "place", "bits"])


def _marked(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = _bit(h)
    return ((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & _U(1)).astype(bool)


def _short_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items below ``LEAST`` words, with the hash of their words."""
    for batch, texts in text_batches(batches):
        w = tokens_of(texts)
        for size in range(1, LEAST):
            own = np.flatnonzero(w.count == size)
            run = windows(w, size)[0][w.first[own]]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(own)), pa.array(np.full(len(own), size)), pa.array(run.view(np.int64))], ["item_id", "size", "run"])


def _runs(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's first run of words of every hash that a short item may have."""
        for batch, texts in text_batches(batches):
            w = tokens_of(texts)
            for size in sorted(set(bitmap.value) - {0}):
                h, whole = windows(w, size)
                at = np.flatnonzero(whole & _marked(h, bitmap.value[size]))
                found = pd.DataFrame({"text": np.searchsorted(w.first, at, "right") - 1, "run": h[at].view(np.int64), "at": at}).drop_duplicates(["text", "run"])
                text = found["text"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(text)), batch.column("doc_id").take(pa.array(text)), pa.array(np.full(len(text), size)), pa.array(found["run"].to_numpy()), pa.array(found["at"].to_numpy() - w.first[text])],
                    ["key", "doc_id", "size", "run", "first_word"])

    return run


def window_starts(w: Words, hits: np.ndarray, text_of: np.ndarray, c: int) -> np.ndarray:
    """Grid starts (as word numbers of the batch) of the windows of c words that hold enough of
    the triples at ``hits``: what an item of this class, up to 1.3 c words long, must at least
    keep of its first c words."""
    need = max(1, c - 2 - 3 * edits(c * 13 // 10))
    if len(hits) < need:
        return hits[:0]
    first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
    ok = (text_of[: len(first)] == text_of[need - 1 :]) & (last - first <= c - 3)
    first, last, base = first[ok], last[ok], w.first[text_of[: len(first)][ok]]
    size = w.first[text_of[: len(ok)][ok] + 1] - base
    step = max(1, c // 8)
    lo, hi = np.maximum(last - (c - 3) - base, 0) - step // 2, first - base + step // 2
    a, b = np.maximum(-(-lo // step), 0), np.minimum(hi // step, (size - 1) // step)
    many = np.maximum(b - a + 1, 0)
    grid = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
    return np.unique(np.repeat(base, many) + grid * step)


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """Values sorted by owner 0 to n - 1, as one list per owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _regions(plan: dict[int, int], beside: dict[int, int], bitmap):
    """``plan`` and ``beside``: by class, keys per walk and what its pieces' items add to a region."""
    sizes = sorted(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions of documents that may hold an item: their words and window keys."""
        bits = bitmap.value[0]
        for batch, texts in text_batches(batches):
            w = tokens_of(texts)
            h, whole = windows(w, 3)
            hits = np.flatnonzero(whole & _marked(h, bits))
            text_of = np.searchsorted(w.first, hits, "right") - 1
            starts = [window_starts(w, hits, text_of, c) for c in sizes]
            at = np.concatenate(starts) if starts else hits[:0]
            if not len(at):
                continue
            of = np.searchsorted(w.first, at, "right") - 1
            long = np.repeat(sizes, [len(s) for s in starts])
            pad = 6 * long // 10 + 2 + np.repeat([beside[c] for c in sizes], [len(s) for s in starts])
            lo, hi = np.maximum(at - pad, w.first[of]), np.minimum(at + long + pad, w.first[of + 1])
            order = np.lexsort((lo, of))
            reach = np.maximum.accumulate(hi[order])
            cut = np.ones(len(at), bool)
            cut[1:] = (lo[order][1:] > reach[:-1]) | (of[order][1:] != of[order][:-1])
            region = np.empty(len(at), np.int64)
            region[order] = np.cumsum(cut) - 1
            begin, text = lo[order][cut], of[order][cut]
            stop = reach[np.append(np.flatnonzero(cut)[1:], len(at)) - 1]
            found, owners, done = [], [], 0
            padded = np.concatenate([w.hash, np.zeros(max(sizes), np.uint64)])
            for c, s in zip(sizes, starts):
                for part in range(0, len(s), 8192):
                    some = s[part : part + 8192]
                    span = some[:, None] + np.arange(c)
                    end = w.first[of[done + part : done + part + len(some)] + 1]
                    tokens = np.where(span < end[:, None], padded[span], _U(0))
                    k = keys(tokens, plan[c])
                    found.append(k.ravel())
                    owners.append(np.repeat(region[done + part : done + part + len(some)], k.shape[1]))
                done += len(s)
            key, owner = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            n = len(begin)
            long = stop - begin
            word = np.repeat(begin - np.cumsum(long) + long, long) + np.arange(long.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(text)), batch.column("doc_id").take(pa.array(text)), pa.array(begin - w.first[text]),
                 _lists(np.repeat(np.arange(n), long), n, w.hash[word]), _lists(owner[new], n, key[new])],
                ["key", "doc_id", "start", "words", "keys"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        distance, first, last = [], [], []
        for item, text, start in zip(*(batch.column(n).to_pylist() for n in ("item", "words", "start"))):
            # each edit takes one word of the item at most: the others are all in the region
            near = sum(map(set(text).__contains__, item)) >= len(item) - edits(len(item))
            d, end = least_edits(item, text) if near else (len(item), 0)
            if near and d <= edits(len(item)):
                back, length = least_edits(item[::-1], text[:end][::-1])
                distance.append(d)
                first.append(start + end - length)
                last.append(start + end)
            else:
                distance.append(None)
                first.append(None)
                last.append(None)
        kinds = [batch.column(n) for n in ("key", "doc_id", "item_id")]
        yield pa.RecordBatch.from_arrays([*kinds, *(pa.array(x, pa.int64()) for x in (distance, first, last))], ["key", "doc_id", "item_id", "distance", "first_word", "end_word"])


def row_key(docs: DataFrame):
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (of a row's id and text), doc_id, item_id, distance, first_word and end_word (the
    nearest stretch) for every document and item that it holds."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item_key"), "item_id", "text").where("text IS NOT NULL")
    # at most LEAST * BITS / 64 rows, whatever the size of the benchmark
    placed = items.mapInArrow(_bits, "size bigint, place bigint, bits bigint").groupBy("size", "place").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = {size: np.zeros(BITS // 64, np.uint64) for size in {0, *placed["size"].tolist()}}
    for size, part in placed.groupby("size"):
        bits[size][part["place"].to_numpy(np.int64)] = part["bits"].to_numpy(np.int64).view(np.uint64)
    bitmap = spark.sparkContext.broadcast(bits)
    kind, own = (x.schema[n].dataType.simpleString() for x, n in ((items, "item_id"), (docs, "doc_id")))
    some = items.mapInArrow(_sampled, "c bigint, reach bigint, hash bigint, piece array<bigint>").withColumn("reach", F.max("reach").over(W.partitionBy("c")))
    some = some.dropDuplicates(["c", "hash"]).withColumn("n", F.row_number().over(W.partitionBy("c").orderBy("hash")))
    sample: dict[int, list[np.ndarray]] = {}
    reach: dict[int, int] = {}
    for r in some.where(F.col("n") <= SAMPLE).orderBy("c", "n").collect():  # at most SAMPLE pieces per class
        sample.setdefault(r["c"], []).append(np.array(r["piece"], np.int64).view(np.uint64))
        reach[r["c"]] = r["reach"]
    plan = {c: plan_samples(c, x) for c, x in sample.items()}
    known = items.mapInArrow(_item_rows(plan), f"item_key bigint, item_id {kind}, item array<bigint>, keys array<bigint>").dropDuplicates(["item_key"]).checkpoint()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key(docs))
    regions = rows.mapInArrow(_regions(plan, reach, bitmap), f"key bigint, doc_id {own}, start bigint, words array<bigint>, keys array<bigint>").checkpoint()
    probes = regions.select("key", "start", F.explode("keys").alias("k"))
    met = probes.join(known.select("item_key", F.explode("keys").alias("k")), "k").select("key", "start", "item_key").distinct()
    pairs = met.join(regions.drop("keys").dropDuplicates(["key", "start"]), ["key", "start"]).join(known.drop("keys"), "item_key")
    found = pairs.select("key", "doc_id", "item_id", "start", "words", "item").mapInArrow(_verify, f"key bigint, doc_id {own}, item_id {kind}, distance bigint, first_word bigint, end_word bigint")
    if len(bits) > 1:
        short = items.mapInArrow(_short_items, f"item_id {kind}, size bigint, run bigint").distinct()
        runs = rows.mapInArrow(_runs(bitmap), f"key bigint, doc_id {own}, size bigint, run bigint, first_word bigint")
        equal = runs.join(short, ["size", "run"]).withColumn("distance", F.lit(0).cast("long")).withColumn("end_word", F.col("first_word") + F.col("size"))
        found = found.unionByName(equal.drop("size", "run"))
    best = found.where("distance IS NOT NULL").groupBy("key", "doc_id", "item_id").agg(F.min(F.struct("distance", "first_word", "end_word")).alias("b"))
    return best.select("key", "doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns, whatever their names."""
    bad = hits(docs.select("doc_id", "text"), benchmark).select(F.col("key").alias("__bad")).distinct()
    rows = docs.select(row_key(docs).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return rows.join(bad, F.col("__key") == F.col("__bad"), "left_anti").select("__row.*")
