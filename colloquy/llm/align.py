"""Alignment of two tokenizers' tokens, byte for byte.

A text, behind one space, is encoded by a byte-level BPE (A, a ``tokenizers`` file) and a
piece BPE (B, a ``sentencepiece`` model that puts the space there itself).  Every token covers a
byte range of the same bytes.

1. Interval coalescing.  The A and B tokens of a batch of texts are lexsorted by start; the running
   maximum of their ends is accumulated, and a group ends where a start reaches it: there an A and
   a B token end together.  Within the groups the overlapping pairs of tokens, the links, are
   expanded from the first and last B token that an A token meets.
2. Counts.  A text's links are stored as its distinct id pairs, sorted and delta-coded, so no text
   is encoded twice.  Tasks sum the pairs of all their texts before the shuffle.
3. Look-up.  The pairs of the highest counts, at most ``HEAD`` of them, are broadcast; links of rarer
   pairs, of which no one is frequent, are joined.  Where all pairs fit, there is nothing to join.

A is encoded with ``tiktoken`` on the file's own vocabulary, which is right only if the file's
merges are ranked as its ids are and nothing else changes the text; ``Encoders`` checks that and
raises if not.  Texts with code points that Python's Unicode tables leave unassigned, and those
with runs of over ``RUN`` characters of one kind, go through the file's own library.

Texts that are null, empty, or whose tokens do not spell the space and the text (a model that
normalises) have no tokens: zeros, and '' for the hash.  Texts of any length are encoded whole, as
a merge may depend on all of a word; memory is bounded by the longest text.  Strings of special
tokens are plain text.  Repeated rows and rows without an id are rows of their own; ties of counts
are all best.  Empty tables give empty results.  Other columns, clashing names included, are not
carried.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import prepare, staging_path, text_batches
from .token_count import PATTERN, unsure

#: Pairs whose counts are broadcast at most (17 MB).
HEAD = 1 << 20
#: Distinct pairs that a task sums before it hands them on (16 MB).
SUMS = 1 << 20
#: Characters of one kind in a row from which the file's own library encodes a text.
RUN = 1000


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: the byte's own where that is
    printable in Latin-1, else the next one from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{a_path}: a byte-level BPE with the standard split and without a normaliser is needed")
        letters = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(map(letters.__getitem__, s)): i for s, i in vocab.items() if s not in special}
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        order = [vocab["".join(x)] for x in merges]
        if order != sorted(set(order)) or len(ranks) - 256 != len(order):
            raise ValueError(f"{a_path}: its merges are not ranked as its ids are")
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            self.a_bytes[i] = s
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.signed = [[f"{i}{c}" for i in range(len(t)) for c in ",|;"] for t in (self.a_bytes, self.b_bytes)]
        self.odd = unsure()
        self.run = regex.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if (not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()) or self.run.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none for texts that the tokens do not spell."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        a = [self.encode_a(" " + t) if t else [] for t in strings]
        b = self.b.encode(strings, num_threads=1)
        for i, t in enumerate(texts):
            whole = b" " + t
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


@lru_cache(2)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


@dataclass
class Aligned:
    """Tokens of a batch of texts: ids, group and byte range of every A and every B token, where
    each text's tokens begin, and for every link its A and its B token."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=first[1:])
    return np.fromiter((t for x in ids for t in x), np.int64, int(first[-1])), first


def coalesce(a: list[list[int]], b: list[list[int]], a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Both sides of each text must cover equally many bytes, and every token at least one."""
    a_ids, a_first = _flat(a)
    b_ids, b_first = _flat(b)
    a_end, b_end = np.cumsum(a_size[a_ids]), np.cumsum(b_size[b_ids])
    a_start, b_start = a_end - a_size[a_ids], b_end - b_size[b_ids]
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = hi - lo
    link_a = np.repeat(np.arange(len(a_ids)), n)
    link_b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return Aligned(a_ids, b_ids, a_first, b_first, group[: len(a_ids)], group[len(a_ids) :], a_end, link_a, link_b)


def spelled(x: Aligned, enc: Encoders) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    def marks(group: np.ndarray, last: int) -> np.ndarray:
        sign = np.zeros(len(group), np.int64)
        if len(group):
            sign[:-1][group[1:] != group[:-1]] = last
            sign[-1] = last
        return sign

    n = int(max(x.a_group[-1], x.b_group[-1])) + 1 if len(x.a) else 0
    before_b = np.concatenate([[0], np.cumsum(np.bincount(x.b_group, minlength=n))])
    upto_a = np.cumsum(np.bincount(x.a_group, minlength=n))
    a_count = len(enc.signed[0])
    code = np.empty(len(x.a) + len(x.b), np.int64)
    code[np.arange(len(x.a)) + before_b[x.a_group]] = x.a * 3 + marks(x.a_group, 1)
    code[np.arange(len(x.b)) + upto_a[x.b_group]] = a_count + x.b * 3 + marks(x.b_group, 2)
    table = enc.signed[0] + enc.signed[1]
    words = list(map(table.__getitem__, code.tolist()))
    at = (x.a_first + x.b_first).tolist()
    return ["".join(words[s:e])[:-1] for s, e in zip(at[:-1], at[1:])]


_ROW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def _store(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(a_path, b_path)
        span = len(enc.a_bytes) * len(enc.b_bytes)
        for batch, texts in text_batches(batches, "__text"):
            x = coalesce(*enc.encode(texts), enc.a_size, enc.b_size)
            n = len(texts)
            doc = np.repeat(np.arange(n), np.diff(x.a_first))
            groups = np.bincount(doc[np.flatnonzero(np.diff(x.a_group, prepend=-1))], minlength=n)
            owner = doc[x.link_a]
            key, times = np.unique(owner * span + x.b[x.link_b] * len(enc.a_bytes) + x.a[x.link_a], return_counts=True)
            cut = np.searchsorted(key, np.arange(n + 1) * span)
            key %= span
            pairs, often = [], []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                pairs.append(np.diff(key[s:e], prepend=0).astype(np.uint64 if span >> 32 else np.uint32).tobytes())
                often.append(times[s:e].astype(np.uint32).tobytes())
            digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled(x, enc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(x.a_first)), pa.array(np.diff(x.b_first)), pa.array(groups), pa.array(np.bincount(owner, minlength=n)), pa.array(digest, pa.string()), pa.array(pairs, pa.binary()), pa.array(often, pa.binary())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def _pairs(batch: pa.RecordBatch, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored pairs of a batch of rows: where each row's begin, pair and times."""
    raw, often = (batch.column(c).to_pylist() for c in ("pairs", "times"))
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in often], out=first[1:])
    step = np.frombuffer(b"".join(raw), np.uint64 if wide else np.uint32).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(step)])
    return first, total[1:] - np.repeat(total[first[:-1]], np.diff(first)), np.frombuffer(b"".join(often), np.uint32).astype(np.int64)


def _summed(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_p, held_n = np.array([], np.int64), np.array([], np.int64)
        for batch in batches:
            _, pair, times = _pairs(batch, wide)
            pair, at = np.unique(np.concatenate([held_p, pair]), return_inverse=True)
            held_p, held_n = pair, np.bincount(at, np.concatenate([held_n, times]), len(pair)).astype(np.int64)
            if len(held_p) > SUMS:
                yield pa.RecordBatch.from_arrays([pa.array(held_p), pa.array(held_n)], ["pair", "n"])
                held_p, held_n = held_p[:0], held_n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held_p), pa.array(held_n)], ["pair", "n"])

    return run


def store(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Every row's tokens aligned and stored: key (of the row), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct id pairs with their times."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = staging_path(spark, "aligned")
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("__text")).mapInArrow(_store(a_path, b_path), f"doc_id {kind}, {_ROW}")
    rows.withColumn("key", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pair_counts(stored: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, pair, n, best): links of every id pair, and whether no pair of its B id has more."""
    spark = stored.sparkSession
    enc = encoders(a_path, b_path)
    width = len(enc.a_bytes)
    sums = stored.select("pairs", "times").mapInArrow(_summed(width * len(enc.b_bytes) >> 32 > 0), "pair bigint, n bigint")
    path = staging_path(spark, "pairs")
    sums.groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(path)
    counts = spark.read.parquet(path).withColumn("b_id", F.floor(F.col("pair") / width).cast("long"))
    top = counts.groupBy("b_id").agg(F.max("n").alias("top"))  # a row for each B id at most
    counts = counts.join(F.broadcast(top) if len(enc.b_bytes) <= HEAD else top, "b_id")
    return counts.select((F.col("pair") % width).alias("a_id"), "b_id", "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _looked_up(known, wide: bool, tail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = known.value
        for batch in batches:
            first, pair, times = _pairs(batch, wide)
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            if tail:
                miss = ~hit
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[miss])), pa.array(pair[miss]), pa.array(times[miss])], ["key", "pair", "times"])
                continue
            sums = []
            for value in (best, count):
                each = np.concatenate([[0], np.cumsum(np.where(hit, value[at] * times, 0) if len(pairs) else times * 0)])
                sums.append(pa.array(each[first[1:]] - each[first[:-1]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *sums],
                                             ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return run


def scored(stored: DataFrame, counts: DataFrame, a_path: str, b_path: str, head: int = HEAD) -> DataFrame:
    """The stored rows with n_best (links whose pair is a best one) and count_sum (over links)."""
    spark = stored.sparkSession
    enc = encoders(a_path, b_path)
    wide = len(enc.a_bytes) * len(enc.b_bytes) >> 32 > 0
    kind = stored.schema["doc_id"].dataType.simpleString()
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    levels = sorted(((r["level"], r["pairs"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()), reverse=True)  # 64 rows at most
    least, room = 64, head
    for at, n in levels:
        if n > room:
            break
        least, room = at, room - n
    top = counts.where(level >= least).select("pair", "n", "best").toPandas().sort_values("pair")  # ``head`` rows at most
    known = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool).astype(np.int64)))
    plain = "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
    rows = stored.mapInArrow(_looked_up(known, wide, False), f"key bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    if levels and least > levels[-1][0]:
        rare = stored.select("key", "pairs", "times").mapInArrow(_looked_up(known, wide, True), "key bigint, pair bigint, times bigint").join(counts.where(level < least).select("pair", "n", "best"), "pair")
        rare = rare.groupBy("key").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
        rows = rows.join(rare, "key", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return rows.select(*plain, "n_best", "count_sum")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of ``docs``."""
    rows = store(docs, a_path, b_path, text)
    return scored(rows, pair_counts(rows, a_path, b_path), a_path, b_path, head)


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """A row for each group of every text: doc_id, group (its number in the text), start and stop
    (bytes behind the space that was put in front; the first group starts at 0 or before it, at -1),
    a and b (token ids)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(a_path, b_path)
        for batch, texts in text_batches(batches, "__text"):
            x = coalesce(*enc.encode(texts), enc.a_size, enc.b_size)
            doc = np.repeat(np.arange(len(texts)), np.diff(x.a_first))
            a_at, b_at = (np.flatnonzero(np.diff(g, prepend=-1)) for g in (x.a_group, x.b_group))
            own = doc[a_at]
            stop = x.a_end[np.append(a_at[1:], len(x.a)) - 1] if len(x.a) else x.a_end
            start = np.concatenate([[0], stop[:-1]])[: len(stop)]
            opens = np.flatnonzero(np.diff(own, prepend=-1))
            lead = np.repeat(opens, np.diff(np.append(opens, len(own))))
            base = start[lead] + 1
            lists = [pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids)) for at, ids in ((a_at, x.a), (b_at, x.b))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), pa.array(np.arange(len(own)) - lead), pa.array(start - base), pa.array(stop - base), *lists], ["doc_id", "group", "start", "stop", "a", "b"])

    return docs.select("doc_id", F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"doc_id {kind}, group bigint, start bigint, stop bigint, a array<bigint>, b array<bigint>")
