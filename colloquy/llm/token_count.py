"""Token counts with the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges bytes inside each of them.  Once, on
the driver, the vocabulary strings that encode alone as exactly one token are proved; a
pre-token found there counts one.  Only the distinct other pre-tokens go through the library's
merges.  The proved set is bounded by the vocabulary (about 50,000 strings).

The split follows the tokenizer's own pattern.  Code points on which the regular-expression
library and the tokenizer may disagree (``unsure``: unassigned in Python's Unicode tables, so
their class depends on a library's version) send their whole text through the tokenizer.

Null and empty texts count 0; texts of any length are handled whole; repeated rows and null ids
stay rows of their own; an empty table gives an empty result; other columns, clashing names included,
are not carried.  A tokenizer file with another split, or with a normaliser, is refused.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import prepare, text_batches

#: Fixed value: the byte-level pattern of the public vocabulary files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct merged pre-tokens that a task remembers before it starts anew.
CACHE = 500_000


def whole_tokens(path: str) -> frozenset[str]:
    """The proof: vocabulary strings that the tokenizer encodes as one token, that one."""
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only byte-level files with the standard split and without a normaliser are read")
    ids = [i for s, i in tok.get_vocab(with_added_tokens=False).items()]
    special = set(tok.get_added_tokens_decoder())
    texts = [(i, tok.decode([i], skip_special_tokens=False)) for i in ids if i not in special]
    texts = [(i, t) for i, t in texts if t and "�" not in t]
    found = tok.encode_batch([t for _, t in texts], add_special_tokens=False)
    return frozenset(t for (i, t), e in zip(texts, found) if e.ids == [i] and regex.fullmatch(PATTERN, t))


def unsure() -> np.ndarray:
    """By code point: whether it is unassigned in the tables that Python ships."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


class Counter:
    """Counts the tokens of texts as the tokenizer in ``path`` does."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok = Tokenizer.from_file(path)
        self.whole, self.cost = whole, dict.fromkeys(whole, 1)
        self.find = regex.compile(PATTERN).findall
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.odd = unsure()

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cost) > len(self.whole) + CACHE:
            self.cost = dict.fromkeys(self.whole, 1)
        out: list[int] = []
        for t in texts:
            if not t.isascii() and self.odd[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any():
                out.append(len(self.tok.encode(t, add_special_tokens=False).ids))
                continue
            parts = self.special.split(t) if self.special else [t]
            n = len(parts) - 1  # special strings inside the text, one token each
            for part in parts:
                pieces = self.find(part)
                new = list(set(pieces).difference(self.cost))
                if new:
                    self.cost.update(zip(new, (len(e.ids) for e in self.tok.encode_batch(new, add_special_tokens=False))))
                n += sum(map(self.cost.__getitem__, pieces))
            out.append(n)
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    known = spark.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = Counter(path, known.value)
        for batch, texts in text_batches(batches, "__text"):
            n = counter.count([t.decode("utf-8", "replace") for t in texts])
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select("doc_id", F.col(f"`{text}`").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
