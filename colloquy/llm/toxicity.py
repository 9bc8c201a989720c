"""Toxicity by multiple-instance learning.

Only documents are labelled, sentences are not.  A sentence's chance of being toxic is a
logistic function of its features; a document's is the noisy-or of its sentences',
1 - prod(1 - p).  Training maximises the likelihood of the document labels, and the gradient
reaches the sentences that explain them, so the fitted model also locates them.

Features are hashes of lower-cased words and of their first 3 to 6 bytes.  ``select`` keeps the
``FEATURES`` whose documents are most clearly toxic; the rest say nothing for toxicity and weigh
nothing.  Training uses a sample bounded by ``SAMPLE`` labelled documents of each class, the
ones with the smallest hash of their id; each class is weighed up to its full count, so scores
stay calibrated.  Documents whose ids a condition holds out are never read in training.
Features come from the text alone.

Null and empty texts have no sentence and score 0.  Texts are scored whole, whatever their
length.  Repeated rows and null ids are scored like others; a document labelled twice counts as
toxic if either label says so; null labels are ignored.  Without toxic or without clean labels
every score is 0.  An empty table gives an empty result.  Other columns, clashing names included, are
not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare, text_batches
from .words import mix, prefix_hash, slice_hash

#: Labelled documents of each class that training reads at most.
SAMPLE = 10_000
#: Features that a model has at most.
FEATURES = 8192
#: Prefix lengths (bytes) that are features beside the whole word.
PREFIXES = (3, 4, 5, 6)
#: A sentence that is at least this likely is located as offending.
OFFENDING = 0.3
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_U = np.uint64


@dataclass
class Sentences:
    """Sentences of a batch of texts: their text, byte span in it, and features by sentence."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feature: np.ndarray
    owner: np.ndarray  # sentence of each feature


def sentences(texts: list[bytes]) -> Sentences:
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = _LETTER[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    number = np.cumsum(_END[buf])[start] if len(start) else start
    new = np.ones(len(start), bool)
    new[1:] = number[1:] != number[:-1]
    owner = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    text = np.searchsorted(base, start[first], "right") - 1
    stop = end[np.append(first[1:], len(start)) - 1] if len(first) else first
    h = prefix_hash(buf)
    feats, owners = [slice_hash(h, start, end)], [owner]
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        feats.append(mix(slice_hash(h, start[long], start[long] + k) + _U(1)))
        owners.append(owner[long])
    return Sentences(text, start[first] - base[text], stop - base[text], np.concatenate(feats), np.concatenate(owners))


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def chances(self, s: Sentences) -> np.ndarray:
        """Every sentence's chance of being toxic; a feature counts once in a sentence."""
        z = np.full(len(s.text), self.bias)
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, s.feature), len(self.features) - 1)
            hit = self.features[at] == s.feature
            pair = np.unique(s.owner[hit].astype(np.int64) * len(self.features) + at[hit])
            np.add.at(z, pair // len(self.features), self.weights[pair % len(self.features)])
        return 1 / (1 + np.exp(-z))


def noisy_or(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fit(docs: list[tuple[int, float, list[list[int]], int]], start: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """docs: (label, weight, feature numbers of each sentence that has any, number of sentences).
    Full-batch gradient ascent from ``start`` with per-coordinate step sizes (AdaGrad)."""
    y = np.array([d[0] for d in docs], float)
    weight = np.array([d[1] for d in docs], float)
    weight /= weight.sum()
    some = [(i, fs) for i, d in enumerate(docs) for fs in d[2]]
    doc = np.array([i for i, _ in some], np.int64)
    feature = np.array([f for _, fs in some for f in fs], np.int64)
    owner = np.repeat(np.arange(len(some)), [len(fs) for _, fs in some])
    plain = np.array([d[3] - len(d[2]) for d in docs], float)  # sentences without features
    size = len(start)
    w, b = start.copy(), -6.0
    gw, gb = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(owner, w[feature], len(some))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs)) + plain * np.log1p(-p0)
        toxic = -np.expm1(clean)
        # d log-likelihood / d z of a sentence: p * (1 - P) / P in toxic documents, -p in clean ones
        pull = weight * np.where(y > 0, np.exp(clean) / np.maximum(toxic, 1e-12), -1.0)
        dz = pull[doc] * p
        dw = np.bincount(feature, dz[owner], size) - decay * (w - start) / len(docs)
        db = dz.sum() + (pull * plain).sum() * p0
        gw += dw * dw
        gb += db * db
        w = np.maximum(0, w + rate * dw / np.sqrt(gw))  # a feature can speak for toxicity only
        b += rate * db / np.sqrt(gb)
    return w, b


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, clean documents), summed over each batch."""
    for batch, texts in text_batches(batches):
        s = sentences(texts)
        y = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), np.int64)
        f, inverse = np.unique(s.feature, return_inverse=True)
        pair = np.unique(inverse.astype(np.int64) * len(texts) + s.text[s.owner])
        toxic = np.bincount(pair // len(texts), y[pair % len(texts)], len(f)).astype(np.int64)
        every = np.bincount(pair // len(texts), minlength=len(f))
        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], ["feature", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """``labels``: doc_id, toxic.  ``usable``: condition on doc_id."""
    prepare(docs.sparkSession)
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    empty = Model(np.array([], np.uint64), np.array([]), -40.0)
    if len(counts) < 2:
        return empty
    order = (F.xxhash64("doc_id", F.lit(7)), F.col("doc_id"))
    picked = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    # at most 2 * sample ids, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").checkpoint()
    found = rows.mapInArrow(_count, "feature bigint, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    drawn = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if len(drawn) < 2:
        return empty
    odds = F.log((F.col("t") + 0.1) / (drawn[1] + 0.2)) - F.log((F.col("c") + 0.1) / (drawn[0] + 0.2))
    best = found.withColumn("odds", odds).where("t >= 3 AND odds > 1.5").orderBy((F.col("odds") * F.sqrt("t")).desc(), "feature").limit(FEATURES)
    kept = best.select("feature", "t", "c").collect()  # bounded by FEATURES
    if not kept:
        return empty
    features = np.array([r["feature"] for r in kept], np.int64).view(np.uint64)
    by = np.argsort(features)
    features = features[by]
    # half the smoothed log odds, as a word mostly brings its prefixes along
    start = np.array([0.5 * math.log((r["t"] + 0.5) / (r["c"] + 0.5) * (drawn[0] + 1) / (drawn[1] + 1)) for r in kept])[by]
    send = docs.sparkSession.sparkContext.broadcast(features)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: its sentences' kept features, sentences one after another behind -1."""
        known = send.value
        for batch, texts in text_batches(batches):
            s = sentences(texts)
            at = np.minimum(np.searchsorted(known, s.feature), len(known) - 1)
            hit = known[at] == s.feature
            pair = np.unique(s.owner[hit].astype(np.int64) * len(known) + at[hit])
            out: list[list[int]] = [[] for _ in texts]
            prev = -1
            for owner, f in zip((pair // len(known)).tolist(), (pair % len(known)).tolist()):
                if owner != prev:
                    out[s.text[owner]].append(-1)
                    prev = owner
                out[s.text[owner]].append(f)
            n = np.bincount(s.text, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n), pa.array(out, pa.list_(pa.int32()))], ["toxic", "n", "code"])

    docs_in = []
    for r in rows.mapInArrow(encode, "toxic int, n bigint, code array<int>").collect():  # bounded by the sample
        parts: list[list[int]] = []
        for f in r["code"]:
            parts.append([]) if f < 0 else parts[-1].append(f)
        docs_in.append((r["toxic"], counts[r["toxic"]] / drawn[r["toxic"]], parts, r["n"]))
    w, b = fit(docs_in, start)
    use = w > 0
    return Model(features[use], w[use], b)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences and ``offending``: start and end byte, chance and
    text of the sentences that are toxic by themselves."""
    prepare(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    where = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            s = sentences(texts)
            p = send.value.chances(s)
            total = noisy_or(p, s.text, len(texts))
            spans: list[list] = [[] for _ in texts]
            for i in np.flatnonzero(p >= OFFENDING).tolist():
                t, a, z = s.text[i], int(s.start[i]), int(s.end[i])
                spans[t].append({"start": a, "end": z, "chance": float(p[i]), "text": texts[t][a:z].decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total), pa.array(np.bincount(s.text, minlength=len(texts))), pa.array(spans, where)], ["doc_id", "score", "n_sentences", "offending"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_sentences bigint, offending array<struct<start:int,end:int,chance:double,text:string>>")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out())
    return score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted", "n_sentences", "offending")
