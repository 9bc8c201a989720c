import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import toxicity as T


def test_held_out_accuracy_and_places(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").cache()
    right = got.where("toxic = 1 AND predicted = 1").count()
    assert right >= 0.85 * got.where("toxic = 1").count()
    assert got.where("toxic = 0 AND predicted = 1").count() <= 0.03 * got.where("toxic = 0").count()
    located = got.where("predicted = 1").select("doc_id", F.explode("offending").alias("o")).join(docs, "doc_id").where("length(text) < 3000").limit(30).collect()
    assert located and all(r.text.encode()[r.o.start : r.o.end].decode() == r.o.text for r in located)


def test_training_reads_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, f"plain text {i}. " + ("awful word. " if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, T.scored(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b
    found = T.scored(docs, labels).where("predicted = 1").select("doc_id", "offending").collect()
    assert {r.doc_id for r in found} == {i for i in range(300) if i % 3 == 0}
    assert {o.text for r in found for o in r.offending} == {"awful word"}


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "bad words here", 5), (3, "x. " * 100000, 5), (3, "x", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = T.scored(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert T.scored(docs.limit(0), none).collect() == []


def plain_fit(docs, start, rounds, rate, decay):
    """The noisy-or likelihood's ascent in loops over documents and their sentences."""
    total = sum(d[1] for d in docs)
    w, b = list(start), -6.0
    gw, gb = [1e-8] * len(w), 1e-8
    for _ in range(rounds):
        dw, db = [-decay * (w[i] - start[i]) / len(docs) for i in range(len(w))], 0.0
        for y, weight, parts, n in docs:
            chances = [1 / (1 + math.exp(-(b + sum(w[f] for f in fs)))) for fs in parts] + [1 / (1 + math.exp(-b))] * (n - len(parts))
            clean = math.prod(1 - p for p in chances)
            # the derivative of log P(label) by a sentence's log odds
            pull = weight / total * (clean / max(1 - clean, 1e-12) if y else -1.0)
            for p, fs in zip(chances, parts + [[]] * (n - len(parts))):
                for f in fs:
                    dw[f] += pull * p
                db += pull * p
        for i in range(len(w)):
            gw[i] += dw[i] ** 2
            w[i] = max(0.0, w[i] + rate * dw[i] / math.sqrt(gw[i]))
        gb += db * db
        b += rate * db / math.sqrt(gb)
    return w, b


def test_training_equals_plain_loops():
    draw = random.Random(3)
    for _ in range(5):
        docs = []
        for i in range(25):
            parts = [sorted(draw.sample(range(12), draw.randint(1, 4))) for _ in range(draw.randint(0, 4))]
            docs.append((i % 2, draw.choice([1.0, 3.5]), parts, len(parts) + draw.randint(0, 3) + (not parts)))
        start = np.array([draw.random() for _ in range(12)])
        w, b = T.fit(docs, start, rounds=60)
        want, bias = plain_fit(docs, start.tolist(), 60, 0.1, 1e-2)
        assert w == pytest.approx(want, abs=1e-9) and b == pytest.approx(bias, abs=1e-9)


def test_scores_equal_plain_noisy_or(spark):
    """From text to score in plain Python, with the model that was trained."""
    docs = spark.createDataFrame([(i, f"Plain text {i}. Some more! " + ("Awful word here? " if i % 3 == 0 else "")) for i in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = T.train(docs, labels, F.lit(True))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    for r in T.score(docs, model).join(docs, "doc_id").collect():
        s = T.sentences([r.text.encode()])
        by = {}
        for f, owner in zip(s.feature.tolist(), s.owner.tolist()):
            by.setdefault(owner, set()).add(f)
        clean = math.prod(1 - 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in by.get(i, ()))))) for i in range(len(s.text)))
        assert r.score == pytest.approx(1 - clean, abs=1e-9)
