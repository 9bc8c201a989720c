import random

import numpy as np

from colloquy.llm import decontaminate as D


def table(a, t):
    """Edit distance of a to the nearest stretch of t."""
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_least_edits():
    draw = random.Random(3)
    for _ in range(400):
        a = [draw.randint(0, 5) for _ in range(draw.randint(1, 70))]
        t = [draw.randint(0, 5) for _ in range(draw.randint(0, 60))]
        d, end = D.least_edits(a, t)
        assert d == table(a, t)
        assert table(a, t[:end]) == d


def test_recall_and_exactness(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 6)))
    items = [[word() for _ in range(draw.randint(8, 60))] for _ in range(40)]
    docs, within = [], set()
    for i in range(400):
        ws = [word() for _ in range(draw.randint(0, 200))]
        if i % 2:
            k = draw.randrange(len(items))
            body = list(items[k])
            for _ in range(draw.randint(0, D.edits(len(body)) + 1)):
                at = draw.randrange(len(body))
                body[at : at + draw.choice([0, 1, 1])] = draw.choice([[], [word()], [word()]])
            at = draw.randint(0, len(ws))
            ws[at:at] = body
        docs.append((i, ws))
        for k, item in enumerate(items):
            if table(item, ws) <= D.edits(len(item)):
                within.add((i, k))
    shout = lambda ws: ", ".join(w.upper() if j % 3 else w for j, w in enumerate(ws))
    d = spark.createDataFrame([(i, shout(ws), 1) for i, ws in docs], "doc_id long, text string, key int")
    b = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.hits(d, b).collect()}
    assert set(got) <= within and len(within) > 100
    assert len(got) >= 0.95 * len(within)
    for (i, k), r in got.items():
        assert r.distance == table(items[k], docs[i][1]) == table(items[k], docs[i][1][r.first_word : r.end_word])


def test_hard_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, "x " * 50000 + item.upper()), (5, item[:20])]
    d = spark.createDataFrame([(*r, 0, "q") for r in docs], "doc_id long, text string, item_id int, start string")
    b = spark.createDataFrame([(1, item), (1, "short"), (2, None), (None, ""), (3, "too short to tell")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.hits(d, b).collect()), key=repr)
    assert got == sorted([(None, 1, 0), (3, 1, 0), (4, 1, 0)], key=repr)
    left = D.clean(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert D.hits(d.limit(0), b).collect() == [] and D.hits(d, b.limit(0)).collect() == []


def mutated_items(spark, sizes, each):
    """Items of the sizes, and documents that hold a copy of one with as many edits as allowed."""
    draw = np.random.Generator(np.random.PCG64(5))
    some = lambda n: draw.integers(0, 1 << 40, n, dtype=np.uint64)
    items = {(m, i): some(m) for m in sizes for i in range(each)}
    text = lambda ws: " ".join(map(str, ws.tolist()))
    docs = [(m * 1000 + i, text(np.concatenate([some(150), D.mutated(x, draw), some(150)]))) for (m, i), x in items.items()]
    b = [(m * 1000 + i, text(x)) for (m, i), x in items.items()]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")


def test_recall_by_length(spark):
    sizes, each = [8, 20, 40, 59, 62, 100, 200, 400, 1000], 40
    docs, items = mutated_items(spark, sizes, each)
    text = {r[0]: r[1].split() for r in docs.collect()}
    item = {r[0]: r[1].split() for r in items.collect()}
    got = D.hits(docs, items).collect()
    for m in sizes:
        assert sum(r.item_id // 1000 == m for r in got) >= 0.93 * each, m
    for r in got:
        assert r.doc_id == r.item_id
        if r.item_id % 1000 == 0 and r.item_id < 300_000:
            assert r.distance == table(item[r.item_id], text[r.doc_id]) == table(item[r.item_id], text[r.doc_id][r.first_word : r.end_word])


def test_class_short_of_the_target_uses_triples(spark, monkeypatch):
    monkeypatch.setattr(D, "TARGET", 2)
    assert D.plan_samples(6, [np.arange(6, dtype=np.uint64)]) == 0
    docs, items = mutated_items(spark, [6, 8, 11, 17, 28, 47, 61, 62, 130, 300], 30)
    assert sorted(r.item_id for r in D.hits(docs, items).collect()) == sorted(r.item_id for r in items.collect())


def test_items_without_id(spark):
    draw = random.Random(2)
    items = [[f"w{draw.randrange(10**6)}" for _ in range(20)] for _ in range(3)]
    d = spark.createDataFrame([(i, "before " + " ".join(ws) + " after") for i, ws in enumerate(items)] + [(9, "clean text")], "doc_id long, text string")
    b = spark.createDataFrame([(None, " ".join(items[0])), (None, " ".join(items[1])), (1, " ".join(items[2])), (1, " ".join(items[0]))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.hits(d, b).collect()), key=repr)
    assert got == sorted([(0, None, 0), (0, 1, 0), (1, None, 0), (2, 1, 0)], key=repr)
    assert [r.doc_id for r in D.clean(d, b).collect()] == [9]


def test_short_items_are_found_verbatim(spark):
    docs = [(1, "well, Who wrote Hamlet? he asked; who wrote hamlet"), (2, "who wrote a hamlet"), (3, "who wrote"), (None, "what is two plus two"), (4, ""), (5, "hamlet")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "what is two plus two"), (3, "hamlet"), (None, "wrote a"), (4, "?")], "item_id long, text string")
    got = sorted((tuple(r)[1:] for r in D.hits(d, b).collect()), key=repr)
    assert got == sorted([(1, 1, 0, 1, 4), (None, 2, 0, 0, 5), (1, 3, 0, 3, 4), (2, 3, 0, 3, 4), (5, 3, 0, 0, 1), (2, None, 0, 1, 3)], key=repr)
    assert sorted(r.doc_id for r in D.clean(d, b).collect()) == [3, 4]
