import hashlib
import random
from collections import Counter

import pytest

from colloquy.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, x in zip(t, gone) if not x)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(left).hexdigest(), left))
    return out


def corpus(seed):
    draw = random.Random(seed)
    chars = lambda n, al="abcdefgh é\n\x00": "".join(draw.choice(al) for _ in range(n))
    base, passage, texts = chars(300), chars(70), []
    for _ in range(120):
        k = draw.randint(0, 6)
        if k == 0:
            t = chars(draw.randint(0, 200))
        elif k == 1:
            t = base
        elif k == 2:
            b = list(base)
            for _ in range(draw.randint(1, 6)):
                b[draw.randrange(len(b))] = draw.choice("abcdefgh")
            t = "".join(b)
        elif k == 3:
            t = chars(draw.randint(0, 80)) + passage + chars(draw.randint(0, 80))
        elif k == 4:
            t = "a" * draw.randint(0, 150)
        elif k == 5:
            t = chars(50) * 3
        else:
            t = chars(30) + base[draw.randint(0, 100) : draw.randint(100, 300)]
        texts.append(t)
    return texts


@pytest.mark.parametrize("length,gram,hot,chunk,block", [(40, 8, 1000, 1 << 20, 2048), (40, 8, 3, 100, 10), (100, 20, 2, 1 << 20, 1)])
def test_equals_brute_force(spark, monkeypatch, length, gram, hot, chunk, block):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "BLOCK", block)
    texts = corpus(length + hot)
    rows = list(enumerate(texts)) + [(None, None), (3, ""), (None, texts[1]), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_bytes int, key string").repartition(6)
    got = S.remove(docs, length=length, gram=gram, hot=hot).collect()
    want = brute([t for _, t in rows], length)
    key = lambda r: repr((r[0], r[1], r[2], r[4]))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove(docs).collect()}
    assert got == {1: (5, 0, 0), 2: (0, 0, 0)}
    assert S.remove(docs.limit(0)).collect() == []


def test_a_long_text_that_repeats_itself(spark):
    draw = random.Random(1)
    part = "".join(draw.choice("abcdefghijklmnop ") for _ in range(3000))
    text = part + "".join(draw.choice("qrst ") for _ in range(1500)) + part
    r = S.remove(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_removed, r.n_spans) == (6000, 2)
