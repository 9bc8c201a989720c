import random

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import jaccard_tree as J
from colloquy.llm.components import components


def shingles(text, k):
    import re
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and den * c >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus(seed, n=300):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghijklmnopqrstuvwxyz") + draw.choice("abcdefgh")
    bases = [[word() for _ in range(draw.choice([4, 9, 12, 25, 60, 140]))] for _ in range(12)]
    out = []
    for i in range(n):
        ws = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
            at = draw.randrange(len(ws))
            ws[at : at + draw.choice([0, 1, 1])] = [word()]
        out.append((i + 1, draw.choice([" ", "\n"]).join(ws).title() if draw.random() < 0.2 else " ".join(ws)))
    return out


@pytest.mark.parametrize("k,num,den,leaves", [(3, 9, 10, J.LEAVES), (3, 9, 10, 400), (5, 4, 5, J.LEAVES), (2, 1, 2, 700)])
def test_classes_equal_brute_force(spark, k, num, den, leaves):
    rows = corpus(k * num) + [(1000, ""), (1001, " \n"), (1002, None), (1003, "two words"), (1004, "TWO words")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = [tuple(r) for r in J.classes(docs, k, num, den, leaves=leaves).collect()]
    assert len(got) == len(rows) and set(got) == brute(rows, k, num, den)


def test_hard_rows(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only null"), (8, long), (9, long + " x"), (5, "p q r s"), (5, "k l m n")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, component_id int, one string")
    got = sorted((tuple(r) for r in J.classes(docs, 3, 9, 10).collect()), key=repr)
    want = [(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (8, 19998, 8), (9, 19999, 8), (5, 2, 5), (5, 2, 5)]
    assert got == sorted(want, key=repr)
    assert J.classes(docs.limit(0)).collect() == []
    kept = J.keep_one(docs)
    assert kept.schema == docs.schema
    # id 7's class has one row, the text known by a null id alone stays, 9 goes
    assert sorted((r.doc_id, r.text[:3]) for r in kept.collect() if r.doc_id and r.doc_id > 5) == [(7, "a b"), (8, "w0 ")]


def test_shared_and_null_ids(spark):
    draw = random.Random(4)
    text = lambda: [f"w{draw.randrange(10**6)}" for _ in range(60)]
    a, b, c, d = (text() for _ in range(4))
    near = lambda ws: ws[:-1] + ["other"]
    rows = [(5, a), (5, b), (6, near(a)), (7, near(b)), (None, c), (None, near(c)), (None, c), (None, d), (8, near(d)), (9, text())]
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in J.classes(docs).collect() if r.doc_id)
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (9, 9)]
    assert sorted(str(r.component_id) for r in J.classes(docs).collect() if r.doc_id is None) == ["8", "None", "None", "None"]
    kept = [(r.doc_id, r.text) for r in J.keep_one(docs).collect()]
    # both texts of id 5 stay, of c and its near copy one
    assert sorted((i, t) for i, t in kept if i) == sorted([(5, " ".join(a)), (5, " ".join(b)), (8, " ".join(near(d))), (9, " ".join(rows[-1][1]))])
    assert [t for i, t in kept if i is None] in ([" ".join(c)], [" ".join(near(c))])


def keys_of(sets, t, slices, level):
    """The keys that the blocking gives each set."""
    name, own, rare, late = J.named(sets, slices, level)
    prefix = t.prefix(np.array([len(s) for s in sets], np.int64))
    rows = [(i, 0, int(prefix[i]), int(rare[i])) for i in range(len(sets))]
    rows += [(int(o), 1, int(x), int(n)) for x, o, n in zip(*J.shared(name, own))]
    rows += [(i, 2, int(x), 0) for i, s in enumerate(late) for x in J._key(s[: max(0, prefix[i] - rare[i])])]
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[2]))
    one, kind, what, n = (np.array(c, np.int64) for c in zip(*rows))
    found = [set() for _ in sets]
    for key, i in zip(*J.prefix_keys(one, kind, what, n)):
        found[i].add(int(key))
    return found


@pytest.mark.parametrize("num,den,slices", [(9, 10, 0), (4, 5, 5), (1, 2, 23)])
def test_prefixes_of_a_linked_pair_meet(num, den, slices):
    """Also where many shingles are very frequent, or share a name inside a set."""
    draw = np.random.Generator(np.random.PCG64(num))
    t = J.Threshold(num, den)
    met = 0
    for _ in range(60):
        pool = np.unique(draw.integers(0, 1 << 64, 300, dtype=np.uint64))
        if draw.random() < 0.3:  # few names
            pool = np.unique((pool & np.uint64(0xFF00000000000000)) | draw.integers(0, 1 << 12, len(pool), dtype=np.uint64))
        sets = []
        for _ in range(12):
            a = np.unique(draw.choice(pool, int(draw.integers(1, len(pool)))))
            sets.append(a)
            for _ in range(3):
                gone = int(draw.integers(0, len(a) // 4 + 1))
                sets.append(np.unique(np.concatenate([draw.permutation(a)[gone:], draw.integers(0, 1 << 64, int(draw.integers(0, len(a) // 5 + 1)), dtype=np.uint64)])))
        level = (draw.integers(1, 4, 64) * (draw.random(64) < draw.choice([0, 0.2, 0.9]))).astype(np.uint8)
        sets = [s for s in sets if len(s)]
        found = keys_of(sets, t, slices, level)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                c = len(np.intersect1d(a, b))
                if den * c >= num * (len(a) + len(b) - c) and len(np.union1d(a, b)) > c:
                    assert found[i] & found[j]
                    met += 1
    assert met > 200


@pytest.mark.parametrize("frequent,pack", [(8, 1 << 21), (0, 300)])
def test_a_large_group_of_near_copies(spark, monkeypatch, frequent, pack):
    """Many parts around a hub, some sets that only others link to it, and a passage in all documents."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "PACK", pack)
    monkeypatch.setattr(J, "COUNTERS", (6, 24))
    draw = random.Random(5)
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(8)]
    rows = []
    for i in range(400):
        ws = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            ws[draw.randrange(60)] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(ws + passage)))
    rows += [(1000 + i, " ".join([f"u{i}x{j}" for j in range(draw.randint(3, 30))] + passage)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [tuple(r) for r in J.classes(docs, 3, 9, 10, leaves=1500).collect()]
    assert len(got) == len(rows) and set(got) == brute(rows, 3, 9, 10)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = {x: x for p in links for x in p}
    for _ in range(500):
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_texts_without_near_copies_are_settled_early(spark, monkeypatch, k, num, den):
    """Their shingles are not counted in whole, and only the other texts are looked up."""
    seen, chains = [], J._chains
    monkeypatch.setattr(J, "_chains", lambda k, t, texts, *more: seen.append(texts.count()) or chains(k, t, texts, *more))
    draw = random.Random(k)
    passage = [f"p{i}" for i in range(12)]
    texts = [[f"w{draw.randrange(10**6)}" for _ in range(120)] + passage for _ in range(200)]
    texts += [ws[:-1] + ["other"] for ws in texts[:6]] + texts[6:10] + [ws[:3] for ws in texts[10:14]]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in J.classes(docs, k, num, den).collect()]
    assert len(got) == len(rows) and set(got) == brute(rows, k, num, den)
    assert 12 <= seen[0] <= 30


@pytest.mark.parametrize("bits", [(15, 15), (15, 26)])
def test_looked_up_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(J, "BITS", bits)
    draw = random.Random(1)
    keys = [draw.randrange(-(1 << 63), 1 << 63) for _ in range(6000)] + [0, -1, 32767, 32768, -(1 << 63)]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(keys + keys[:50])], "rep long, i int").repartition(3)
    wanted = keys[:3000] + keys[-5:] + keys[:10]
    got = sorted(tuple(r) for r in J._looked_up(rows, "rep", spark.createDataFrame([(x,) for x in wanted], "rep long")).collect())
    assert got == sorted((x, i) for i, x in enumerate(keys + keys[:50]) if x in set(wanted))
    assert J._looked_up(rows, "rep", spark.createDataFrame([], "rep long")).collect() == []


def test_lone_shingles_of_a_repeated_set_count_once():
    """Sets that several chunks hold, and an answer for every row."""
    draw = np.random.Generator(np.random.PCG64(3))
    sets = [np.unique(draw.integers(0, 1 << 64, 30, dtype=np.uint64)) for _ in range(6)]
    sets[1] = np.unique(np.concatenate([sets[0][:20], sets[1]]))
    one = J.set_keys(sets)[0]
    rows = []
    for chunk, has in enumerate([[0, 1, 2], [2, 3, 4], [2, 5], [2, 5]]):
        name, own, _, _ = J.named([sets[i] for i in has], 3, np.zeros(4, np.uint8))
        rows += [(chunk, *row) for row in zip(*J._dealt(one[has], name, own, 3))]
    rows.sort(key=lambda r: r[1])
    sent = pa.RecordBatch.from_pylist([dict(zip(("chunk", *J._SENT[:4]), r)) for r in rows])
    answers = list(J._lone(iter([sent.slice(0, 7), sent.slice(7)])))
    assert sum(b.num_rows for b in answers) == len(rows)
    back = sorted((r for b in answers for r in b.to_pylist()), key=lambda r: r["chunk"])
    got = [(r["set"], r["lone"]) for b in J._summed(iter([pa.RecordBatch.from_pylist(back)])) for r in b.to_pylist()]
    lone = {int(one[i]): len(s) - 20 * (i < 2) for i, s in enumerate(sets)}
    assert sorted(got) == sorted((int(one[i]), lone[int(one[i])]) for has in ([0, 1, 2], [2, 3, 4], [2, 5], [2, 5]) for i in has)
