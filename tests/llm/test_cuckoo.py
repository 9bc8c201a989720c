import hashlib
import random
from collections import defaultdict

from colloquy.llm import cuckoo
from colloquy.session import staging_path

SPACES = " \t\n\v\f\r"


def norm(t):
    return "".join(c for c in t or "" if c not in SPACES)


def brute(rows):
    """doc_id, keep_id, group size, kept, hash; of rows alike in all that counts any one may stay."""
    by = defaultdict(list)
    for i, (doc_id, t) in enumerate(rows):
        by[norm(t)].append((-len(t or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for k, members in by.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(k.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(draw, n, words):
    rows = []
    for _ in range(n):
        t = "".join(draw.choice(words) + draw.choice(["", " ", "\t", "\v\n"]) for _ in range(draw.randint(0, 2)))
        rows.append((draw.choice([None, draw.randint(0, 300)]) if draw.random() < 0.1 else draw.randint(0, 300), draw.choice([None, ""]) if draw.random() < 0.03 else t))
    return rows


def test_filter_takes_and_gives():
    draw = random.Random(1)
    keys = [draw.getrandbits(64) for _ in range(5000)]
    f, bits = cuckoo.Filter(11), 11
    assert all(f.add(k) for k in keys) and all(k in f for k in keys)  # 61 % full
    assert sum(draw.getrandbits(64) in f for _ in range(20000)) < 20
    for k in keys[::2]:
        f.remove(k)
    assert all(k in f for k in keys[1::2]) and sum(k in f for k in keys[::2]) < 10
    assert all(k in cuckoo.Filter(bits, f.slots.tobytes()) for k in keys[1::2])
    small = cuckoo.Filter(2)
    assert not all(small.add(k) for k in keys[:17])  # 16 slots


def test_inserts_deletes_and_lookups_equal_brute_force(spark):
    """Digests of one byte make most hits false or shared; small parts are dealt anew."""
    for digest_bytes, part_keys in ((8, 1 << 16), (1, 20)):
        draw = random.Random(digest_bytes)
        words = ["".join(draw.choice("abé日") for _ in range(draw.randint(1, 5))) for _ in range(60)]
        index = cuckoo.Index(spark, staging_path(spark, "cuckoo"), digest_bytes=digest_bytes, part_keys=part_keys)
        live: list = []
        for step in range(5):
            new = corpus(draw, 150, words)
            index.insert(spark.createDataFrame([(*r, 1, "k") for r in new], "doc_id long, text string, n int, sha string").repartition(3))
            live += new
            assert got(index.groups()) == brute(live)
            gone = draw.sample(live, 60) + corpus(draw, 20, words)
            index.delete(spark.createDataFrame(gone, "doc_id long, text string"))
            keys = {(i, norm(t)) for i, t in gone}
            live = [r for r in live if (r[0], norm(r[1])) not in keys]
            assert got(index.groups()) == brute(live)
            index = cuckoo.Index(spark, index.path)  # opened anew
        asked = corpus(draw, 100, words + ["other"])
        size = {(r[4], r[2]) for r in brute(live)}
        size = dict(size)
        want = sorted(((i, h := hashlib.sha256(norm(t).encode()).hexdigest(), size.get(h, 0)) for i, t in asked), key=repr)
        assert got(index.lookup(spark.createDataFrame(asked, "doc_id long, text string")).drop("keep_id")) == want
        if part_keys < 100:
            assert index.parts > 1
        # the filters hold the live digests and no others
        state = [r for r in index.state().collect()]
        digests = {r.sha[:digest_bytes] for r in state if r.kind == 1}
        filters = [cuckoo.Filter(r.bits, bytes(r.slots)) for r in state if r.kind == 0]
        parts = {(r.part, r.sha[:digest_bytes]) for r in state if r.kind == 1}
        assert digests and sum(sum(x != 0 for x in f.slots) for f in filters) == len(parts)


def test_overflow_resizes_from_stored_keys():
    part = cuckoo.Part()
    part.fill(cuckoo.LEAST_BITS)
    for i in range(3000):
        part.insert(hashlib.sha256(str(i).encode()).digest(), 1, (1, i, 1, i))
    assert part.resized >= 3 and len(part.content) == 3000
    assert all(d in part.filter for d in part.content)


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b"), (None, "ab"), (5, "x" * 3_000_000), (6, "x " * 3_000_000), (7, "z"), (7, "z"), (8, " z")]
    docs = spark.createDataFrame([(*r, 3, "c") for r in rows], "doc_id long, text string, n long, keep_id string")
    assert got(cuckoo.groups(docs, staging_path(spark, "cuckoo"))) == brute(rows)
    assert got(cuckoo.groups(docs.limit(0), staging_path(spark, "cuckoo"))) == []
    named = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in cuckoo.groups(named, staging_path(spark, "cuckoo")).collect()} == {("b", "a", False), ("a", "a", True), (None, "a", False)}
