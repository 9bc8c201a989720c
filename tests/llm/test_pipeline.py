"""The pipeline's stages against plain versions of them, on a small folder of tables."""

import random
from collections import Counter

import corpus_pipeline as P
from colloquy.llm import decontaminate as D, mixing, sharding

from .test_decontaminate import table
from .test_jaccard import brute
from .test_quality import WORD, plain


def sample():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(2, 7)))
    items = [[word() for _ in range(draw.randint(20, 40))] for _ in range(6)]
    docs = []
    for i in range(160):
        ws = [word() for _ in range(draw.randint(5, 90))]
        if i % 10 == 1:
            ws = docs[-1][1].split() + [word()]
        if i % 10 == 2:
            ws[3:3] = draw.choice(items)
        if i % 10 == 3:
            ws = ws[:1] * 40
        docs.append((i, " ".join(ws), "en", f"s{i % 4 if i % 3 else 0}", 1))
    docs += [(300, None, None, None, None), (301, "", "en", "s0", 0), docs[5], (302, docs[6][1], "de", None, 2), (None, " ".join(word() for _ in range(30)), "en", None, 1)]
    return docs, items


def quality(docs):
    out = []
    for d in docs:
        n, chars, symbols, dup, repeat = plain(d[1])
        ws = WORD.findall(d[1] or "")
        lines = sum(bool(WORD.search(x)) for x in (d[1] or "").split("\n"))
        stutter = sum(a == b for a, b in zip(ws, ws[1:]))
        bad = n < 20 or 100 * repeat > 30 * n or 10 * symbols > n or (dup >= 4 and 10 * dup > 3 * lines) or chars < 2 * n or chars > 15 * n or 10 * stutter > 3 * n
        out += [] if bad else [d]
    return out


def test_stages(spark, tmpdir_path):
    docs, items = sample()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    stages = dict(P.STAGES)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    take = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    one = quality(docs)
    assert take(stages["quality_rules"](spark, frame(docs), tmpdir_path)) == sorted(one, key=repr)

    known = [d for d in dict.fromkeys(one) if d[0] is not None]
    classes = {d: c for d, _, c in brute([d[:2] for d in known], 5, 4, 5)}
    two = [d for d in known if classes[d[0]] == d[0]] + [d for d in one if d[0] is None]
    assert take(stages["near_duplicates"](spark, frame(one), tmpdir_path)) == sorted(two, key=repr)
    assert len(two) < len(one) < len(docs)

    three = [d for d in two if not any(table(i, d[1].split()) <= D.edits(len(i)) for i in items)]
    assert take(stages["decontamination"](spark, frame(two), tmpdir_path)) == sorted(three, key=repr)
    assert len(three) < len(two)

    mixed = take(stages["source_mix"](spark, frame(three), tmpdir_path))
    sizes = Counter()
    for d in three:
        sizes[d[3]] += len(d[1].split())
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    got = Counter()
    for d in mixed:
        got[d[3]] += len(d[1].split())
    assert set(mixed) <= set(three) and all(abs(got[s] - t) <= 60 for s, t in targets.items())
    assert max(Counter(mixed).values()) <= 3

    final = P.run(spark, tmpdir_path)
    assert final.columns == [*schema.replace(",", "").split()[::2], "slot", "shard"]
    assert sorted((tuple(r)[:5] for r in final.collect()), key=repr) == mixed
    lut = sharding.lookup()
    assert all(lut[r.slot] == r.shard for r in final.collect())


def test_empty_tables(spark, tmpdir_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    assert P.run(spark, tmpdir_path).collect() == []


def test_clashing_names_and_a_long_text(spark, tmpdir_path):
    """Columns named like those that the stages add on the way stay as they are; all but slot and
    shard, which the last stage replaces."""
    draw = random.Random(1)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    names = ["__key", "__row", "__mix_key", "key", "size", "slot", "shard", "class", "one", "n", "taken", "found"]
    rows = [(i, words(40 if i else 60_000), "en", "s", 1, *[f"{c}{i}" for c in names]) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(1, words(30))], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    got = P.run(spark, tmpdir_path).collect()
    assert {r.doc_id for r in got} == set(range(12))
    for r in got:
        assert r.text == rows[r.doc_id][1] and all(r[c] == f"{c}{r.doc_id}" for c in names if c not in ("slot", "shard"))
        assert isinstance(r.slot, int) and isinstance(r.shard, int)
