import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache
from itertools import product

import pytest

from colloquy.llm import repair as R

SPACES = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def brute(rows, ids):
    """A plain search over positions and last initials that carries whole audits."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        by[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = []
    for conv in ids:
        lines, seen, faults = [x[2:] for x in sorted(by[conv])], set(), []
        for role, _, text in lines:
            shown = "".join(c for c in text if c not in SPACES)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        nexts = {"": "u", "s": "u", "a": "u", "u": "a"}

        @cache
        def best(i, last, inserted=0):
            found = [(0, "", ())] if i == len(lines) and last in ("", "a") else []
            if inserted < 3:
                c, w, o = best(i, nexts[last], inserted + 1)
                found.append((c + 3, "I" + w, (({"u": "user", "a": "assistant"}[nexts[last]], ""), *o)))
            if i < len(lines):
                role, _, text = lines[i]
                c, w, o = best(i + 1, last)
                found.append((c + 4, "D" + w, o))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    if role[:1] == nexts[last] or (role[:1] == "s" and last == ""):
                        c, w, o = best(i + 1, role[:1])
                        found.append((c + more, "K" + w, ((role, text), *o)))
                    c, w, o = best(i + 1, nexts[last])
                    found.append((c + 3 + more, "R" + w, (({"u": "user", "a": "assistant"}[nexts[last]], text), *o)))
            return min(found) if found else (10**9, "", ())

        for i in range(len(lines), -1, -1):  # from the end, so that no call goes deep
            for last in ("", "s", "u", "a"):
                best(i, last)
        cost, audit, new = best(0, "")
        turns = [x[1] for x in by[conv] if x[0]]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        count = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversation(draw, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]
    texts = ["Hi.", "What? ", "no end", "", " \n", None, "Yes!", "Hi.", "Well…", "x.\t", "Ja.", "Oh?"]
    out = []
    for i in range(n):
        role = draw.choice(["user", "assistant"][i % 2 : i % 2 + 1] * 6 + roles)
        text = draw.choice(texts) if draw.random() < 0.3 else f"{draw.random()}" + draw.choice([".", "!", "?", ".", ""])
        out.append((conv, draw.choice([i, i, i, i, i + 7, None, i - 1]), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [1, 3, R.CHUNK])
def test_equals_brute_force(spark, size):
    draw = random.Random(size)
    rows = [x for conv in [*range(60), None] for x in conversation(draw, conv, draw.choice([0, 1, 2, 3, 8, 20]))]
    rows += conversation(draw, 100, 150) + [(200, None, None, None), (201, 5, "user", "Hi."), (201, 5, "user", "Hi.")]
    table = spark.createDataFrame([(*x, 3, "k") for x in rows], SCHEMA + ", no long, audit string").repartition(7)
    ids = {x[0] for x in rows}
    assert got(R.report(table, table, size)) == brute(rows, ids)
    bad = R.damaged(table)
    assert sorted(map(repr, got(bad))) == sorted(map(repr, damage(rows)))
    assert got(R.report(bad, table, size)) == brute(damage(rows), ids)


def test_every_short_conversation():
    """All sequences of up to five rows of any initial and fault, held against the plain search."""
    for n in range(5):
        for codes in product(range(16), repeat=n) if n < 4 else [tuple(random.Random(i).choices(range(16), k=6)) for i in range(2000)]:
            nexts = {0: 2, 1: 2, 2: 3, 3: 2}

            @cache
            def best(i, q, inserted=0):
                found = [(0, "")] if i == len(codes) and q in (0, 3) else []
                if inserted < 3:
                    c, w = best(i, nexts[q], inserted + 1)
                    found.append((c + 3, "I" + w))
                if i < len(codes):
                    for x, c, to in R._ways(codes[i], q):
                        d, w = best(i + 1, to)
                        found.append((c + d, x + w))
                return min(found) if found else (10**9, "")

            audit, cost, _ = R.trace(bytes(codes), R.FINAL, 0, True) if codes else ("", 0, 0)
            assert (cost, audit) == best(0, 0)


def test_one_long_conversation_over_many_chunks(spark):
    draw = random.Random(9)
    rows = conversation(draw, 1, 900)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_long(rows)
    r = R.report(table, size=16).first()
    assert (r.cost, r.audit, r.repaired_sha256) == want
    new = R.repaired(table, size=16).orderBy("position").collect()
    assert [x.position for x in new] == list(range(len(new)))
    roles = "".join(x.role[0] for x in new)
    assert roles.removeprefix("s") == "ua" * (len(roles) // 2)
    assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in new).encode()).hexdigest() == r.repaired_sha256
    _, passes = R.stitched(R.chunks(R._plain(table), 16))
    assert 1 <= passes < 6  # of some 56 chunks


def brute_long(rows):
    return tuple(brute(rows, [1])[0][i] for i in (6, 7, 8))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.report(none, none).collect() == [] and R.repaired(none).collect() == []
    one = spark.createDataFrame([(4, 1, "user", "Hi.")], SCHEMA)
    assert got(R.report(none, one)) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 5_000_000 + "."), (1, 1, "assistant", "y " * 2_000_000), (1, 2, "user", "x" * 5_000_000 + ".")]
    assert got(R.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows, [1])
