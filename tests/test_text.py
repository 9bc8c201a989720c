import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions.lists import parse_list_cell
from colloquy.functions.scrub import default_rules, scrub_negations
from colloquy.operators import dialogue as DG


def _one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).collect()[0].o


def test_strip_matches_python_for_all_bmp_blanks(spark):
    blanks = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    assert len(blanks) == 29
    values = [blanks + "a b" + blanks, " \x1c x \x1f", "　", "", "plain"]
    rows = spark.createDataFrame([(v,) for v in values], "s string").select(X.strip("s").alias("o")).collect()
    assert [r.o for r in rows] == [v.strip() for v in values]


@pytest.mark.parametrize("reply,reason,answer", [
    ("Reason: a-b\nc\n\nFinal Response: **Fatigue**", "abc", "Fatigue"),
    ("no marker here at all, long", "no marker here at all, lon", "at all, long"),
    ("", "", ""),
    ("Final Response:", "", ""),
    ("Final Response: ** Foo **", "", " Foo "),
    ("Reason: Reason: q Final Response: A Final Response: B", "q", "A Final Response: B"),
])
def test_parse_verdict(spark, reply, reason, answer):
    v = _one(spark, X.parse_verdict(F.col("s")), reply)
    assert (v.reason, v.answer) == (reason, answer)


def _turns(spark, qa, T=2):
    df = spark.createDataFrame([(qa,)], "QA array<string>")
    return df.select(DG.validate_turns("QA", T).alias("o")).collect()[0].o


def test_validate_turns_fixture_table(spark):
    h = "head"
    assert _turns(spark, [h, "Question: a", "x", "Question: b", "y"]) == "valid"
    assert _turns(spark, [h, "Question: a Question: b", "x", "Question: c", "y"]) == "QA format Error."
    assert _turns(spark, [h, "Question: a", "x", "thanks", "y"]) == "Early Stop Error."
    assert _turns(spark, [h, "Question : a", "x", "Question: b", "y"]) == "Early Stop Error."
    assert _turns(spark, [h, "Question: a Question: b", "x"]) == "Error"


def test_render_dialogue_and_history(spark):
    df = spark.createDataFrame([(["cc", "q1", "a1\n\nmore", "q2", "a2", "q3"],)], "QA array<string>")
    r = df.select(X.render_dialogue(DG.head("QA"), DG.body("QA", 2), 2).alias("d"),
                  X.render_history("QA", 2).alias("h")).collect()[0]
    qa = ["cc", "q1", "a1\n\nmore", "q2", "a2", "q3"]
    want = "Main Symptom: " + qa[0] + "\n"
    for m in range(4):
        want += "\n" + qa[1:5][m]
    assert r.d == want.strip()
    assert r.h == "\n\n".join(x.replace("\n\n", "\n") for x in qa[:5])


def test_fenced_block_and_predictions(spark):
    reply = "ok\n```yaml\nDiseases:\n  - Asthma\n  - COPD\n```\ntail"
    assert _one(spark, X.fenced_block(F.col("s")), reply) == "\nDiseases:\n  - Asthma\n  - COPD\n"
    assert _one(spark, X.fenced_block(F.col("s")), "no fence") == "no fence"
    assert _one(spark, X.fenced_block(F.col("s")), "```yaml```") == ""
    assert _one(spark, X.parse_predictions(X.fenced_block(F.col("s"))), reply) == ["Asthma", "COPD"]
    assert _one(spark, X.parse_predictions(F.col("s")), "no key") is None


@pytest.mark.parametrize("reply,result,ok", [
    ("Reasoning: fine\nResult: True", True, True),
    ("Reasoning: fine\nResult: yes", True, True),
    ("Reasoning: fine\nResult: False", False, True),
    ("Reasoning: fine\nResult: True/False", None, True),
    ("Reasoning: only", None, False),
])
def test_parse_judgement(spark, reply, result, ok):
    j = _one(spark, X.parse_judgement(F.col("s")), reply)
    assert (j.result, j.ok) == (result, ok)


def test_profile_render_keeps_key_order(spark):
    js = '{"Chief Complaint": "cough", "Hx": ["a", "b"], "Age": 40, "token": "t", "pid": "1"}'
    df = spark.createDataFrame([(js,)], "s string").select(F.from_json("s", "map<string,string>").alias("m"))
    r = df.select(X.render_profile(X.drop_keys("m")).alias("t"), X.chief_complaint("m").alias("c"),
                  X.render_profile("m", trailing_newline=True).alias("n")).collect()[0]
    assert r.t == "Chief Complaint: cough\nHx: a, b\nAge: 40"
    assert r.c == "cough"
    assert r.n.endswith("pid: 1\n")


def test_pad_key(spark):
    df = spark.createDataFrame([(12,), (1234567890,)], "k long").select(X.pad_key("k").alias("p"))
    assert [r.p for r in df.collect()] == ["00000012", "1234567890"]


def test_count_marker(spark):
    assert _one(spark, X.count_marker(F.col("s"), "Question:"), "Question: a Question:b Question :") == 2
    assert _one(spark, X.count_marker(F.col("s"), "a.a"), "a.aa.a axa") == 2


def test_list_cells_fast_path_and_fallback(spark):
    cells = ["['a', \"b'c\", 'x\\ny', 'back\\\\slash']", "['nb\\xa0sp', 'v\\x0b']", "[]", "not a list"]
    import ast
    rows = spark.createDataFrame([(c,) for c in cells], "s string").select(parse_list_cell("s").alias("o")).collect()
    assert [r.o for r in rows[:3]] == [ast.literal_eval(c) for c in cells[:3]]
    assert rows[3].o is None


def test_scrub_rules(spark):
    assert len(default_rules()) == 30
    resp = "- 체중 변화는 없다.\n- 두통이 없다.\n- 두통이 없다.\n- 기침은 없다.\nlast"
    df = spark.createDataFrame([(resp, "두통이 있어요"), (resp, "nothing")], "r string, c string")
    out = [r.o for r in df.select(scrub_negations("r", "c").alias("o")).collect()]
    assert out[0] == "- 두통이 없다.\n- 두통이 없다.\nlast"
    assert out[1] == "last"


def test_chat_messages_roles(spark):
    df = spark.createDataFrame([(["cc", "q", "a"],)], "QA array<string>")
    doc = df.select(DG.chat_messages("QA", F.lit("sys"), "doctor").alias("m")).collect()[0].m
    pat = df.select(DG.chat_messages("QA", F.lit("sys"), "patient").alias("m")).collect()[0].m
    assert [m.role for m in doc] == ["system", "user", "assistant", "user"]
    assert [m.role for m in pat] == ["system", "assistant", "user", "assistant"]


@pytest.mark.parametrize("block,want", [
    ("Diseases: [Asthma, COPD]", ["Asthma", "COPD"]),
    ("Diseases: ['a, b', \"c\"]", ["a, b", "c"]),
    ("Diseases:\n- \"Asthma\"\n- Crohn's\nNotes:\n- x", ["Asthma", "Crohn's"]),
    ("Diseases:\n\n  - A\n  - B \n", ["A", "B"]),
    ("Diseases:", None), ("Diseases: []", None), ("Diseases: Asthma", None), ("other", None), ("Notes:\n  Diseases:\n  - A", None),
])
def test_predictions(spark, block, want):
    assert _one(spark, X.parse_predictions(F.col("s")), block) == want


@pytest.mark.parametrize("block,want", [
    ("Reasoning: |\n  fine match\nResult: True", ("fine match", True)),
    ("Reasoning: |\n  a\n    b\n  Result: False\n\n  c\nResult: no", ("a\n  b\nResult: False\n\nc", False)),
    ("Reasoning: >-\n  a\n  b\nResult: yes", ("a b", True)),
    ("Result: True\nReasoning: 'it''s'", ("it's", True)),
    ("Reasoning: a\n  Result: True\nResult: \"True\"", ("a Result: True", None)),
    ("Reasoning: a\n  Result: True", (None, None)),
])
def test_judgements(spark, block, want):
    v = _one(spark, X.parse_judgement(F.col("s")), block)
    assert (v.reasoning, v.result) == want


@pytest.mark.parametrize("items", [["Crohn's"], ["a", 'say "x"'], ["it's \"x\""], ["back\\\\slash", "l1\nl2\t"], []])
def test_list_text_is_python_s(spark, items):
    from colloquy.operators.diagnosis import python_list_text
    assert _one(spark, python_list_text(F.col("a")), items, "a array<string>") == str(items)


@pytest.mark.parametrize("items", [["\x07\x0b\x1b", "it's \"x\""], ["\U0001f600é", "a/b\\/c"], ["\u200b", "\x85\xa0", ""], []])
def test_list_cells_read_like_python_literals(spark, items):
    assert _one(spark, parse_list_cell("s"), str(items)) == items
    assert _one(spark, parse_list_cell("s"), ascii(items)) == items


def test_odd_keys_and_missing_values(spark):
    assert _one(spark, X.pad_key("s"), "P-12") is None and _one(spark, X.pad_key("s"), "12") == "00000012"
    assert _one(spark, X.render_profile("m"), {"a": None, "b": '["x","y"]'}, "m map<string,string>") == "a: None\nb: x, y"
    m = F.create_map(*[F.lit(x) for x in ("pid", "1", "q", 'say "x"')], F.lit("n"), F.lit(None).cast("string"), F.lit("l"), F.lit('["x"]'), F.lit("token"), F.lit("t"))
    assert _one(spark, X.profile_text(m), "") == '{"q": "say \\"x\\"", "n": null, "l": ["x"]}'


def _plain_predictions(block):
    """The rule as regular expressions, in plain Python."""
    b = block + "\n"
    m = re.search(r"(?m)^Diseases:[ \t]*(\[[^\]]*\]|(?:\n(?:[ \t]*-(?:[ \t][^\n]*)?|[ \t]+[^\n]*|))*)", b)
    if not m:
        return None
    part = m[1]
    found = re.findall(r"""[ \t\n]*("[^"]*"|'[^']*'|[^,]+)""", part[1:-1]) if part.startswith("[") else re.findall(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$", part)
    return [x for x in map(_plain_unquote, found) if x] or None


def _plain_unquote(s):
    s = s.strip(" \t")
    if len(s) >= 2 and s[0] == s[-1] == '"':
        return s[1:-1].replace('\\"', '"')
    return s[1:-1].replace("''", "'") if len(s) >= 2 and s[0] == s[-1] == "'" else s


def _plain_judgement(block):
    b = block + "\n"
    m, r = re.search(r"(?m)^Reasoning:[ \t]*([^\n]*)((?:\n[ \t]+[^\n]*|\n(?=\n))*)", b), re.search(r"(?m)^Result:[ \t]*([^\n]*?)[ \t]*$", b)
    if not m or not r:
        return (None, None, False)
    first, rest = m[1].rstrip(" "), m[2]
    lead = next((x for x in rest.split("\n") if x.strip(" \t")), "")
    indent = lead[: len(lead) - len(lead.lstrip(" \t"))]
    literal = (rest.replace("\n" + indent, "\n") if indent else rest).strip("\n \t")
    if re.fullmatch(r"\|[+-]?", first):
        return (literal, r[1], True)
    if re.fullmatch(r">[+-]?", first):
        return (re.sub(r"[ \t]*\n[ \t]*", " ", literal), r[1], True)
    return (_plain_unquote(re.sub(r"[ \t]*\n[ \t]*", " ", first + rest.rstrip(" "))), r[1], True)


def _replies(seed, n):
    draw = random.Random(seed)
    lines = ["Diseases:", "Diseases: ", "Diseases: [a, 'b, c', \"d\"]", "Diseases: [x,", "  y]", "Diseases: z", "- one", "  - two  ", "-", "- ", "-\tthree", "-four", "", "  ", "  five", "key: six", "- 'it''s'",
             "- \"q\\\"q\"", "Reasoning: plain", "Reasoning: |", "Reasoning: >-", "Reasoning:", "Reasoning: 'a", "   deeper", "\ttab \t", "Result: True", "Result:  no  ", "Result:", " Result: x", "]", "a, b"]
    return ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 9))) for _ in range(n)]


def test_replies_read_by_lines_equal_the_expressions(spark):
    replies = _replies(1, 4000)
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, s string").select("i", X.parse_predictions("s").alias("p"), X.parse_judgement("s").alias("j")).collect()
    for r in rows:
        assert r.p == _plain_predictions(replies[r.i]), replies[r.i]
        assert (r.j.reasoning, r.j.result_text, r.j.ok) == _plain_judgement(replies[r.i]), replies[r.i]


def test_replies_with_other_line_ends(spark):
    s = "Reasoning: |\r\n  a\r\n  b\r\nResult: yes\r\nDiseases:\r\n- x \r\n- y\r\n"
    assert _one(spark, X.parse_predictions(F.col("s")), s) == ["x", "y"]
    j = _one(spark, X.parse_judgement(F.col("s")), s)
    assert (j.reasoning, j.result, j.ok) == ("a\nb", True, True)
    assert _one(spark, X.parse_predictions(F.col("s")), None) is None and not _one(spark, X.parse_judgement(F.col("s")), None).ok


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_replies_of_very_many_lines(spark, n):
    """A model that loops must cost one reply, not the executor; one line may also be very long."""
    listed = "Diseases:\n" + "".join(f"  - item {i}\n\n  more\n" for i in range(n)) + "end: 1"
    judged = "Reasoning: |\n" + "".join(f"  line {i}\n\n" for i in range(n)) + "Result: True\n"
    folded = "Reasoning: >\n" + "   w\n" * n + "Result: no"
    wide = "Reasoning: " + "x " * 5_000_000 + "\nResult: True\nDiseases:\n- " + "y \t" * 2_500_000
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([listed, judged, folded, wide])], "i int, s string").repartition(2).select("i", X.parse_predictions("s").alias("p"), X.parse_judgement("s").alias("j")).collect()
    got = {r.i: (r.p, r.j) for r in rows}
    assert got[0][0] == [f"item {i}" for i in range(n)]
    assert got[1][1].result and got[1][1].reasoning == "\n\n".join(f"line {i}" for i in range(n))
    assert got[2][1].result is False and got[2][1].reasoning == " ".join(["w"] * n)
    assert got[3][1].reasoning == ("x " * 5_000_000).strip() and got[3][0] == [("y \t" * 2_500_000).strip()]


def _plain_scrub(reply, context, rules):
    for words, phrase in rules:
        if not any(w in context for w in words):
            reply = reply.replace(phrase, "")
    return reply


def test_scrub_in_one_pass_equals_the_chain(spark):
    """Also where a removal forms a phrase, of an earlier or of a later rule."""
    from colloquy.functions.scrub import never_overlap
    rules, draw = default_rules(), random.Random(2)
    parts = [p for _, p in rules] + [p[:4] for _, p in rules] + [p[4:] for _, p in rules] + ["- ", "없다.\n", "x", "\n"]
    words = [w for ws, _ in rules for w in ws] + ["", "etc"]
    rows = [("".join(draw.choice(parts) for _ in range(draw.randint(0, 7))), " ".join(draw.choice(words) for _ in range(draw.randint(0, 3)))) for _ in range(3000)]
    first, second = rules[6][1], rules[12][1]
    rows += [(first[:5] + second + first[5:], ""), (second[:5] + first + second[5:], ""), (None, "x"), ("- x", None), (first, None)]
    got = [r.o for r in spark.createDataFrame(rows, "r string, c string").coalesce(1).select(scrub_negations("r", "c").alias("o")).collect()]
    assert got[:-3] == [_plain_scrub(r, c, rules) for r, c in rows[:-3]]
    assert got[-3:] == [None, "- x", first]
    assert never_overlap([p for _, p in rules]) and not never_overlap(["ab", "ba"]) and not never_overlap(["a", "xax"])
    other = [(("k",), "aba"), (("z",), "b")]
    rows = [("".join(draw.choice("abc") for _ in range(9)), draw.choice("kzx")) for _ in range(300)]
    got = [r.o for r in spark.createDataFrame(rows, "r string, c string").coalesce(1).select(scrub_negations("r", "c", other).alias("o")).collect()]
    assert got == [_plain_scrub(r, c, other) for r, c in rows]
