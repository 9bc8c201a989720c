"""Column -> Column text functions: rendering, reply parsing, strip, padding.

Everything here is a built-in Catalyst expression, so it stays inside
whole-stage code generation; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.isspace`` characters of the Basic
# Multilingual Plane, written as one regex class that Java and RE2 both
# read.  Spark ``trim`` strips only U+0020 and ``(?U)\s`` misses
# U+001C..U+001F, so neither equals Python's ``str.strip``.
BLANK_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP_PATTERN = rf"\A{BLANK_CLASS}+|{BLANK_CLASS}+\z"
# The same characters as a set for Spark's ``trim(BOTH set FROM s)``, which
# removes code points of the set from both ends without a regex.
BLANK_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")

# The marker words of the comparer reply.
REASON_MARKER = "Reason:"
ANSWER_MARKER = "Final Response:"

# Fixed value: opens the organizer's input.
MAIN_SYMPTOM = "Main Symptom: "

# Scalars PyYAML's safe loader reads as booleans.
YAML_TRUE = ["yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON"]
YAML_FALSE = ["no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Python ``str.strip()`` (all BMP blanks at both ends)."""
    return F.trim(_c(col), F.lit(BLANK_CHARS))


def fill_template(template, slots: list[tuple[str, Column | str]]) -> Column:
    """``template.replace('{a}', x).replace('{b}', y)...`` in the given order
    (a filled value may itself contain a later slot, so order matters)."""
    out = template if isinstance(template, Column) else F.lit(template)
    for name, value in slots:
        out = F.replace(out, F.lit("{" + name + "}"), _c(value))
    return out


def _regex_literal(s: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in s) if s else s


def count_marker(col, needle: str) -> Column:
    """Python ``s.count(needle)``: non-overlapping literal occurrences."""
    return F.regexp_count(_c(col), F.lit(_regex_literal(needle))).cast("bigint")


def parse_verdict(reply) -> Column:
    """Split a comparer reply into ``(reason, answer, marker_found)``.

    Same steps as the original: drop every ``Reason:``, strip, find
    ``Final Response:``; the reason loses newlines and dashes, the answer
    loses stars after the strip.  When the marker is absent ``find`` is -1:
    the reason is all but the last character and the answer starts at
    character 14; that is reproduced and flagged by ``marker_found``."""
    r = strip(F.replace(_c(reply), F.lit(REASON_MARKER), F.lit("")))
    i = F.locate(ANSWER_MARKER, r)
    found = i > 0
    reason_raw = F.when(found, F.substring(r, F.lit(1), i - 1)).otherwise(
        F.substring(r, F.lit(1), F.length(r) - 1))
    answer_raw = F.when(found, F.substr(r, i + len(ANSWER_MARKER))).otherwise(
        F.substr(r, F.lit(len(ANSWER_MARKER))))
    return F.struct(
        clean_reason(reason_raw).alias("reason"),
        clean_answer(answer_raw).alias("answer"),
        found.alias("marker_found"),
    )


def clean_reason(col) -> Column:
    """``s.strip().replace('\\n', '').replace('-', '')``."""
    return F.translate(strip(col), "\n-", "")


def clean_answer(col) -> Column:
    """``s.strip().replace('*', '')`` (stars go after the strip)."""
    return F.replace(strip(col), F.lit("*"), F.lit(""))


def fenced_block(col, lang: str = "yaml") -> Column:
    """Text of the first ```yaml fence up to the next ``` (or the end);
    the whole text when there is no fence."""
    fence = "```" + lang
    s = _c(col)
    after = F.substr(s, F.locate(fence, s) + len(fence))
    return F.when(s.contains(fence), F.substring_index(after, "```", 1)).otherwise(s)


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _unquote(col: Column) -> Column:
    """A YAML scalar without its quotes (``''`` and ``\\"`` inside them undone)."""
    def plain(c):
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        return (F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), F.replace(inner, F.lit('\\"'), F.lit('"')))
                .when((F.length(c) >= 2) & c.startswith("'") & c.endswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
                .otherwise(c))
    return _let(F.trim(col, F.lit(" \t")), plain)


def _lines(block) -> Column:
    """The lines of a reply; CR and CR LF end a line as LF does."""
    return F.split(F.replace(F.replace(_c(block), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def _key_line(lines: Column, key: str) -> Column:
    """Number of the first line that starts with ``key`` (0 if there is none)."""
    return F.array_position(F.transform(lines, lambda x: x.startswith(key)), F.lit(True))


def _after(lines: Column, at: Column) -> Column:
    return F.slice(lines, at + 1, F.size(lines))


def _while(lines: Column, good) -> Column:
    """The lines in front of the first one that is not ``good``."""
    def upto(end):
        return F.when(end > 0, F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(lines)
    return _let(F.array_position(F.transform(lines, good), F.lit(False)), upto)


def _indented(line: Column) -> Column:
    return line.startswith(" ") | line.startswith("\t")


def parse_predictions(block) -> Column:
    """``Diseases:`` list of the predictor reply -> ARRAY<STRING>, from a block list (items up to
    the next unindented key) or a flow list; items lose their quotes.  NULL, a parse error, when
    the key or its items are missing.

    The reply is split into lines once and each line is looked at once, so replies of any length
    and number of lines are read; no regular expression runs over a whole reply but that of a
    flow list's items."""
    blanks = F.lit(" \t")

    def item(line):
        rest = F.ltrim(line, blanks)
        return F.when(rest.startswith("- ") | rest.startswith("-\t"), F.substr(rest, F.lit(2)))

    def flow(first, tail):
        text = F.array_join(F.concat(F.array(F.substr(first, F.lit(2))), tail), "\n")
        listed = F.when(text.contains("]"), F.substring_index(text, "]", 1))
        return F.regexp_extract_all(listed, F.lit(r"""[ \t\n]*("[^"]*"|'[^']*'|[^,]+)"""), F.lit(1))

    def listed(lines):
        first, tail = F.ltrim(F.substr(F.get(lines, F.lit(0)), F.lit(len("Diseases:") + 1)), blanks), _after(lines, F.lit(1))
        rows = _while(tail, lambda x: (x == "") | _indented(x) | (x == "-") | x.startswith("- ") | x.startswith("-\t"))
        return F.when(first.startswith("["), flow(first, tail)).when(first == "", F.transform(rows, item))

    def found(lines):
        return _let(_key_line(lines, "Diseases:"), lambda at: F.when(at > 0, _let(F.slice(lines, at, F.size(lines)), listed)))

    items = F.filter(F.transform(_let(_lines(block), found), _unquote), lambda x: x != "")
    return _let(items, lambda x: F.when(F.size(x) > 0, x))


def yaml_bool(col) -> Column:
    """YAML 1.1 boolean scalar -> BOOLEAN; anything else -> NULL."""
    c = _c(col)
    return F.when(c.isin(YAML_TRUE), F.lit(True)).when(c.isin(YAML_FALSE), F.lit(False))


def parse_judgement(block) -> Column:
    """``Reasoning`` / ``Result`` fields of the judge reply, both unindented keys.  The reasoning
    may be a block scalar (``|`` keeps lines, ``>`` folds them; the indent and outer blank lines
    go), a quoted or a plain scalar, also over several indented lines.  As in
    ``parse_predictions``, lines are split once and looked at one by one.

    ``ok`` is false when either field is missing (the original retries and
    then fails); ``result`` is NULL when the value is not a YAML boolean, so
    it never counts as a correct answer."""
    blanks = F.lit(" \t")

    def value(line, key):
        return F.ltrim(F.substr(line, F.lit(len(key) + 1)), blanks)

    def folded(lines):
        return F.array_join(F.transform(lines, lambda x: F.trim(x, blanks)), " ")

    def reasoning(first, rows):
        def literal(rows):
            lead = F.get(F.filter(rows, lambda x: F.trim(x, blanks) != ""), F.lit(0))
            indent = F.coalesce(F.length(lead) - F.length(F.ltrim(lead, blanks)), F.lit(0))
            prefix = F.coalesce(F.substring(lead, F.lit(1), indent), F.lit(""))
            cut = _let(prefix, lambda p: F.transform(rows, lambda x: F.when(x.startswith(p), F.substr(x, F.length(p) + 1)).otherwise(x)))
            return F.trim(F.array_join(cut, "\n"), F.lit("\n \t"))
        return (F.when(first.isin("|", "|+", "|-"), literal(rows))
                .when(first.isin(">", ">+", ">-"), folded(F.split(literal(rows), "\n")))
                .otherwise(_unquote(folded(F.concat(F.array(first), rows)))))

    def read(lines):
        keys = F.struct(_key_line(lines, "Reasoning:").alias("at"), _key_line(lines, "Result:").alias("result"))
        return _let(keys, lambda k: fields(lines, k["at"], k["result"]))

    def fields(lines, at, result):
        rows = _while(_after(lines, at), lambda x: (x == "") | _indented(x))
        first, text = F.rtrim(value(F.get(lines, at - 1), "Reasoning:")), F.trim(value(F.get(lines, result - 1), "Result:"), blanks)
        whole = _let(F.struct(first.alias("first"), rows.alias("rows")), lambda x: reasoning(x["first"], x["rows"]))
        ok = (at > 0) & (result > 0)
        return F.struct(F.when(ok, whole).alias("reasoning"), F.when(ok, text).alias("result_text"), F.when(ok, yaml_bool(text)).alias("result"), ok.alias("ok"))

    none = F.struct(F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("result_text"), F.lit(None).cast("boolean").alias("result"), F.lit(False).alias("ok"))
    lines = _lines(block)
    return F.coalesce(F.when(lines.isNotNull(), _let(lines, read)), none)


def render_dialogue(head, body, turns: int) -> Column:
    """Organizer input: ``Main Symptom: <head>`` then the first ``2*turns``
    body items, one per line after a blank line, stripped.  NULL when the
    body is shorter (the original fails with an index error there)."""
    items = F.slice(_c(body), 1, 2 * turns) if turns > 0 else F.array().cast("array<string>")
    text = F.concat(F.lit(MAIN_SYMPTOM), _c(head), F.lit("\n\n"), F.array_join(items, "\n"))
    return F.when(F.size(_c(body)) >= 2 * turns, strip(text))


def render_history(qa, turns: int) -> Column:
    """Diagnosis input: first ``2*turns+1`` items, inner blank lines
    collapsed once, items separated by a blank line."""
    kept = F.slice(_c(qa), 1, 2 * turns + 1)
    return F.array_join(F.transform(kept, lambda x: F.replace(x, F.lit("\n\n"), F.lit("\n"))), "\n\n")


def _list_value(v: Column) -> Column:
    parsed = F.from_json(v, "array<string>")
    return F.when(v.startswith("[") & parsed.isNotNull(), F.array_join(parsed, ", ")).otherwise(v)


def render_profile(info, trailing_newline: bool = False) -> Column:
    """``key: value`` lines of a profile map in key order; list values
    (kept as JSON text by the MAP<STRING,STRING> schema) are comma-joined.
    ``trailing_newline`` selects the diagnosis variant (every line ends
    with a newline) over the simulator variant (lines joined)."""
    lines = F.transform(F.map_entries(_c(info)),
                        lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(_list_value(e["value"]), F.lit("None"))))
    text = F.array_join(lines, "\n")
    if trailing_newline:
        text = F.when(F.size(lines) > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    return text


def pad_key(col, width: int = 8) -> Column:
    """``f'{pid:08d}'``: zero padding that never truncates longer ids; NULL for a key that is no
    integer (such rows show up as unmatched)."""
    number = _c(col).cast("string").try_cast("bigint")
    return F.when(number.isNotNull(), F.format_string(f"%0{width}d", number))


def chief_complaint(info, keys: tuple[str, ...] = ("주증상", "Chief Complaint")) -> Column:
    """First present key of ``keys`` (Korean profile key, then English)."""
    return F.coalesce(*[F.try_element_at(_c(info), F.lit(k)) for k in keys])


def profile_text(profile, drop: tuple[str, ...] = ("token", "pid")) -> Column:
    """Whole profile as the patient prompt shows it: a JSON object without the dropped keys, in
    key order; lists and objects kept as JSON, missing values as ``null``."""
    entries = F.map_entries(drop_keys(profile, drop))
    nested = lambda v: v.rlike(r"\A(?s:\[.*\]|\{.*\})\z")
    one = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)\A\[(.*)\]\z", 1)
    lines = F.transform(entries, lambda e: F.concat(one(e["key"]), F.lit(": "), F.when(e["value"].isNull(), F.lit("null")).when(nested(e["value"]), e["value"]).otherwise(one(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(lines, ", "), F.lit("}"))


def drop_keys(info, keys: tuple[str, ...] = ("token", "pid")) -> Column:
    """Profile map without the given keys (order of the rest kept)."""
    return F.map_filter(_c(info), lambda k, v: ~k.isin(list(keys)))


def any_keyword(col, words: list[str]) -> Column:
    """``any(word in s for word in words)`` as one regex match."""
    if not words:
        return F.lit(False)
    return _c(col).rlike("|".join(_regex_literal(w) for w in words))
