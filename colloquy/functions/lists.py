"""List literal cells (``str(list)`` written into CSV) -> ARRAY<STRING>.

``from_json`` with single quotes and any-character escapes reads quotes,
``\\n``, ``\\t``, ``\\\\`` and ``\\uXXXX`` like Python.  The escapes that JSON does
not know are rewritten first, by built-in functions: ``\\xHH``, octal and
``\\UHHHHHHHH`` become ``\\uXXXX`` (a pair of them beyond the BMP), ``\\a`` and
``\\v`` their code, and a Python-only ``\\/`` keeps its backslash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON_OPTS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
_ESCAPE = r"\\(?s:x[0-9a-fA-F]{2}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)"


def _code(number: Column) -> Column:
    """JSON's escape of a code point."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n.cast("bigint")), 4, "0"))
    high, low = F.lit(0xD800) + F.floor((number - 0x10000) / 1024), F.lit(0xDC00) + (number - 0x10000) % 1024
    return F.when(number < 0x10000, unit(number)).otherwise(F.concat(unit(high), unit(low)))


def _escape(e: Column) -> Column:
    kind, rest = F.substring(e, 2, 1), F.substr(e, F.lit(3))
    return (F.when(kind.isin("x", "U") & (F.length(e) > 2), _code(F.conv(rest, 16, 10).try_cast("bigint")))
            .when(kind.rlike("^[0-7]$"), _code(F.conv(F.substr(e, F.lit(2)), 8, 10).try_cast("bigint")))
            .when(kind == "a", F.lit("\\u0007")).when(kind == "v", F.lit("\\u000B")).when(kind == "/", F.lit("\\\\/")).otherwise(e))


def parse_list_cell(col) -> Column:
    """Python list literal text -> ARRAY<STRING>; NULL when unreadable."""
    c = F.col(col) if isinstance(col, str) else col
    # text before, between and after the escapes, and the escapes, in turn
    between = F.split(c, _ESCAPE, -1)
    escapes = F.regexp_extract_all(c, F.lit(f"({_ESCAPE})"), F.lit(1))
    joined = F.concat_ws("", F.zip_with(between, escapes, lambda t, e: F.concat(t, F.coalesce(_escape(e), F.lit("")))))
    text = F.when(c.rlike(r"\\[avxU0-7/]"), joined).otherwise(c)
    return F.from_json(text, "array<string>", _JSON_OPTS)
