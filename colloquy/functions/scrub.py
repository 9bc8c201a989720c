"""Rule-driven removal of negation lines the dialogue never mentioned.

A rule is ``(keywords, phrase)``: when none of the keywords occurs in the
dialogue text, every occurrence of the phrase is removed from the
organizer reply, rule by rule in table order.

One pass does it: the keywords of a dialogue are tested once, and the phrases
they leave are removed together by one expression.  Removing a phrase can
form another one from what stands on either side; only then does the order
of the rules matter, and the chain of replacements runs for that reply.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import _let, _regex_literal

# Fixed values (must equal the original rules, in this order).
_GROUP_RULES = [
    (("체중",), ["- 체중 변화는 없다.\n", "- 체중 변화가 없다.\n"]),
    (("호흡",), ["- 호흡 곤란은 없다.\n", "- 호흡 곤란이 없다.\n"]),
    (("피로", "피곤"), ["- 피로감이 없다.\n", "- 피로감은 없다.\n"]),
]
_SYMPTOM_WORDS = ["발열", "구토", "메스꺼움", "기침", "설사", "두통"]
_PARTICLES = ["은", "는", "이", "가"]


def default_rules() -> list[tuple[tuple[str, ...], str]]:
    """The 30 (keywords, phrase) rules in application order."""
    rules = [(kw, phrase) for kw, phrases in _GROUP_RULES for phrase in phrases]
    for word in _SYMPTOM_WORDS:
        for particle in _PARTICLES:
            rules.append(((word,), f"- {word}{particle} 없다.\n"))
    return rules


def _absent(ctx: Column, keywords: tuple[str, ...]) -> Column:
    out = None
    for k in keywords:
        cond = ~ctx.contains(k)
        out = cond if out is None else out & cond
    return out


def _chain(out: Column, ctx: Column, rules) -> Column:
    for keywords, phrase in rules:
        # replacing the phrase by itself is a no-op: keeps the expression
        # linear in the number of rules (a when/otherwise per rule would
        # copy the whole chain twice per rule)
        out = F.replace(out, F.lit(phrase), F.when(_absent(ctx, keywords), F.lit("")).otherwise(F.lit(phrase)))
    return out


def never_overlap(phrases: list[str]) -> bool:
    """Whether no two occurrences of the phrases can share a character, so
    that removing them together or one after the other is the same."""
    return all((p == q or p not in q) and not any(p.endswith(q[:n]) for n in range(1, min(len(p), len(q)))) for p in phrases for q in phrases)


def scrub_negations(response, context, rules=None) -> Column:
    """Remove each rule's phrase from ``response`` unless one of its
    keywords occurs in ``context`` (the rendered dialogue)."""
    out = F.col(response) if isinstance(response, str) else response
    ctx = F.col(context) if isinstance(context, str) else context
    rules = list(rules or default_rules())
    phrases = [p for _, p in rules]
    if not never_overlap(phrases):
        return _chain(out, ctx, rules)
    head = os.path.commonprefix(phrases)
    tail = os.path.commonprefix([p[len(head):][::-1] for p in phrases])[::-1]

    def middle(p: str) -> str:
        return _regex_literal(p[len(head):len(p) - len(tail)])

    by_words: dict[tuple[str, ...], list[str]] = {}
    for keywords, phrase in rules:
        by_words.setdefault(tuple(keywords), []).append(middle(phrase))
    left = F.concat_ws("|", *[F.when(_absent(ctx, k), F.lit("|".join(m))) for k, m in by_words.items()])
    before, after = F.lit(_regex_literal(head) + "(?:"), F.lit(")" + _regex_literal(tail))

    def removed(middles):
        pattern = F.concat(before, middles, after)
        once = _let(F.regexp_replace(out, pattern, F.lit("")), lambda x: F.when(F.rlike(x, pattern), _chain(out, ctx, rules)).otherwise(x))
        return F.when(middles == "", out).otherwise(once)

    some = F.rlike(out, F.concat(before, F.lit("|".join(map(middle, phrases))), after))
    return F.when(some, _let(left, removed)).otherwise(out)


def scrub_sql(response: str, context: str, rules=None) -> str:
    """The same rule chain as a SQL expression (used by the DuckDB oracle)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    out = response
    for keywords, phrase in rules or default_rules():
        absent = " AND ".join(f"NOT contains({context}, {q(k)})" for k in keywords)
        out = f"replace({out}, {q(phrase)}, CASE WHEN {absent} THEN '' ELSE {q(phrase)} END)"
    return out
