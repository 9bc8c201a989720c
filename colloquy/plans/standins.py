"""Deterministic stand-ins for the external model, used by the test
bindings (no network call is ever made by the package or its tests)."""

from __future__ import annotations

import hashlib

REFUSE_MODULUS = 7
MAX_RETRIES = 3


def digest_reply(prompt: str) -> str:
    return "ok:" + hashlib.sha256(prompt.encode("utf-8")).hexdigest()


def make_echo_model():
    """Batch function answering every prompt with its SHA-256 digest."""
    def fn(prompts: list[str]) -> list[str]:
        return [digest_reply(p) for p in prompts]
    return fn


def make_refusing_model():
    """Like the echo model, but any batch holding a prompt whose length
    is a multiple of 7 fails (so those prompts fail on every retry)."""
    def fn(prompts: list[str]) -> list[str]:
        for p in prompts:
            if len(p) % REFUSE_MODULUS == 0:
                raise ValueError("refused")
        return [digest_reply(p) for p in prompts]
    return fn


def make_echo_call():
    """The same for services that answer one prompt per call."""
    return digest_reply


def make_refusing_call():
    def call(prompt: str) -> str:
        if len(prompt) % REFUSE_MODULUS == 0:
            raise ValueError("refused")
        return digest_reply(prompt)
    return call


# Stage stand-ins (end-to-end test of the stages; fixed, rule-based replies).

def make_organizer_model():
    """Always the same three statements, one a negation line to scrub."""
    return lambda prompts: ["- Fatigue\n- 두통이 없다.\n- Hypertension\n" for _ in prompts]


def make_comparer_model():
    """Answers with the statement after ``Statement: `` (without its dash),
    or the not-in-list label for an empty statement."""
    def fn(prompts):
        out = []
        for p in prompts:
            stmt = p.split("Statement: ", 1)[1].strip()
            ans = stmt[2:] if stmt.startswith("- ") else "Not in Gold Label"
            out.append(f"Reason: compared\nFinal Response: **{ans}**")
        return out
    return fn


def make_predictor_model():
    return lambda prompts: ["```yaml\nDiseases:\n  - D\n  - Other\n```" for _ in prompts]


def make_judge_model():
    return lambda prompts: ["Reasoning: same\nResult: " + ("True" if "['D'" in p else "False") for p in prompts]
