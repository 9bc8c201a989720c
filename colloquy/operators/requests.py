"""Model-call surface: request tables, routing, response joins and the
batched call operator.

The external model is a user function.  Requests are plain rows with a
stable ``request_id``; replies come back either from ``apply_model`` (the
user's batch function run inside Arrow-batched ``mapInPandas`` tasks) or
as a table from any batch service, joined back on ``request_id``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions.text import any_keyword

# Provider routing by keywords of the model name, in order.
PROVIDER_RULES: list[tuple[str, list[str]]] = [
    ("openai", ["gpt", "mini", "o1"]),
    ("anthropic", ["claude", "haiku"]),
    ("local", ["/"]),
]
UNSUPPORTED = "unsupported"
# The simulated patient always answers with this model.
PATIENT_PROVIDER = "openai"
PATIENT_MODEL = "gpt-4o-mini"
MISSING_RESPONSE = "Error"
# Fixed value: system message of the stages that have no prompt of their own.
DEFAULT_SYSTEM = "You are a helpful assistant."


def request_id(stage: str, *parts) -> Column:
    """Stable id: SHA-256 of the stage and each part with its length (a NULL
    part is ``|-``), so different keys never give the same text."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    marked = [F.coalesce(F.concat(F.lit("|"), F.length(t).cast("string"), F.lit(":"), t), F.lit("|-")) for t in texts]
    return F.sha2(F.concat(F.lit(stage), *marked), 256)


def messages(prompt: Column, system: Column | str | None = None) -> Column:
    """``ARRAY<STRUCT<role, content>>`` of a system and a user message."""
    head = system if isinstance(system, Column) else F.lit(DEFAULT_SYSTEM if system is None else system)
    return F.array(F.struct(F.lit("system").alias("role"), head.alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def last_replies(replies: DataFrame, order_col: str | None = None) -> DataFrame:
    """One reply per request: the last by ``order_col`` that has a text; at-least-once services
    deliver some twice.  Without an order column, the greatest text."""
    order = F.col(order_col) if order_col else F.col("response")
    has = F.col("response").isNotNull()
    return replies.groupBy("request_id").agg(F.max_by("response", F.when(has, order)).alias("response"))


def packed_id(col: str = "request_id") -> Column:
    """A request id in half the bytes: the 32 bytes of a SHA-256 text, any
    other text whole behind a zero byte (so two ids never become one)."""
    c = F.col(col)
    digest = (F.octet_length(c) == 64) & (F.lower(F.hex(F.unhex(c))) == c)
    return F.when(digest, F.unhex(c)).otherwise(F.concat(F.lit(b"\0"), c.cast("binary")))


def attach_replies(reqs: DataFrame, replies: DataFrame, order_col: str | None = None) -> DataFrame:
    """Requests with the last reply to each (``last_replies``), by packed id:
    ids are most of what such a join moves."""
    shown = [*[c for c in reqs.columns if c != "request_id"], "request_id", "response"]
    some = replies.select(packed_id().alias("request_id"), "response", *([order_col] if order_col else []))
    last = last_replies(some, order_col).withColumnRenamed("request_id", "__id")
    return reqs.withColumn("__rid", packed_id()).join(last, F.col("__rid") == F.col("__id"), "left").select(*shown)


def emit_requests(df: DataFrame, stage: str, key_cols: Sequence[str], prompt: Column,
                  system: Column | None = None) -> DataFrame:
    """``(request_id, stage, keys..., messages)`` with a system and a user
    message; the caller filters failed rows first so they cost no call."""
    return df.select(request_id(stage, *key_cols).alias("request_id"), F.lit(stage).alias("stage"),
                     *key_cols, messages(prompt, system).alias("messages"))


def route_provider(model: Column, n_messages: Column) -> tuple[Column, Column]:
    """(provider, target model) of one call: an even message count goes to
    the model under test (provider by name keywords), an odd one to the
    patient model."""
    provider = F.lit(UNSUPPORTED)
    for name, words in reversed(PROVIDER_RULES):
        provider = F.when(any_keyword(model, words), F.lit(name)).otherwise(provider)
    even = (n_messages % 2) == 0
    return (F.when(even, provider).otherwise(F.lit(PATIENT_PROVIDER)),
            F.when(even, model).otherwise(F.lit(PATIENT_MODEL)))


def join_responses(requests: DataFrame, responses: DataFrame, how: str = "left",
                   on: str | list[str] = "request_id") -> DataFrame:
    """Requests with their reply (replaces the future -> row-index map); by
    the natural key where the replies still carry it, which is narrower."""
    return requests.join(responses, on, how)


def with_missing_default(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Missing reply -> ``Error`` plus a ``missing`` flag."""
    return df.withColumn("missing", F.col(response_col).isNull()).withColumn(
        response_col, F.coalesce(F.col(response_col), F.lit(MISSING_RESPONSE)))


# ------------------------------------------------------------------ U1/U2

def _call_batch(fn, items: list, valid, retryable, max_retries: int, backoff: float):
    """One call for the whole batch, then calls for the items that failed or
    whose reply is not valid, all of them together, with one back-off per
    round.  ``attempts`` counts every call an item took part in."""
    n = len(items)
    responses, errors, attempts = [None] * n, [None] * n, [0] * n

    def call(which: list[int]) -> None:
        for i in which:
            attempts[i] += 1
        out = list(fn([items[i] for i in which]))
        if len(out) != len(which):
            raise ValueError(f"model returned {len(out)} replies for {len(which)} prompts")
        for i, r in zip(which, out):
            if valid is None or valid(r):
                responses[i], errors[i] = r, None
            else:
                responses[i], errors[i] = None, "invalid reply"

    todo = list(range(n))
    for attempt in range(max_retries):
        if attempt and backoff:
            time.sleep(backoff * 2 ** (attempt - 1))
        left = []
        try:
            call(todo)
            left = [i for i in todo if errors[i]]
        except Exception as e:  # noqa: BLE001 - one item may spoil the batch: ask for each
            if len(todo) == 1:
                errors[todo[0]] = f"{type(e).__name__}: {e}"
                left = todo if retryable(e) else []
            else:
                for i in todo:
                    if attempts[i] >= max_retries:
                        errors[i] = f"{type(e).__name__}: {e}"
                        continue
                    try:
                        call([i])
                        again = errors[i] is not None
                    except Exception as single:  # noqa: BLE001
                        errors[i] = f"{type(single).__name__}: {single}"
                        again = retryable(single)
                    if again:
                        left.append(i)
        todo = [i for i in left if attempts[i] < max_retries]
        if not todo:
            break
    return responses, errors, attempts


def apply_model(df: DataFrame, make_fn: Callable[[], Callable[[list], list[str]]],
                prompt_col: str = "prompt", id_col: str = "request_id", batch_size: int = 16,
                max_retries: int = 5, backoff_seconds: float = 1.0,
                valid: Callable[[str], bool] | None = None,
                retryable: Callable[[Exception], bool] | None = None) -> DataFrame:
    """Run the user's batch model over ``prompt_col``.

    ``make_fn()`` is called once per task (a client per task, like a
    thread-local client) and must return ``fn(list) -> list[str]``; its
    items are texts, or lists of ``{role, content}`` when ``prompt_col`` is a
    messages column.  A reply for which ``valid`` is false is asked for again;
    an exception is retried if ``retryable`` says so (default: always).  Rows
    reach Python as Arrow batches; a failing row ends with ``response = NULL``,
    the error text and the number of calls made instead of failing the job.
    Concurrency is the number of partitions: ``repartition(n)`` first to
    bound the calls in flight."""

    from colloquy.session import ship_package
    ship_package(df.sparkSession)
    again = retryable or (lambda e: True)

    def shown(x):
        return x if x is None or isinstance(x, str) else [{"role": m["role"], "content": m["content"]} for m in x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in batches:
            ids = pdf[id_col].tolist()
            prompts = [shown(x) for x in pdf[prompt_col].tolist()]
            for i in range(0, len(prompts), batch_size):
                r, e, a = _call_batch(fn, prompts[i:i + batch_size], valid, again, max_retries, backoff_seconds)
                yield pd.DataFrame({"request_id": ids[i:i + batch_size], "response": r, "error": e,
                                    "attempts": pd.Series(a, dtype="int32")})

    return df.select(F.col(id_col).cast("string").alias(id_col), prompt_col).mapInPandas(run, schemas.MODEL_RESULT)


# ------------------------------------------------------------------ R9

def batch_ids(df: DataFrame, partition_cols: list[str], order_cols: list[str], size: int) -> DataFrame:
    """``batch_id = floor(rank / size)`` with a dense 0-based rank per
    partition key in ``order_cols`` order, computed without a window over
    a whole key (see ``ranking.dense_index``)."""
    from colloquy.operators.ranking import dense_index
    ranked = dense_index(df, partition_cols, order_cols, "__rank")
    return ranked.withColumn("batch_id", F.floor(F.col("__rank") / size).cast("bigint")).drop("__rank")
