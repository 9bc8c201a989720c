"""Many model calls in flight per task, and a ledger that keeps every finished reply.

``apply_model`` (operators.requests) gives a batch function a batch at a time.  Services that answer one
request per call are better served by a window of calls: ``call_model`` keeps ``in_flight`` of them
open in each task, hands on replies in the order in which they come, lets a failed one wait for
its own back-off while the others go on, and keeps a task's calls within its share of ``rate``.

A job of Spark commits its output at the end, but replies are costly.  ``call_into_ledger`` therefore
writes finished replies as they come, a small Parquet file for each few of them, under the bucket of
their request; a file appears under its name only when it is complete.  A task owns a bucket: when
it is started anew, in the same job or a later one, it first reads which requests of the bucket have
a reply, so only the calls that were open or not yet written are made again.  ``ledger_replies``
keeps the first reply of each request, should two attempts of a task have asked at once.
"""

from __future__ import annotations

import heapq
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import schemas

LEDGER = T.StructType([*schemas.MODEL_RESULT.fields, T.StructField("committed", T.LongType())])
_LEDGER_ARROW = pa.schema([("request_id", pa.string()), ("response", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("committed", pa.int64())])
#: Replies that are written or handed on together, and seconds after which fewer are.
TOGETHER, SECONDS = 64, 1.0


class Pace:
    """Starts of calls at most ``rate`` per second, evenly spread (None: as they come)."""

    def __init__(self, rate: float | None):
        self.gap, self.next = (1.0 / rate if rate else 0.0), 0.0

    def wait(self, now: float) -> float:
        """Seconds until the next start is allowed; 0 takes it."""
        if now < self.next:
            return self.next - now
        self.next = now + self.gap
        return 0.0


def window(items: Iterator[tuple], call: Callable, in_flight: int = 50, rate: float | None = None, max_retries: int = 5, backoff: float = 1.0,
           valid: Callable[[str], bool] | None = None, retryable: Callable[[Exception], bool] | None = None) -> Iterator[tuple]:
    """``(id, response, error, attempts)`` of every ``(id, prompt)`` as calls end.  A call that fails, or
    whose reply is not valid, is made again after ``backoff`` * 2**(attempts - 1) seconds, without a
    thread waiting for it; at most twice ``in_flight`` items are held."""
    pace, later, ready, open_, n = Pace(rate), [], None, {}, 0
    more = True
    with ThreadPoolExecutor(in_flight) as pool:
        try:
            while True:
                hold = None  # seconds after which to look again
                while len(open_) < in_flight:
                    now = time.monotonic()
                    if ready is None:
                        if later and later[0][0] <= now:
                            ready = heapq.heappop(later)[2:]
                        elif more and len(open_) + len(later) < 2 * in_flight:
                            item = next(items, None)
                            more = item is not None
                            ready = (*item, 0) if more else None
                        if ready is None:
                            break
                    hold = pace.wait(time.monotonic())
                    if hold:
                        break
                    hold = None
                    open_[pool.submit(call, ready[1])] = ready
                    ready = None
                if later:
                    due = max(0.0, later[0][0] - time.monotonic())
                    hold = due if hold is None else min(hold, due)
                if not open_:
                    if ready is None and not later and not more:
                        return
                    time.sleep(hold or 0.0)
                    continue
                for done in wait(open_, hold if len(open_) < in_flight else None, FIRST_COMPLETED).done:
                    key, prompt, tries = open_.pop(done)
                    tries += 1
                    error, again, reply = None, True, None
                    try:
                        reply = done.result()
                        if valid is not None and not valid(reply):
                            error = "invalid reply"
                    except Exception as e:  # noqa: BLE001 - a failing call is a row, not the end of the job
                        error, again = f"{type(e).__name__}: {e}", retryable is None or retryable(e)
                    if error is None:
                        yield key, reply, None, tries
                    elif again and tries < max_retries:
                        n += 1
                        heapq.heappush(later, (time.monotonic() + backoff * 2 ** (tries - 1), n, key, prompt, tries))
                    else:
                        yield key, None, error, tries
        finally:
            for f in open_:
                f.cancel()


def _shown(x):
    return x if x is None or isinstance(x, str) else [{"role": m["role"], "content": m["content"]} for m in x]


def _items(batches: Iterator[pd.DataFrame], id_col: str, prompt_col: str, done: Callable[[str], bool] = lambda _: False) -> Iterator[tuple]:
    for pdf in batches:
        for key, prompt in zip(pdf[id_col].tolist(), pdf[prompt_col].tolist()):
            if not done(key):
                yield key, _shown(prompt)


def _together(results: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, since = [], time.monotonic()
    for r in results:
        held.append(r)
        if len(held) >= TOGETHER or time.monotonic() - since >= SECONDS:
            yield held
            held, since = [], time.monotonic()
    if held:
        yield held


def call_model(df: DataFrame, make_call: Callable[[], Callable], prompt_col: str = "prompt", id_col: str = "request_id", tasks: int | None = None,
               in_flight: int = 50, rate: float | None = None, max_retries: int = 5, backoff_seconds: float = 1.0,
               valid: Callable[[str], bool] | None = None, retryable: Callable[[Exception], bool] | None = None) -> DataFrame:
    """Replies of a service that answers one prompt (a text, or a list of ``{role, content}``) per
    call: request_id, response, error, attempts.  ``make_call()`` runs once per task and must return
    a function that several threads may use.  ``rate`` is the calls per second of the whole job; it
    needs ``tasks``, the number of partitions that share it."""
    from colloquy.session import ship_package
    ship_package(df.sparkSession)
    if rate and not tasks:
        raise ValueError("a rate needs the number of tasks that share it")
    share = rate / tasks if rate else None
    rows = df.select(F.col(id_col).cast("string").alias(id_col), prompt_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = window(_items(batches, id_col, prompt_col), make_call(), in_flight, share, max_retries, backoff_seconds, valid, retryable)
        for some in _together(found):
            r = pd.DataFrame(some, columns=["request_id", "response", "error", "attempts"])
            yield r.astype({"response": object, "error": object, "attempts": "int32"})

    return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, schemas.MODEL_RESULT)


# ---------------------------------------------------------------- ledger

def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _answered(store: fs.FileSystem, folder: str) -> set[str]:
    """The requests of a bucket that have a reply: as many ids as the bucket has."""
    found: set[str] = set()
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.endswith(".parquet") and not f.base_name.startswith("."):
            with store.open_input_file(f.path) as data:
                t = pq.read_table(data, columns=["request_id", "response"])
            found.update(t.filter(t.column("response").is_valid()).column("request_id").to_pylist())
    return found


def _commit(store: fs.FileSystem, folder: str, rows: list[tuple]) -> None:
    now = time.time_ns()
    columns = list(zip(*[(*r, now) for r in rows]))
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEDGER_ARROW)], schema=_LEDGER_ARROW)
    name = uuid.uuid4().hex
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{name}") as out:
        pq.write_table(table, out)
    store.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def ledger_replies(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, response, error, attempts``: the first reply of each request that has one, else its
    last failure."""
    spark.createDataFrame([], LEDGER).withColumn("bucket", F.lit(0)).write.mode("ignore").partitionBy("bucket").parquet(path)
    rows = spark.read.schema(T.StructType([*LEDGER.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    good, row = F.col("response").isNotNull(), F.struct("response", "error", "attempts")
    out = rows.groupBy("request_id").agg(F.min_by(row, F.when(good, F.col("committed"))).alias("g"), F.max_by(row, F.when(~good, F.col("committed"))).alias("b"))
    return out.select("request_id", F.coalesce("g", "b").alias("r")).select("request_id", "r.*")


def call_into_ledger(df: DataFrame, make_call: Callable[[], Callable], path: str, buckets: int, prompt_col: str = "prompt", id_col: str = "request_id",
                     in_flight: int = 50, rate: float | None = None, max_retries: int = 5, backoff_seconds: float = 1.0,
                     valid: Callable[[str], bool] | None = None, retryable: Callable[[Exception], bool] | None = None) -> DataFrame:
    """Calls as ``call_model`` makes them, one task per bucket, for the requests that the ledger in ``path``
    has no reply to, and writes each few replies as they come; returns ``ledger_replies``.  ``path`` must be
    in storage that tasks reach by its URI, ``buckets`` the same in every run over it.  Requests that ended
    in an error are asked again by the next run; a repeated request is asked once."""
    from colloquy.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    share = rate / buckets if rate else None
    key = F.col(id_col).cast("string")
    rows = df.select(key.alias(id_col), prompt_col, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        if first is None:
            return
        store, root = _store(path)
        folder = f"{root}/bucket={int(first['bucket'].iloc[0])}"
        seen = _answered(store, folder)

        def known(k: str) -> bool:
            return k in seen or seen.add(k) is not None

        def every() -> Iterator[pd.DataFrame]:
            yield first
            yield from batches

        found = window(_items(every(), id_col, prompt_col, known), make_call(), in_flight, share, max_retries, backoff_seconds, valid, retryable)
        for some in _together(found):
            _commit(store, folder, some)
            yield pd.DataFrame({"written": [len(some)]})

    rows.repartitionById(buckets, "bucket").mapInPandas(run, "written long").agg(F.sum("written")).collect()  # one number
    return ledger_replies(spark, path)
