import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import calls as C


def test_a_window_of_slow_calls():
    """Fifty calls of 0.1 s end together; replies come as they end."""
    lock, now, most = threading.Lock(), [0], [0]

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.1 if x else 0.3)
        with lock:
            now[0] -= 1
        return str(x)
    began = time.monotonic()
    got = list(C.window(((i, i) for i in range(50)), call, in_flight=50))
    assert time.monotonic() - began < 2.5 and most[0] > 25  # one by one they take over 5 s
    assert got[-1][0] == 0 and sorted(g[0] for g in got) == list(range(50)) and all(g[3] == 1 for g in got)
    most[0] = 0
    list(C.window(((i, i) for i in range(30)), call, in_flight=4))
    assert most[0] == 4


def test_the_rate_holds_and_items_are_taken_as_needed():
    starts, taken = [], []

    def call(x):
        starts.append(time.monotonic())
        return "r"

    def items():
        for i in range(40):
            taken.append(i)
            yield i, i
    found = C.window(items(), call, in_flight=5, rate=100)
    next(found)
    assert len(taken) <= 12
    list(found)
    assert len(starts) == 40 and starts[-1] - starts[0] >= 0.38
    assert all(sum(s <= x < s + 0.1 for x in starts) <= 15 for s in starts)


def test_one_back_off_does_not_hold_the_others():
    tries = Counter()

    def call(x):
        tries[x] += 1
        if x == 0 and tries[x] < 3:
            raise OSError("busy")
        if x == 1:
            return "bad"
        if x == 2:
            raise KeyError("no")
        return "ok"
    began, ended = time.monotonic(), {}
    for key, reply, error, n in C.window(((i, i) for i in range(20)), call, in_flight=3, backoff=0.5, max_retries=4, valid=lambda r: r != "bad", retryable=lambda e: not isinstance(e, KeyError)):
        ended[key] = (reply, error, n, time.monotonic() - began)
    assert all(ended[i][:3] == ("ok", None, 1) and ended[i][3] < 0.5 for i in range(3, 20))
    assert ended[0][:3] == ("ok", None, 3) and ended[0][3] >= 1.5
    assert ended[1][:3] == (None, "invalid reply", 4) and ended[2][:3] == (None, "KeyError: 'no'", 1)


def _requests(spark, n):
    return spark.range(n).select(F.concat(F.lit("r"), "id").alias("request_id"), F.concat(F.lit("p"), "id").alias("prompt"))


def _logged(path, die_at=None, sleep=0.0):
    def make():
        def call(prompt):
            with open(path, "a") as f:
                f.write(prompt + "\n")
            time.sleep(sleep)
            if die_at is not None and sum(1 for _ in open(path)) >= die_at:
                os._exit(1)  # as if the executor were lost
            return prompt.upper()
        return call
    return make


def test_call_model(spark, tmpdir_path):
    got = {r.request_id: r for r in C.call_model(_requests(spark, 200), _logged(f"{tmpdir_path}/log"), tasks=3, in_flight=8).collect()}
    assert len(got) == 200 and got["r7"].response == "P7" and got["r7"].attempts == 1 and got["r7"].error is None
    with pytest.raises(ValueError, match="tasks"):
        C.call_model(_requests(spark, 1), _logged("x"), rate=5)


def test_a_lost_task_repeats_only_its_open_calls(spark, tmpdir_path, monkeypatch):
    path, log = f"{tmpdir_path}/ledger", f"{tmpdir_path}/log"
    requests, flight = _requests(spark, 300), 5

    def run(make):
        return C.call_into_ledger(requests, make, path, buckets=2, in_flight=flight)
    with pytest.raises(Exception):
        run(_logged(log, die_at=200, sleep=0.002))
    first = sum(1 for _ in open(log))
    kept = C.ledger_replies(spark, path).count()
    assert 0 < kept < 300
    got = {r.request_id: r.response for r in run(_logged(log)).collect()}
    assert got == {f"r{i}": f"P{i}" for i in range(300)}
    made = sum(1 for _ in open(log))
    assert made == first + 300 - kept  # what the ledger had was not asked again
    assert first - kept <= 2 * (C.TOGETHER + flight + 2)
    run(_logged(log))
    assert sum(1 for _ in open(log)) == made


def test_failures_are_asked_again_and_the_first_reply_counts(spark, tmpdir_path):
    path = f"{tmpdir_path}/ledger"

    def make(bad):
        def made():
            def call(prompt):
                if prompt in bad:
                    raise ValueError("refused")
                return f"{prompt} {len(bad)}"
            return call
        return made
    twice = _requests(spark, 10).unionByName(_requests(spark, 10))
    got = {r.request_id: r for r in C.call_into_ledger(twice, make({"p3"}), path, 3, max_retries=2, backoff_seconds=0.01).collect()}
    assert len(got) == 10 and (got["r3"].response, got["r3"].error, got["r3"].attempts) == (None, "ValueError: refused", 2)
    got = {r.request_id: r.response for r in C.call_into_ledger(twice, make(set()), path, 3).collect()}
    assert got == {f"r{i}": f"p{i} {0 if i == 3 else 1}" for i in range(10)}
    store, root = C._store(path)
    C._commit(store, f"{root}/bucket=0", [("r4", "later", None, 1)])  # another attempt, too late
    assert {r.response for r in C.ledger_replies(spark, path).where("request_id = 'r4'").collect()} == {"p4 1"}
    assert C.ledger_replies(spark, f"{tmpdir_path}/none").collect() == []
