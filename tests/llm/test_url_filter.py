import math
import re
from collections import Counter, defaultdict

import pytest

from colloquy.llm import url_filter as U

RULES = U.RULES


def address(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return rest, re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def key(rest):
    low = re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), rest))
    return "^^^" + re.sub(r"[^a-z0./?=&_%:\-+#]", "~", low) + "$"


class Model:
    """Witten-Bell over the last three characters, read off one class's addresses."""

    def __init__(self, keys):
        self.n = defaultdict(Counter)
        for k in keys:
            for i in range(3, len(k)):
                for o in range(4):
                    self.n[k[i - o : i]][k[i]] += 1

    def chance(self, context, c):
        size = len(U.ALPHABET) - 1
        p = (self.n[""][c] + 1) / (sum(self.n[""].values()) + size)
        for o in range(1, 4):
            seen = self.n[context[3 - o :]]
            if seen:
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(self, k):
        return sum(math.log(self.chance(k[i - 3 : i], k[i])) for i in range(3, len(k))) / (len(k) - 3)


def test_scores_and_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    rows = [(p.page_id, p.url) for p in pages]
    rows += [(9001, None), (9002, "no scheme"), (9003, "http://A.COM"), (9004, "https://a.com/x?y#z"), (9004, "https://a.com/x?y#z"), (None, "x://www.example.com/en/q"),
             (9005, "http://example.com/en/"), (9006, "ftp://net/fr/a"), (9007, "http://xnet/fr/a"), (9008, "http://h://net/es/"), (9009, "http://é.org/ü\n?x"), (9010, "http://l.org/" + "p" * 20000), (9011, "://")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, host string, key int")
    got = U.judge(df).collect()
    assert len(got) == len(rows)
    facts = {u: address(u) for _, u in rows}
    labelled = [(key(facts[u][0]), rule(*facts[u][1:])[1]) for _, u in rows]
    allow, block = (Model([k for k, v in labelled if v == c]) for c in ("allow", "block"))
    by = {(i, *facts[u][1:]): u for i, u in rows}
    for r in got:
        u = by[r.page_id, r.host, r.path]
        assert (r.rule, r.verdict if r.rule else None) == rule(r.host, r.path)
        if len(u or "") < 1000:
            k = key(facts[u][0])
            assert r.score == pytest.approx(allow.score(k) - block.score(k), abs=1e-9)
        if not r.rule:
            assert r.verdict == ("allow" if r.p_allow >= 0.5 else "block")


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/y")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(df).collect()} == {1: "allow", 2: "allow"}
    assert U.judge(df.limit(0)).collect() == []
    assert [r.verdict for r in U.judge(df.where("page_id = 2")).collect()] == ["allow"]
