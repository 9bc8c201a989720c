"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule accepts or rejects train one model each.  A model is a variable-order Markov
model over a small alphabet: the chance of a character after its last ``ORDER`` characters is
smoothed with that after one character less, weighted by how many different characters have
followed the context (Witten-Bell), down to a uniform chance.  Contexts that a model never saw
pass straight to the shorter one.  A URL's score is the difference of its two log-likelihoods
per character, calibrated to a chance of being accepted with the means and the variance that the
labelled URLs' scores have when the model comes from the other half of the hosts.

Everything is DataFrame code.  The table of distinct character runs is bounded by the alphabet
(41 ** 4 rows; a few tens of thousands in practice).  It is counted, and broadcast if it has at
most ``SMALL`` rows; else it is joined.  URLs are scored once per distinct normalised address.

Null URLs and those without ``://`` have empty host and path, no rule and an empty address, which
scores as a single end mark.  If the labelled URLs hold one class only, every other URL gets it;
if there are none, URLs are allowed.  Very long URLs are scored whole.  Repeated rows stay rows;
other columns, clashing names included, are not carried.  Of equally long rules that fit, the last in
the list counts; a chance of exactly one half allows.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import prepare

ORDER = 3
#: Rows of a model table that is broadcast at most (30 MB).
SMALL = 100_000
#: Rule: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Letters, one digit class, URL marks, one class for the rest, start and end.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "0" + "./?=&_%:-+#" + "~" + "^$"
_UPPER, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> tuple[Column, Column, Column]:
    """(everything after the first ``://``, host, path)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return rest, F.translate(host, _UPPER, _DOWN), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def normalised(rest: Column) -> Column:
    """The address in the model's alphabet, between start and end marks."""
    low = F.regexp_replace(F.translate(rest, _UPPER, _DOWN), "[0-9]+", "0")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(low, r"[^a-z0./?=&_%:\-+#]", "~"), F.lit("$"))


def _runs(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(key) - ORDER), lambda i: F.substring(key, i, F.lit(ORDER + 1)))


#: Classes and the half of the hosts that a model leaves out (2: none).
_MODELS = [(c, f) for c in ("allow", "block") for f in (0, 1, 2)]


def run_ratios(counts: DataFrame, hint=lambda df: df) -> DataFrame:
    """(run, n_<class>_<half>) to (run, ratio_0, ratio_1, ratio_2): the log ratio of the last
    character's chances under the two models, by the half of the hosts that was left out."""
    names = {m: f"n_{m[0]}_{m[1]}" for m in _MODELS}
    size = float(len(ALPHABET) - 1)  # the start mark is never predicted
    last = F.substring("run", ORDER + 1, 1)
    out = counts.select("run", *names.values())
    chance: dict = {}
    # order 0: characters of a class
    level = out.groupBy(last.alias("c")).agg(*[F.sum(n).alias(n) for n in names.values()])
    every = W.partitionBy(F.lit(0))
    level = level.select(F.col("c").alias("k0"), *[((F.col(n) + 1.0) / (F.sum(n).over(every) + size)).alias(f"p0_{n}") for n in names.values()])
    out = out.withColumn("k0", last).join(hint(level), "k0")
    for k in range(1, ORDER + 1):
        tail = F.substring("run", ORDER + 1 - k, k + 1)
        level = out.groupBy(tail.alias(f"k{k}")).agg(*[F.sum(n).alias(n) for n in names.values()])
        context = W.partitionBy(F.substring(f"k{k}", 1, k))
        level = level.select(f"k{k}", *[x for n in names.values() for x in (
            F.col(n).cast("double").alias(f"c{k}_{n}"), F.sum(n).over(context).cast("double").alias(f"s{k}_{n}"),
            F.sum((F.col(n) > 0).cast("double")).over(context).alias(f"t{k}_{n}"))])
        out = out.withColumn(f"k{k}", tail).join(hint(level), f"k{k}")
        for n in names.values():
            lower = F.col(f"p{k - 1}_{n}")
            seen = F.col(f"s{k}_{n}") + F.col(f"t{k}_{n}")
            out = out.withColumn(f"p{k}_{n}", F.when(seen > 0, (F.col(f"c{k}_{n}") + F.col(f"t{k}_{n}") * lower) / F.when(seen > 0, seen)).otherwise(lower))
    for m, n in names.items():
        chance[m] = F.log(F.col(f"p{ORDER}_{n}"))
    return out.select("run", *[(chance["allow", f] - chance["block", f]).alias(f"ratio_{f}") for f in (0, 1, 2)])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", keep: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, score (length-normalised log ratio) and p_allow."""
    prepare(pages.sparkSession)
    rest, host, path = address(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{keep}`").alias(keep), rest.alias("rest"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    rows = rows.select(keep, "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("label"), normalised(F.col("rest")).alias("key"), (F.conv(F.substring(F.md5("host"), 1, 1), 16, 10).cast("int") % 2).alias("half"))
    # rows per address, label and half of the hosts; a run counts once for each row that has it
    lots = rows.groupBy("key", "label", "half").agg(F.count("*").alias("n")).checkpoint()
    runs = lots.select("label", "half", "n", F.explode(_runs(F.col("key"))).alias("run"))
    counts = runs.groupBy("run").agg(*[F.coalesce(F.sum(F.when((F.col("label") == c) & (F.col("half") != f), F.col("n"))), F.lit(0)).alias(f"n_{c}_{f}") for c, f in _MODELS]).checkpoint()
    few = counts.count() <= SMALL  # no table of the model has more rows than this one
    hint = F.broadcast if few else (lambda df: df)
    ratios = run_ratios(counts, hint).checkpoint()
    keys = lots.select("key").distinct()
    parts = keys.select("key", F.explode(_runs(F.col("key"))).alias("run")).groupBy("key", "run").agg(F.count("*").alias("times"))
    scored = parts.join(hint(ratios), "run").groupBy("key").agg(*[(F.sum(F.col(f"ratio_{f}") * F.col("times")) / F.sum("times")).alias(f"score_{f}") for f in (0, 1, 2)]).checkpoint()
    held = lots.where("label IS NOT NULL").join(scored, "key").select("label", "n", F.when(F.col("half") == 0, F.col("score_0")).otherwise(F.col("score_1")).alias("x"))
    fit = {r["label"]: r for r in held.groupBy("label").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("square")).collect()}  # two rows
    if len(fit) < 2:
        only = next(iter(fit), "allow")
        p = F.lit(1.0 if only == "allow" else 0.0)
    else:
        a, b = fit["allow"], fit["block"]
        n = a["n"] + b["n"]
        var = max(1e-9, (a["square"] - a["n"] * a["mean"] ** 2 + b["square"] - b["n"] * b["mean"] ** 2) / n)
        x = F.col("score_2") - F.lit((a["mean"] + b["mean"]) / 2)
        logit = x * F.lit((a["mean"] - b["mean"]) / var) + F.log(F.lit(a["n"] / b["n"]))
        p = 1 / (1 + F.exp(-logit))
    scores = scored.select(F.col("key").alias("s_key"), "score_2")
    out = rows.join(scores, F.col("key") == F.col("s_key"))
    verdict = F.coalesce(F.col("label"), F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block"))
    return out.withColumn("p_allow", p.cast("double")).select(keep, "host", "path", "rule", verdict.alias("verdict"), F.col("score_2").alias("score"), "p_allow")


_LEVELS = "\n".join(f"""t{k} AS (SELECT c, f, substr(run, {ORDER + 1 - k}, {k + 1}) AS r, sum(n)::DOUBLE AS n FROM m GROUP BY ALL),
u{k} AS (SELECT c, f, r, n, sum(n) OVER w AS s, sum((n > 0)::INT) OVER w AS t FROM t{k} WINDOW w AS (PARTITION BY c, f, substr(r, 1, {k}))),
p{k} AS (SELECT p.run, p.c, p.f, CASE WHEN s + t > 0 THEN (n + t * p.p) / (s + t) ELSE p.p END AS p FROM p{k - 1} p
  JOIN u{k} u ON u.c = p.c AND u.f = p.f AND u.r = substr(p.run, {ORDER + 1 - k}, {k + 1})),""" for k in range(1, ORDER + 1))
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: DuckDB SQL of the rows of judge over pages, scores at 6 places.
ORACLE = rf"""
WITH a AS (SELECT page_id, rid, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_DOWN}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
  FROM (SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
ru(h, p, v) AS (VALUES {_RULES}),
b AS (SELECT a.*, x.rule, x.v AS label, ('0x' || substr(md5(host), 1, 1))::INT % 2 AS half,
    '^^^' || regexp_replace(regexp_replace(translate(rest, '{_UPPER}', '{_DOWN}'), '[0-9]+', '0', 'g'), '[^a-z0./?=&_%:\-+#]', '~', 'g') || '$' AS key
  FROM a LEFT JOIN (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM a JOIN ru
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid) x USING (rid)),
o AS (SELECT rid, key, label, half, substr(key, i, 4) AS run FROM (SELECT *, unnest(range(1, length(key) - 2)) AS i FROM b)),
mm AS (SELECT * FROM (SELECT unnest(['allow', 'block']) AS c), (SELECT unnest([0, 1, 2]) AS f)),
m AS (SELECT r.run, mm.c, mm.f, coalesce(n, 0) AS n FROM (SELECT DISTINCT run FROM o) r CROSS JOIN mm
  LEFT JOIN (SELECT run, c, f, count(*) AS n FROM o JOIN mm ON label = c AND half <> f GROUP BY ALL) k ON k.run = r.run AND k.c = mm.c AND k.f = mm.f),
z AS (SELECT c, f, substr(run, {ORDER + 1}, 1) AS r, sum(n)::DOUBLE AS n FROM m GROUP BY ALL),
p0 AS (SELECT m.run, m.c, m.f, (z.n + 1) / (sum_n + {float(len(ALPHABET) - 1)}) AS p FROM m JOIN z ON z.c = m.c AND z.f = m.f AND z.r = substr(m.run, {ORDER + 1}, 1)
  JOIN (SELECT c, f, sum(n) AS sum_n FROM z GROUP BY ALL) y ON y.c = m.c AND y.f = m.f),
{_LEVELS}
l AS (SELECT run, f, sum(CASE WHEN c = 'allow' THEN ln(p) ELSE -ln(p) END) AS x FROM p{ORDER} GROUP BY ALL),
s AS (SELECT rid, label, half, f, avg(x) AS score FROM o JOIN l USING (run) GROUP BY ALL),
g AS (SELECT label, count(*)::DOUBLE AS n, avg(score) AS mu, sum(score * score) AS sq FROM s WHERE label IS NOT NULL AND f = half GROUP BY label),
q AS (SELECT x.n AS na, y.n AS nb, x.mu AS ma, y.mu AS mb, greatest(1e-9, (x.sq - x.n * x.mu ** 2 + y.sq - y.n * y.mu ** 2) / (x.n + y.n)) AS v
  FROM (SELECT * FROM g WHERE label = 'allow') x, (SELECT * FROM g WHERE label = 'block') y),
e AS (SELECT rid, score, 1 / (1 + exp(-((score - (ma + mb) / 2) * (ma - mb) / v + ln(na / nb)))) AS p FROM s, q WHERE f = 2)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN p >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score, round(p, 6) AS p_allow
FROM b JOIN e USING (rid)"""
