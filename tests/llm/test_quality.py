import re

from colloquy.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    ws = WORD.findall(t)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    cover = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover)


CASES = [None, "", " \t\n ", "one", "a b c d e f g h " * 4, "é ü\u00a0x ñ\nline\nline\n\nline \n", "# $ |" * 30, "word " * 19, "word" + " w" * 40000,
         "x\x85y z\x0bq", "a\rb\x1fc 日本 語"]


def test_measurements_and_hard_cases(spark):
    rows = [(i, t, 7, "n") for i, t in enumerate(CASES)] + [(None, "a b", 7, "n"), (3, "one", 7, "n"), (3, "one", 7, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, failed string")
    got = sorted((tuple(r) for r in quality.quality_ledger(docs).select("doc_id", *quality.MEASURES).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t, *_ in rows), key=repr)
    kept = quality.passing(docs)
    assert kept.schema == docs.schema
    assert quality.quality_ledger(docs.limit(0)).collect() == []


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good), (2, "few"), (3, good + " #" * 9), (4, "# few")], "doc_id long, text string")
    rows = quality.ledger(docs)
    kept = {r.doc_id: (r.kept_base, r.kept_v2) for r in quality.apply_policies(rows, ("base", "v2")).collect()}
    assert kept == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False)}
    ablation = {r.rule: (r.n_failed, r.n_only) for r in quality.ablate(rows).collect()}
    assert ablation["symbol_noise"] == (2, 1) and ablation["too_few_words"][0] == 2 and ablation["word_length"] == (0, 0)


def test_the_query_ablates_by_bits(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good), (2, "few"), (3, good + " #" * 9), (4, "# few"), (5, "few too"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: (r.only_rule, r.alike) for r in quality.quality_ledger(docs).collect()}
    assert got[1] == (None, 1) and got[2] == got[5] == ("too_few_words", 3) and got[3] == ("symbol_noise", 1)
    assert got[4] == (None, 1) and got[6] == ("too_few_words", 3)


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_ledger(docs).join(labels, "doc_id").where("NOT base_failed")
    assert rows.where("quality = 1 AND NOT kept").count() == 0
    assert rows.where("quality = 0 AND kept").count() <= 2
