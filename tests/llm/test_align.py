import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from colloquy.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "é", "ß", "1", "٣", "!", "<|endoftext|>", "<s>", "<0x41>", "▁", "日本", "́", "😀", "\x00", "‍", "͸", "'ll", "the", " house", "understanding", "�", "ﬁ"]


def brute(texts):
    """Straight loops over every pair of tokens of a text."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = align.byte_alphabet()
    rows, count = [], Counter()
    for t in texts:
        t = t or ""
        whole = (" " + t).encode()
        a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(sp.encode(t), sp.encode(t, out_type=str))] if t else []
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []

        def placed(tokens):
            out, at = [], 0
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out
        a, b = placed(a), placed(b)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        count.update(links)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(x[0]) for x in a if last <= x[1] < c) + "|" + ",".join(str(y[0]) for y in b if last <= y[1] < c))
            last = c
        rows.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(na, nb, ng, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, ls, g in rows]


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_equals_brute_force(spark, head):
    draw = random.Random(head)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(250)]
    texts += [None, "", " ", "\n", "a" * 1500 + " b", texts[0], "ﬁ x"]
    rows = [(i if i % 50 else None, t, 1, "k", 2) for i, t in enumerate(texts)] + [(7, texts[7], 1, "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, key string, pair int").repartition(5)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.align(docs, A, B, head=head).collect()]
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))]
    assert sum(w[1] > 0 for w in want) > 100
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_groups_as_rows(spark):
    docs = spark.createDataFrame([(1, "The understanding of <s>"), (2, None), (3, "Él <|endoftext|>")], "doc_id long, text string")
    found = {}
    for r in align.groups(docs, A, B).orderBy("doc_id", "group").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.stop, list(r.a), list(r.b)))
    digest = {r.doc_id: (r.n_groups, r.groups_sha256) for r in align.align(docs, A, B).collect()}
    for i, text in ((1, "The understanding of <s>"), (3, "Él <|endoftext|>")):
        assert [x[0] for x in found[i][1:]] == [x[1] for x in found[i][:-1]] and found[i][0][0] == -1 and found[i][-1][1] == len(text.encode())
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in found[i])
        assert digest[i] == (len(found[i]), hashlib.sha256(spelled.encode()).hexdigest())
    assert 2 not in found


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 4000)
    short = docs.where("length(text) < 4000 OR text IS NULL")
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.align(short, A, B).collect())
    assert got == [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))]


def test_other_files_and_empty_tables(spark):
    with pytest.raises(ValueError):
        align.Encoders(public_tokenizers.path("word_bpe_49k.json"), B)
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
