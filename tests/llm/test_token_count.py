import random

import public_tokenizers
from tokenizers import Tokenizer

from colloquy.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'S", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "é", "ß", "1", "٣", "²", "!", "<|endoftext|>", "<|endof", "日本", "\u0301", "😀", "\x00",
         "\u200d", "\x85", "\U0001e030", "\ufffd", "'ll", "\u2019", "\u0378", "\U000323af", "\U0003fc3b"]


def test_counts_equal_the_library():
    draw, tok = random.Random(1), Tokenizer.from_file(PATH)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    whole = token_count.whole_tokens(PATH)
    assert 49_000 < len(whole) <= 50_257
    assert token_count.Counter(PATH, whole).count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_query_on_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "hello <|endoftext|> world"), (3, "long " * 60000), (3, "long " * 60000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    tok = Tokenizer.from_file(PATH)
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in token_count.token_counts(docs, PATH).collect()), key=repr) == want
    assert token_count.token_counts(docs.limit(0), PATH).collect() == []


def test_other_files_are_refused():
    import pytest
    with pytest.raises(ValueError):
        token_count.whole_tokens(public_tokenizers.path("word_bpe_49k.json"))
