"""Token counts against the tokenizers library."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lattica.llm.token_count import count_tokens, merger

NAME = "word_bpe_49k.json"
ODD = [
    "", " \n\t ", "a", "Hello, WORLD!", "don't they've I'LL x'sy", "naïve ÉCOLE Straße ΣΑΣ İstanbul", "e\u0301 \u1e9b\u0323 ﬁ Å",
    "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|> <|x|>", "日本語のテキスト 한국어 русский", "٣٤ ½ ² Ⅷ 12345",
    "\x1ca\x1db\x1e \x1f", "a\u00a0b\u2003c\u3000d\u200be", "\x00\x01 \x7f", "👩‍👩‍👧 ok 🇩🇪", "_snake_case__x--y...z!!!?", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "ab" * 5000, "q\u0307\u0323 \u0301 alone", "\ud7ff\ue000", "'s 're 'LL ''s",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_counts_equal_the_library_on_odd_texts(library):
    m = merger(NAME)
    for text in ODD:
        assert m.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_equal_the_library_on_documents(library):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' LIMIT 400").fetchall()]
    m = merger(NAME)
    assert [m.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (None, "é", "x"), (1, "one two", "x"), (4, "word " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(docs, NAME, 2048).collect()), key=str)
    assert got == sorted([(1, 7, 2, False), (2, 0, 0, False), (3, 0, 0, False), (None, 2, 1, False), (1, 7, 2, False), (4, 15000, 3000, True)], key=str)
    assert count_tokens(docs.limit(0), NAME, 2048).collect() == []
