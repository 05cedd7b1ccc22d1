"""Encoding and decoding against the sentencepiece library, whole texts at a time."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from lattica.llm.sentence_pieces import Disagreement, agenda, encode_texts

NAME = "piece_bpe_32k.model"
ODD = [
    "", " ", "  ", " a", "a ", "  a  b ", "\u2581x", "x\u2581 y", "<s>hi</s> <unk> <0x41>", "\n\ta\r\n", "日本語 ǝ 😀 ① \u200b\xad", "a\x00b", "\ufffd",
    "e\u0301 ﬁ Å", "a" * 5000, "ab" * 3000 + " " + "日" * 200, " " * 300 + "x", "don't they've", "\ud7ff\ue000\U0010ffff", "\u2581" * 40, "x" * 31 + " " + "y" * 32 + " " + "z" * 33,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_odd_texts(library):
    a = agenda(NAME)
    for text in ODD:
        assert a.encode(text) == library.encode(text), repr(text)
    assert list(a.digests([None, *ODD])) == [expected(library, t) for t in [None, *ODD]]


def test_random_texts_and_ids(library):
    a, rnd = agenda(NAME), random.Random(3)
    signs = ["a", "b", "\u2581", " ", "  ", "\n", "日", "①", "é", "e\u0301", "😀", "<s>", "the", "ing", "\x00", "\xa0"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        ids = library.encode(text)
        assert a.encode(text) == ids and a.decode(ids) == library.decode(ids), repr(text)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(1, 32000), rnd.randrange(3, 259), 259, 28705]) for _ in range(rnd.randint(0, 8))]
        assert a.decode(ids) == library.decode(ids), ids


def test_both_agendas_agree():
    a, rnd = agenda(NAME), random.Random(4)
    words = ["\u2581" + "".join(rnd.choice("abdehilnorstuéß日①") for _ in range(rnd.randint(0, 31))) for _ in range(2000)]
    assert a.merged(words) == [a._by_heap(w) for w in words]


def test_a_table_that_is_full_is_emptied(library, monkeypatch):
    from lattica.llm import sentence_pieces

    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 50)
    a = sentence_pieces.Agenda(public_tokenizers.path(NAME))
    for k in range(20):
        texts = [f"word{k}x{j} again " + "long" * 30 + " \u2581" for j in range(20)]
        assert list(a.digests(texts)) == [expected(library, t) for t in texts]
    assert len(a.words) < 100 and not any(len(w) > 64 for w in a.words)


def test_a_disagreement_raises():
    a = agenda(NAME)
    with pytest.raises(Disagreement):
        a._check(["one", "two"], ["1", "2"], ["one", "two"])


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = {r[0]: tuple(r)[1:] for r in encode_texts(docs, NAME).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_rows(spark, library):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (None, "é", "x"), (1, "one two", "x"), (4, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, encode_texts(docs, NAME).collect()), key=str)
    assert got == sorted([(i, *expected(library, t)) for i, t, _ in rows], key=str)
    assert encode_texts(docs.limit(0), NAME).collect() == []
