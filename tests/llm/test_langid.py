"""Language ID: the forward sum against enumeration, and held-out accuracy."""

import math
from zlib import crc32

import numpy as np

from lattica.llm import langid
from lattica.llm.queries import PIECE_VOCABULARY, op7_language

PARTS = {"en": "the cat and the dog were in the house", "fr": "le chat et le chien sont dans la maison", "de": "die Katze und der Hund sind im Haus"}


def enumerated(model, word):
    """Sum over all segmentations, one by one."""
    word, tree = langid.EDGE + word, langid.piece_tree(model.vocabulary)

    def rest(i):
        if i == len(word):
            return np.ones(len(model.languages))
        return sum(model.probability[k] * rest(j) for j, k in langid.spans(word, tree)[i])

    return np.log(rest(0))


def test_forward_sums_all_segmentations():
    model = langid.fit({k: {w: 1 for w in v.split()} for k, v in PARTS.items()}, PIECE_VOCABULARY)
    for word in ["the", "house", "katze", "x", "žluť", "不明字", "a-b,c", ""]:
        assert np.allclose(model.word(word), enumerated(model, word)), word


def test_many_words_at_once_equal_one_by_one(monkeypatch):
    model = langid.fit({k: {w: 1 for w in v.split()} for k, v in PARTS.items()}, PIECE_VOCABULARY)
    words = sorted({w for v in PARTS.values() for w in v.split()} | {"x", "žluť", "不明字", "a-b,c", "", "q" * 31, "the" * 10, "é\U0001f600z"}, key=len)
    assert np.allclose(model.many(words), [model.word(w) for w in words])
    texts = ["the cat", None, "1 2", "q" * 40 + " le chat " + "z" * 200, " ".join(words), "die Katze die Katze"]
    want = list(langid.Scorer(model).texts(texts))
    monkeypatch.setattr(langid, "CACHE_WORDS", 3)
    monkeypatch.setattr(langid, "GATHERED_CHARS", 5)
    monkeypatch.setattr(langid, "TOGETHER_WORDS", 2)
    got = list(langid.Scorer(model).texts(texts))
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    total = sum(np.array(model.word(w)) for w in texts[3].split())
    assert want[3][0] == model.languages[int(total.argmax())]


def test_long_words_do_not_underflow():
    model = langid.fit({k: {w: 1 for w in v.split()} for k, v in PARTS.items()}, PIECE_VOCABULARY)
    one, two = np.array(model.word("thecat" * 400)), np.array(model.word("thecat" * 800))
    assert np.isfinite(two).all() and (two < one).all() and np.allclose(two / one, 2, rtol=0.02)


def test_fit_sums_to_one_and_prefers_own_words():
    model = langid.fit({k: {w: 5 for w in v.split()} for k, v in PARTS.items()}, PIECE_VOCABULARY)
    assert np.allclose(model.probability.sum(axis=0), 1)
    scorer = langid.Scorer(model)
    for lang, text in PARTS.items():
        ((got, score),) = scorer.texts([text])
        assert got == lang and 0 < score <= 1


def test_rows(spark):
    docs = spark.createDataFrame([(1, PARTS["en"], "en", 1), (2, None, "en", 2), (3, "12 34 !", "en", 3), (None, PARTS["fr"], "fr", 4), (5, "", None, 5), (6, "q" * 5000, "fr", 6)] + [(7, PARTS["de"], "de", 7)] * 2, "doc_id bigint, text string, lang string, score int")
    model = langid.train(docs, PIECE_VOCABULARY)
    got = sorted(map(tuple, langid.predict(docs, model).collect()), key=str)
    assert [(i, x) for i, x, _ in got if i != 6] == sorted([(1, "en"), (2, "und"), (3, "und"), (None, "fr"), (5, "und"), (7, "de"), (7, "de")], key=str)
    assert all(0 <= s <= 1 and not math.isnan(s) for _, _, s in got)
    assert langid.predict(docs.limit(0), model).collect() == []
    untrained = langid.train(docs.limit(0), PIECE_VOCABULARY)
    assert {r["lang_pred"] for r in langid.predict(docs, untrained).collect()} == {"und"}


def test_held_out_accuracy(spark):
    rows = op7_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    print("held-out accuracy", right, len(held))
    assert right > 0.95


def test_language_without_spaces(spark):
    zh, ja = "今天天气很好我们一起去公园散步然后回家吃饭" * 8, "これはとてもよいほんですからぜひよんでみてください" * 8
    docs = spark.createDataFrame([(1, zh, "zh"), (2, ja, "ja"), (3, PARTS["en"], "en")], "doc_id bigint, text string, lang string")
    model = langid.train(docs, PIECE_VOCABULARY)
    assert model.languages == ("en", "ja", "zh")
    new = spark.createDataFrame([(1, "我们今天去公园吃饭"), (2, "よいほんですよ"), (3, "the cat")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(new, model).collect()} == {1: "zh", 2: "ja", 3: "en"}
    run = zh[:150]
    assert [p.lstrip(" ") for p in langid.parts(run)] == [run[:64], run[64:128], run[128:]]
    assert (langid.fit({"zh": {run: 2}}, PIECE_VOCABULARY).probability == langid.fit({"zh": dict.fromkeys(langid.parts(run), 2)}, PIECE_VOCABULARY).probability).all()
