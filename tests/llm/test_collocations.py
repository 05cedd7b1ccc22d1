"""Collocations against a count of all phrases, by their definition."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm.collocations import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    longer = Counter()
    candidates = [p for p, a in f.items() if len(p) > 2 and a >= least]
    for p in candidates:
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i : i + k])
                longer[inner] = max(longer[inner], f[p])
    by_lang = {}
    for p in candidates:
        if 100 * longer[p] >= 80 * f[p]:
            continue
        cuts = [(2000000 * f[p] // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        by_lang.setdefault(p[0], []).append((-score, -f[p], " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, rank, phrase.decode(), -a, left, right, n[lang], -score) for lang, found in by_lang.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    return sorted(map(tuple, collocations(df, **options).collect()))


def texts(rnd, n, vocabulary, mean=60):
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]
    return ["".join(w + rnd.choice(ends) for w in rnd.choices(vocabulary, weights, k=rnd.randrange(2 * mean))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"cells": 1 << 16}, {"cells": 8}, {"hot_pairs": 20}, {"hot_pairs": 1_000_000}])
def test_against_all_phrases(spark, options):
    rnd = random.Random(5)
    words = ["the", "The", "of", "a", "É", "é", "\x00", "ﬁ", "x\u00a0y", "<s>", "'"] + [f"w{k}" for k in range(60)]
    rows = [(t, rnd.choice(["en", "en", "en", "de", None, "und", ""])) for t in texts(rnd, 500, words)]
    rows += [("one very common passage of the w1 w1 w1 w1 kind", "en")] * 400 + [("w7 " * 5000, "en"), (None, "en"), ("", None), (" .,\n", "fr")]
    got = run(spark, rows, **options)
    assert got == brute(rows) and len(got) > 60


def test_top_and_ties(spark):
    rows = [("b c. a b. é a; a b c d e", "x")] * 3 + [("k l m n", "y"), ("k l", "y"), ("a a a a a a", "z")]
    for top in (1, 3, 100):
        assert run(spark, rows, least=1, top=top) == brute(rows, least=1, top=top)
    assert run(spark, rows, least=3) == brute(rows, least=3)


def test_a_hot_language_and_pair(spark):
    rnd = random.Random(8)
    rows = [(t, "en") for t in texts(rnd, 200, [f"w{k}" for k in range(3000)])]
    rows = [(t.replace("w1 ", "w1 very common "), lang) for t, lang in rows]
    assert run(spark, rows, least=2, hot_pairs=50) == brute(rows, least=2)


def test_nothing(spark):
    assert run(spark, [(None, None), ("", "en"), ("a b", "en")]) == []
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_a_fragment_that_comes_very_often(spark):
    rows = [("a b", "en")] * 70_000 + [("b a", "en")] * 40
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert sorted(map(tuple, collocations(df).collect())) == brute(rows)
