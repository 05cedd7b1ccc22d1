"""Mixing: budgets by a plain water-filling, and prefixes by a plain walk over each leaf."""

import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lattica.llm.mixing import budgets, mix, take_mixture
from lattica.llm.queries import DOMAINS, MIX_SEED, MIX_WEIGHTS

DOCS = "doc_id bigint, text string, lang string, source string, copies int"


def divide(amount, weights, room):
    """Plain water-filling in fractions: whoever can't take its share is filled, and the rest is shared anew."""
    got = [0] * len(room)
    for group in ([k for k in range(len(room)) if weights[k] > 0], [k for k in range(len(room)) if weights[k] == 0]):
        w = {k: Fraction(str(weights[k] or 1)) for k in group}
        left, open_ = amount - sum(got), set(group)
        while full := [k for k in open_ if left * w[k] >= room[k] * sum(w[x] for x in open_)]:
            for k in full:
                got[k] = min(room[k], left)
                left -= got[k]
                open_.remove(k)
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        for k in open_:
            got[k] = math.floor(share[k])
        for k in sorted(open_, key=lambda k: (got[k] - share[k], k))[: left - sum(got[k] for k in open_)]:
            got[k] += 1
    return got


def plain_budgets(leaves, weights, amount, epochs):
    def below(path, budget):
        depth = len(path) + 1
        names = sorted({k[:depth] for k in leaves if k[: depth - 1] == path}, key=lambda p: (p[-1] is not None, p[-1] or ""))
        if depth > 3:
            return {path: budget}
        room = [epochs * sum(n for k, n in leaves.items() if k[:depth] == p) for p in names]
        out = {}
        for p, b in zip(names, divide(budget, [weights.get(p, 1) for p in names], room)):
            out |= below(p, b)
        return out

    return below((), min(amount, epochs * sum(leaves.values())))


def spark_budgets(spark, leaves, weights, amount, epochs):
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, tokens bigint")
    return {(r["domain"], r["lang"], r["source"]): r["budget"] for r in budgets(df, weights, min(amount, epochs * sum(leaves.values())), epochs).collect()}


def test_divide():
    assert divide(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert divide(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert divide(100, [1, 1, 2], [10, 20, 30]) == [10, 20, 30]
    assert divide(10, [1, 1, 1], [100, 100, 100]) == [4, 3, 3]
    assert divide(10, [0, 1], [100, 4]) == [6, 4]
    assert divide(0, [1], [5]) == [0] and divide(5, [], []) == []


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 500, ("a", "y", "1"): 500, ("b", "x", "1"): 500}
    # a and b get 200 each, a's languages 100 each; source 1 has 10, its sibling takes the 40 that it lacks
    assert spark_budgets(spark, leaves, {}, 400, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    assert spark_budgets(spark, {("a", "x", "1"): 10, ("a", "y", "1"): 500, ("b", "x", "1"): 500}, {}, 400, 1) == {("a", "x", "1"): 10, ("a", "y", "1"): 190, ("b", "x", "1"): 200}
    assert spark_budgets(spark, {("a", "x", "1"): 10, ("b", "x", "1"): 500}, {}, 400, 2) == {("a", "x", "1"): 20, ("b", "x", "1"): 380}


def test_budgets_against_plain_fractions(spark):
    rnd = random.Random(3)
    for _ in range(6):
        leaves = {(rnd.choice("abc"), rnd.choice(["x", "y", None]), rnd.choice([None, *map(str, range(9))])): rnd.choice([0, 1, 7, 60, 10**6, 10**16 + 1]) for _ in range(40)}
        weights = {k[:d]: rnd.choice([0, 0.3, 1, 2.5, 7]) for k in leaves for d in (1, 2, 3) if rnd.random() < 0.4}
        amount = int(rnd.choice([0.0, 0.01, 0.5, 1, 1.7]) * sum(leaves.values()))
        got = spark_budgets(spark, leaves, weights, amount, 2)
        assert got == plain_budgets(leaves, weights, amount, 2) and sum(got.values()) == min(amount, 2 * sum(leaves.values()))


def test_many_sources(spark):
    """More sources than a driver should hold one by one."""
    n = 250_000
    leaves = spark.range(n).selectExpr("'web' AS domain", "'en' AS lang", "concat('s', id) AS source", "id % 10 AS tokens")
    got = budgets(leaves, {}, 600_000, 1).agg(F.sum("budget").alias("b"), F.max(F.col("budget") - F.col("tokens")).alias("over"), F.count("*").alias("n")).first()
    assert (got["b"], got["n"]) == (600_000, n) and got["over"] <= 0


def brute(spark, docs, share, epochs, weights=MIX_WEIGHTS):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    ids = spark.createDataFrame([(d[0], e) for d in docs for e in range(epochs + 1)], "i bigint, e bigint").selectExpr("i", "e", f"xxhash64({MIX_SEED}, e, i) AS h").collect()
    draw = {(r["i"], r["e"]): r["h"] for r in ids}
    by_leaf = defaultdict(list)
    for d in docs:
        by_leaf[(DOMAINS.get(d[3], "other"), d[2], d[3])].append((d[0], words(d[1])))
    tokens = {k: sum(n for _, n in v) for k, v in by_leaf.items()}
    got = plain_budgets(tokens, weights, int(share * sum(tokens.values())), epochs)
    out = defaultdict(int)
    for leaf, own in by_leaf.items():
        if not tokens[leaf]:
            continue
        whole, rest = divmod(got[leaf], tokens[leaf])
        total, going = 0, rest > 0
        for i, n in sorted(own, key=lambda x: (draw[x[0], whole], x[0])):
            total += n
            going = going and total <= rest
            if whole + going:
                out[i] += whole + going
    return dict(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.8, 4), (0.5, 1), (1.0, 1), (3.0, 2), (0.01, 3)])
def test_documents(spark, share, epochs):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    got = mix(df, DOMAINS, MIX_WEIGHTS, share, epochs, MIX_SEED)
    assert {r["doc_id"]: r["copies"] for r in got.collect()} == brute(spark, docs, share, epochs)


def test_nulls_empty_texts_and_clashing_names(spark):
    docs = [(1, "a b c", None, None), (2, None, "en", "src0"), (3, "", "en", "src9"), (4, "x " * 5000, "en", "src0"), (5, "y z", "en", "src0"), (6, "only", "fr", "src1"), (7, "a", None, "src1")]
    df = spark.createDataFrame([(*d, 9) for d in docs], DOCS)
    for share in (0.3, 1.0, 2.0):
        got = mix(df, DOMAINS, MIX_WEIGHTS, share, 2, MIX_SEED)
        assert {r["doc_id"]: r["copies"] for r in got.collect()} == brute(spark, docs, share, 2)
    taken = take_mixture(df, mix(df, DOMAINS, MIX_WEIGHTS, 1.0, 1, MIX_SEED))
    assert taken.columns == df.columns and len(taken.collect()) == 6  # a leaf without words gives nothing: src9
    twice = take_mixture(df, mix(df, DOMAINS, MIX_WEIGHTS, 2.0, 2, MIX_SEED))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted([1, 2, 4, 5, 6, 7] * 2)
    assert mix(df.limit(0), DOMAINS, MIX_WEIGHTS, 0.5, 1, 1).collect() == []
    with pytest.raises(ValueError):
        mix(df, DOMAINS, MIX_WEIGHTS, 0, 1, 1)
