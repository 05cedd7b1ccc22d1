"""Near duplicates against brute force over all pairs of sets."""

import random

import pytest

from lattica.operators.components import components
from lattica.llm import near_dup
from lattica.llm.near_dup import Measure, near_duplicates, one_of_each

CONTRACT, PIPELINE = Measure(3, 85, 100), Measure(5, 80, 100)


def plain_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(docs, m):
    """Rows as near_duplicates gives them, from all pairs that share a shingle."""
    sets = [(i, plain_set(t, m.words)) for i, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_set = {}
    for i, s in sets:
        if i is not None and s:
            by_set.setdefault(frozenset(s), []).append(i)
    for ids in by_set.values():
        for i in ids:
            a, b = find(ids[0]), find(i)
            root[max(a, b)] = min(a, b)
    distinct, index = list(by_set), {}
    for k, s in enumerate(distinct):
        near = {}
        for x in s:
            for j in index.get(x, ()):
                near[j] = near.get(j, 0) + 1
            index.setdefault(x, []).append(k)
        for j, both in near.items():
            if m.den * both >= m.num * (len(s) + len(distinct[j]) - both):
                a, b = find(by_set[s][0]), find(by_set[distinct[j]][0])
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def made(seed):
    """Groups of edited copies about an original, chains, short texts and shared passages."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(400))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rnd.choice([4, 10, 40, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([1, 2, 40])):
            new = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25)):
                new[rnd.randrange(len(new))] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(300)]
    for _ in range(25):
        texts.append(" ".join(chain))
        chain = chain[6:] + [word() for _ in range(6)]
    texts += [passage + " " + " ".join(word() for _ in range(rnd.randrange(5, 80))) for _ in range(120)]
    texts += ["a", "a b", "a  B", "A b", "b a", "", "  ", None, " ", "Ä x y", "ä x y", "x\x0by z"] * 2
    rnd.shuffle(texts)
    return [(k * 7 % 100_003, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("m", [CONTRACT, PIPELINE, Measure(1, 1, 2)])
def test_made_texts(spark, m):
    docs = made(m.words)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n int")
    assert sorted(map(tuple, near_duplicates(df, m).collect()), key=str) == brute(docs, m)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(df, CONTRACT).collect()), key=str) == brute(docs, CONTRACT)


def test_repeats_nulls_and_empty(spark):
    docs = [(4, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "other words are here"), (7, "other words are here"), (7, "other words are here"), (None, "a b c d e f g h"), (9, None), (1, "")]
    df = spark.createDataFrame([(*d, True) for d in docs], "doc_id bigint, text string, kept boolean")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, CONTRACT).collect()), key=str)
    want = [(4, 6, 2, False), (2, 6, 2, True), (2, 2, 2, True), (7, 2, 2, False), (7, 2, 2, False), (None, 6, None, True), (9, 0, 9, True), (1, 0, 1, True)]
    assert got == sorted(want, key=str)
    kept = one_of_each(df, CONTRACT)
    assert kept.columns == df.columns and sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "2", "2", "9", "None"]
    assert near_duplicates(df.limit(0), CONTRACT).collect() == []


def test_large_group_without_all_pairs(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 1500):
        new = list(base)
        new[rnd.randrange(120)] = f"own{i}"
        docs.append((i, " ".join(new)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["component_id"] for r in near_duplicates(df, CONTRACT).collect()} == {0}


def copies_without_original(n, seed=3):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(100)]
    docs = []
    for i in range(n):
        new = list(base)
        for _ in range(rnd.randrange(1, 5)):
            new[rnd.randrange(100)] = f"w{rnd.randrange(900)}"
        docs.append((i, " ".join(new)))
    return docs


def test_copies_without_original_match_brute_force(spark):
    docs = copies_without_original(700)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, near_duplicates(df, CONTRACT).collect()), key=str) == brute(docs, CONTRACT)


def test_pairs_met_grow_with_the_group_not_its_square(spark, monkeypatch):
    met, plain = [], near_dup._all_pairs

    def counted(*args):
        out = near_dup.cut(plain(*args))
        met.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "_all_pairs", counted)
    df = spark.createDataFrame(copies_without_original(3000), "doc_id bigint, text string")
    assert near_duplicates(df, CONTRACT).count() == 3000
    assert sum(met) < 20 * 3000


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"), CONTRACT)


def test_components_of_a_long_chain(spark):
    n = 400
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_bounds():
    assert CONTRACT.least_overlap(1) == 1 and CONTRACT.prefix(1) == 1
    assert CONTRACT.least_overlap(20) == 17 and CONTRACT.prefix(20) == 4
    assert 30 <= CONTRACT.shared <= 40 and CONTRACT.prefix(10_000) == 64 - CONTRACT.shared + 1
