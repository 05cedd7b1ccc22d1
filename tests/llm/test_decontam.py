"""Leaks against brute force: every window of every item's size, by plain shingle sets."""

import random

import numpy as np
import pytest

from lattica.llm import shingles
from lattica.llm.decontam import BITS, LEAST_BLOCKS, NEAR, RADIUS, SIMILARITY, Items, fingerprints, leaks, without_leaks

DOCS, ITEMS = "doc_id bigint, text string, item_id int", "item_id bigint, text string, source string"


def plain_words(t):
    return (t or "").encode().lower().split()


def runs(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def brute(docs, items):
    """(doc, item) to the best similarity over all windows."""
    split = [(i, plain_words(t)) for i, t in items]
    split = [(i, w) for i, w in split if w]
    count = {}
    for _, w in split:
        for x in set(runs(w, min(5, len(w)))):
            count[x] = count.get(x, 0) + 1
    out = {}
    for d, t in docs:
        words = plain_words(t)
        for i, w in split:
            width, own = min(5, len(w)), set(runs(w, min(5, len(w))))
            total = sum(1 / count[x] for x in own)
            for p in range(max(1, len(words) - len(w) + 1)):
                held = own & set(runs(words[p : p + len(w)], width))
                s = sum(1 / count[x] for x in held) / total
                if s >= SIMILARITY - 1e-9:
                    out[d, i] = max(s, out.get((d, i), 0))
    return out


def made():
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else f"w{rnd.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([2, 4, 5, 9, 20, 37, 60])))) for k in range(25)]
    items += [(25, items[3][1]), (26, None), (27, ""), (28, "  "), (29, "Über alles   ÜBER\tALLES und noch mehr Wörter")]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rnd.choice([0, 3, 30, 200]))]
        if rnd.random() < 0.7:
            passage = rnd.choice(items)[1] or "x"
            w = passage.upper().split() if rnd.random() < 0.3 else passage.split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if w:
                    w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w = w[: max(1, int(len(w) * rnd.choice([0.7, 0.85, 0.95])))]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = w
        docs.append((d, rnd.choice([" ", "\n", "  "]).join(words)))
    return [*docs, (150, None), (151, ""), (151, " ")], items


def test_made_texts(spark):
    docs, items = made()
    df, bench = spark.createDataFrame([(*d, 1) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(df, bench).collect()}
    assert len(want) > 60 and {k: round(v, 9) for k, v in want.items()} == {k: round(r["similarity"], 9) for k, r in got.items()}
    assert all(0 <= r["distance"] <= RADIUS and r["n_windows"] >= 1 for r in got.values())
    for (d, i), r in got.items():  # the window named is the window scored
        window = plain_words(docs[d][1])[r["start_word"] : r["start_word"] + r["n_words"]]
        assert round(brute([(0, b" ".join(window).decode())], items)[0, i], 9) == round(r["similarity"], 9)
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in {k for k, _ in want})


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    df, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    docs, items = ([tuple(r) for r in x.collect()] for x in (df.select("doc_id", "text"), bench.select("item_id", "text")))
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in leaks(df, bench).collect()}
    assert got == {k: round(v, 9) for k, v in brute(docs, items).items()}


def test_repeats_nulls_and_empty(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0)], DOCS)
    bench = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "x")], ITEMS)
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in leaks(df, bench).collect()) == sorted([("1", "1")] * 4 + [("1", "None")] * 2 + [("None", "1")] * 2 + [("None", "None")])
    assert leaks(df.limit(0), bench).collect() == [] and leaks(df, bench.limit(0)).collect() == []
    assert len(without_leaks(df, bench.limit(0)).collect()) == 3


def test_long_text_far_apart_windows():
    rnd = random.Random(4)
    item = [f"i{rnd.randrange(1000)}" for _ in range(40)]
    words = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    for at in (0, 20_000, 59_960):
        words[at : at + 40] = item
    (got,) = Items([(7, " ".join(item))]).leaks(" ".join(words))
    assert (got.item, got.start, got.similarity, got.distance) == (7, 0, 1.0, 0) and got.windows > 3


def test_fingerprints_of_windows_equal_those_of_their_words():
    h = shingles.run_hashes(shingles.word_hashes(" ".join(f"w{k % 37}" for k in range(300))), 5)
    w = np.linspace(0.5, 1, len(h))
    starts = np.array([0, 5, 250])
    got = fingerprints(h, w, starts, 30)
    for s, g in zip(starts, got):
        assert (fingerprints(h[s : s + 30], w[s : s + 30], np.array([0]), 30)[0] == g).all()
    assert got.shape == (3, BITS // 8)


def test_edited_copies_of_repeated_items():
    """Shared wording weighs little beside a few foreign words; copies must be found all the same."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(500)}"
    common = [word() for _ in range(20)]
    texts = [[word() for _ in range(n)] for n in (24, 40, 40)] + [common + [word() for _ in range(20)], ["la"] * 8 + [word() for _ in range(30)]]
    items = [(10 * k + n, " ".join(t)) for k, t in enumerate(texts) for n in range(10)]
    items += [(100 + n, " ".join(common + [word() for _ in range(20)])) for n in range(10)]  # near-identical: half of their wording is shared
    docs = []
    for d in range(120):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 1, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice([word(), "la"])
        docs.append((d, " ".join([word() for _ in range(20)] + w + [word() for _ in range(20)])))
    index = Items(items)
    got = {(d, x.item): (round(x.similarity, 9), x.windows) for d, t in docs for x in index.leaks(t)}
    want = brute(docs, items)
    assert len(want) > 500 and {k: s for k, (s, _) in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert all(n >= 1 for _, n in got.values())


def test_weights_do_not_depend_on_blocks(spark, monkeypatch):
    """A shingle's weight is shared among the items of all blocks."""
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(2000)}"
    common = [word() for _ in range(20)]
    items = [(k, " ".join(common + [word() for _ in range(24)])) for k in range(12)] + [(12, "a b"), (13, "a b"), (14, None)]
    docs = [(k, " ".join([word() for _ in range(20)] + items[k][1].split()[20 - 3 * k % 20 :])) for k in range(12)]
    df, bench = spark.createDataFrame([(*d, 1) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    for size in (4000, 3):
        monkeypatch.setattr("lattica.llm.decontam.ITEM_BLOCK", size)
        assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in leaks(df, bench).collect()} == want
    assert len(want) > 8 and {r["doc_id"] for r in without_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_index_finds_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 256, (1, BITS // 8), np.uint8)
    own = {"prints": item, "near": np.ascontiguousarray(NEAR[:, item].transpose(2, 0, 1)).view(np.uint8)}
    for _ in range(400):  # as many bits differ as may, spread or crowded
        bits = np.unpackbits(item[0])
        places = rng.permutation(BITS)[:RADIUS] if rng.random() < 0.5 else (np.arange(RADIUS) + rng.integers(0, BITS - RADIUS))
        bits[places] ^= 1
        assert Items.candidates(own, np.packbits(bits)[None, :]) == [0]
    unlike = rng.integers(0, 256, (20_000, BITS // 8), np.uint8)
    passed = (sum(own["near"][block, unlike[:, block], 0].astype(int) for block in range(BITS // 8)) >= LEAST_BLOCKS).mean()
    assert 0 < passed < 0.01


def test_recall_at_the_similarity():
    """Of passages cut to hardly enough, between passages of other items, next to none is missed."""
    rnd = random.Random(7)
    items = [(k, " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([30, 40, 55])))) for k in range(60)]
    index, missed, there = Items(items), 0, 0
    for _ in range(60):
        parts = []
        for k in rnd.sample(range(60), 20):
            w = items[k][1].split()
            parts += w[: len(w) - int(0.2 * (len(w) - 4))]
        text = " ".join(parts)
        got = {x.item for x in index.leaks(text)}
        want = {i for _, i in brute([(0, text)], items)}
        there, missed = there + len(want), missed + len(want - got)
        assert got <= want
    assert there > 1000 and missed <= there // 1000


def test_ids_of_any_type_and_names(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert [tuple(r)[:2] for r in leaks(df, spark.createDataFrame([("i", text)], "item_id string, text string")).collect()] == [("d", "i")]
    assert [tuple(r)[:2] for r in leaks(df, spark.createDataFrame([(3, text)], "item_id int, text string")).collect()] == [("d", 3)]
    with pytest.raises(ValueError):
        leaks(df, df, item_col="doc_id")
