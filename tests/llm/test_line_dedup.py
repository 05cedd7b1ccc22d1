"""Line dedup against brute force over all pairs of lines."""

import random

import pytest

from lattica.llm import line_dedup
from lattica.llm.line_dedup import character_counts, counts_apart, edit_distance, finer, is_last, place_key, places, probes, repeated_lines, segments, without_repeats


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, line, n, alphabet):
    line = list(line)
    for _ in range(n):
        k = rnd.randrange(len(line) + 1)
        what = rnd.randrange(3)
        if what == 0:
            line.insert(k, rnd.choice(alphabet))
        elif line and k < len(line):
            line[k : k + 1] = [] if what == 1 else [rnd.choice(alphabet)]
    return "".join(line)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 7])
def test_distance(most):
    rnd = random.Random(most)
    for _ in range(3000):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 25)))
        b = edited(rnd, a, rnd.randrange(0, most + 3), "abé") if rnd.random() < 0.8 else "".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 25)))
        d = plain_distance(a, b)
        assert edit_distance(a, b, most) == (d if d <= most else None), (a, b)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_every_near_pair_shares_a_segment(edits):
    rnd = random.Random(edits)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(8, 30)))
        b = edited(rnd, a, rnd.randrange(0, edits + 1), "ab")
        if len(b) < 8 or plain_distance(a, b) > edits:
            continue
        short, long_ = sorted((a, b), key=len)
        listed = {(len(short), k, short[at : at + size]) for k, (at, size) in enumerate(segments(len(short), edits + 1))}
        assert any((n, k, long_[at : at + size]) in listed for n, k, at, size in probes(len(long_), edits))


def test_counts_are_never_further_apart_than_edits_allow(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abcdeé日 ") for _ in range(rnd.choice([3, 30, 900])))
        n = rnd.randrange(0, 5)
        rows.append((character_counts(a), character_counts(edited(rnd, a, n, "xyé")), n))
    df = spark.createDataFrame(rows, "a bigint, b bigint, n int")
    assert df.where(counts_apart("a", "b") > 2 * df["n"]).count() == 0 and df.where(counts_apart("a", "b") > 0).count() > 200


def brute(docs, edits, min_chars):
    """(doc, line no) of a repeated line to (first doc, first line, equal); docs have different ids."""
    lines = [(d, n, x) for d, t in docs for n, x in enumerate((t or "").split("\n")) if len(x) >= min_chars]
    distinct = sorted({x for _, _, x in lines})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(a) - len(b)) <= edits and find(a) != find(b) and plain_distance(a, b) <= edits:
                root[find(a)] = find(b)
    first = {}
    for d, n, x in lines:
        r = find(x)
        if r not in first or (-1 if d is None else d, n) < (-1 if first[r][0] is None else first[r][0], first[r][1]):
            first[r] = (d, n, x)
    return {(d, n): (*first[find(x)][:2], first[find(x)][2] == x) for d, n, x in lines if first[find(x)][:2] != (d, n)}


def made():
    rnd = random.Random(8)
    line = lambda: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 14)))
    base = [line() for _ in range(40)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(rnd.randrange(0, 12)):
            x = rnd.random()
            own.append(line() if x < 0.4 else rnd.choice(base) if x < 0.6 else edited(rnd, rnd.choice(base), rnd.randrange(1, 4), "abé"))
        docs.append((d * 3, "\n".join(own)))
    chain = "a chain of lines, each two edits from the next"
    for d in range(1000, 1010):
        docs.append((d, chain))
        chain = edited(rnd, chain, 2, "xyz")
    return [*docs, (2000, None), (2001, ""), (2002, "\n\n"), (None, base[0] + "\n" + base[0])]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_made_lines(spark, edits):
    docs = made()
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id bigint, text string, line int")
    got = repeated_lines(df, edits)
    rows = {(r["doc_id"], r["line"]): (r["first_doc"], r["first_line"], r["equal"]) for r in got.collect()}
    assert rows == brute(docs, edits, 12)
    left = {r["doc_id"]: r["text"] for r in without_repeats(df, got).collect()}
    want = {d: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in rows) for d, t in docs}
    assert left == want


@pytest.mark.parametrize("edits", [1, 2])
def test_every_near_pair_meets_at_every_fineness(edits):
    rnd = random.Random(edits + 20)
    for _ in range(150):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(3, 24)))
        b = edited(rnd, a, rnd.randrange(1, edits + 1), "ab")
        if a == b or not b or plain_distance(a, b) > edits:
            continue
        short, long_ = sorted((a + "\n", b + "\n"), key=len)
        n = len(short)
        own, others = places(n, edits, 0), places(n, edits, len(long_) - n)
        while True:
            listed = {place_key(short, n, x) for x in own if not any(x[1])}
            assert listed & {place_key(long_, n, x) for x in others}, (a, b)
            # Only places that both share are narrowed, as if all of them were crowded.
            own = [x for x in own if not any(x[1]) and place_key(short, n, x) in {place_key(long_, n, y) for y in others}]
            others = [x for x in others if place_key(long_, n, x) in listed]
            done = all(is_last(x[0]) for x in own)
            own = [y for x in own for y in (finer(n, edits, x) if done or not is_last(x[0]) else [x])]
            others = [y for x in others for y in (finer(n, edits, x) if done or not is_last(x[0]) else [x])]
            if done:
                assert {place_key(short, n, x) for x in own if not any(x[1])} & {place_key(long_, n, x) for x in others}, (a, b)
                break


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("crowd", [0, 2])
def test_crowds_give_the_same_classes(spark, monkeypatch, edits, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    docs = made()
    got = repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), edits)
    assert {(r["doc_id"], r["line"]): (r["first_doc"], r["first_line"], r["equal"]) for r in got.collect()} == brute(docs, edits, 12)


def test_near_copies_of_a_long_line_meet_few_others(spark):
    rnd = random.Random(5)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(240))

    def changed(line, n):
        for k in rnd.sample(range(len(line)), n):
            line = line[:k] + chr(ord(line[k]) + 8 * rnd.randrange(50, 99)) + line[k + 1 :]
        return line

    far = [changed(line, 3) for _ in range(400)]  # with the same counts of characters
    near = [changed(x, 2) for x in far[:50]] + [x[:100] + x[101:] + "a" for x in far[50:90]]
    df = spark.createDataFrame(list(enumerate([*far, *near])), "doc_id bigint, text string")
    pairs = {(r["a"], r["b"]) for r in line_dedup.candidates(df, 2, 12, "text")[0].collect()}
    assert len(pairs) < 10 * 490
    lines = [*far, *near]
    ids = [line_dedup.line_id(line_dedup.line_key(x)) for x in lines]
    links = {(min(i, j), max(i, j)) for b, (y, j) in enumerate(zip(lines, ids, strict=True)) for x, i in zip(lines[:b], ids[:b], strict=True) if edit_distance(x, y, 2) is not None}
    assert len(links) == 90 and links <= pairs


def test_repeated_rows_and_empty(spark):
    text = "one long enough line\none long enough line\nshort"
    df = spark.createDataFrame([(1, text), (1, text), (2, "one long enough lime")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["line"], r["first_doc"], r["first_line"], r["equal"]) for r in repeated_lines(df).collect()) == [(1, 1, 1, 0, True), (2, 0, 1, 0, False)]
    assert repeated_lines(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeated_lines(df, 5, 5)


def test_query_reports_short_lines(spark, tmp_path):
    from lattica.llm.queries import op2_lines

    texts = [(1, "Les.\nok\n\na menu word"), (2, "Les.\nok\n\na menu ward\nHome page"), (3, "Home page\nx"), (4, "x\nunrelated, and long enough")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line"]): (r["first_doc"], r["first_line"], r["equal"]) for r in op2_lines(spark, str(tmp_path)).collect()}
    assert got == {(2, 0): (1, 0, True), (2, 1): (1, 1, True), (2, 3): (1, 3, False), (3, 0): (2, 4, True), (4, 0): (3, 1, True)}
