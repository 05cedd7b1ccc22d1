"""Sharding: the law, gapless places, hot groups and the versions of the map."""

import zlib
from collections import Counter

import pytest

from lattica.llm.queries import op1_shards
from lattica.llm.sharding import SlotMap, assign_shards, shard_rows


def check(rows, docs, n_shards, slack):
    want = sorted((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t in docs if d is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == want
    assert len(rows) == len(docs) and {r["law"] for r in rows} <= {"bytes"} and all(r["grown_shard"] is None for r in rows)
    by: dict = {s: [] for s in range(n_shards)}
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = [sum(r["size"] for r in own) for own in by.values()]
    assert max(total) - min(total) <= slack, total


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op1_shards(spark, sf).collect(), docs, 8, 600)


def test_hot_groups_nulls_and_repeats(spark, tmp_path):
    docs = [(i, "copy " * 30) for i in range(3000)] + [(3000 + i, f"text {i} " * (i % 50)) for i in range(6000)] + [(None, "x"), (5, None), (6, ""), (3001, "text 1 "), (9000, "long " * 2000)]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id bigint, text string, shard int, slot int")
    rows = shard_rows(df, 8, str(tmp_path / "a")).collect()
    check(rows, docs, 8, 700)
    kept = {}
    for r in rows:
        if r["size"] > 1 and r["text_crc32"] != zlib.crc32(("copy " * 30).encode()):
            kept.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in kept.values())  # groups of copies stay together, but hot ones
    assert len({r["shard"] for r in rows if r["size"] == 151}) == 8
    again = assign_shards(df, 8, str(tmp_path / "b"))
    assert again.columns == ["doc_id", "text", "slot", "shard"]
    assert Counter((r["doc_id"], r["shard"]) for r in again.collect()) == Counter((r["doc_id"], r["shard"]) for r in rows)


def test_equal_texts_share_a_shard_at_every_size(spark, tmp_path):
    """Whatever the table's size, the same share of it decides whether a group spreads."""
    for n in (300, 3000):
        docs = [(i, f"copy {i % 40} " * 20) for i in range(n // 3)] + [(n + i, f"text {i} " * 40) for i in range(n)]
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        shards = {}
        for r in shard_rows(df, 8, str(tmp_path / str(n))).collect():
            shards.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert all(len(s) == 1 for s in shards.values())


def test_no_group_that_fits_a_share_is_split(spark, tmp_path):
    """Ten groups of equal texts, each a tenth of all bytes, over eight shards: whole, and as even as whole groups can be."""
    for n in (20, 300, 30_000):
        df = spark.createDataFrame([(i, f"text {i % 10} " * 10) for i in range(n)], "doc_id bigint, text string")
        shards, held = {}, Counter()
        for r in shard_rows(df, 8, str(tmp_path / f"t{n}")).collect():
            shards.setdefault(r["text_crc32"], set()).add(r["shard"])
            held[r["shard"]] += r["size"]
        assert len(shards) == 10 and all(len(s) == 1 for s in shards.values())
        assert len(held) == 8 and max(held.values()) == 2 * min(held.values())


def test_documents_of_equal_text_share_a_shard(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_shards(spark, sf).collect()
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        by.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    assert max(map(len, by.values())) > 1
    for (_, size), shards in by.items():
        assert len(set(shards)) == 1 or size * len(shards) * 8 > total


def test_map_is_the_plain_greedy_one(spark, tmp_path):
    """The shards, from the rows' slots alone: one slot at a time from the fullest shard to the emptiest."""
    docs = [(i, "w " * (i * 37 % 211)) for i in range(2000)]
    rows = shard_rows(spark.createDataFrame(docs, "doc_id bigint, text string"), 5, str(tmp_path / "m"), n_slots=64).collect()
    size = Counter()
    for r in rows:
        size[r["virtual_slot"]] += r["size"]
    now = {s: s % 5 for s in range(64)}
    while True:
        total = [sum(size[s] for s in now if now[s] == k) for k in range(5)]
        full, empty = max(range(5), key=lambda k: (total[k], -k)), min(range(5), key=lambda k: (total[k], k))
        gap = total[full] - total[empty]
        fit = [s for s in now if now[s] == full and 0 < size[s] < gap]
        if not fit:
            break
        below, above = [s for s in fit if size[s] <= gap // 2], [s for s in fit if size[s] > gap // 2]
        near = [max(below, key=lambda s: (size[s], s))] if below else []
        near += [min(above, key=lambda s: (size[s], s))] if above else []
        now[min(near, key=lambda s: (abs(2 * size[s] - gap), s))] = empty
    assert {r["virtual_slot"]: r["shard"] for r in rows} == {s: now[s] for s in size}


def test_stored_map_is_edited_again(spark, tmp_path):
    path = str(tmp_path / "maps")
    one = spark.createDataFrame([(i, "a " * (i % 97)) for i in range(900)], "doc_id bigint, text string")
    more = one.unionByName(spark.createDataFrame([(900 + i, "b " * (i % 13) + str(i)) for i in range(900)], "doc_id bigint, text string"))
    assert {r["map_version"] for r in shard_rows(one, 4, path).collect()} == {1}
    rows = shard_rows(more, 4, path).collect()
    first, second = SlotMap.load(spark, path, 1), SlotMap.load(spark, path, SlotMap.latest(spark, path))
    assert second.version == 2 and {r["map_version"] for r in rows} == {2}
    moved = {s for s, _, _ in second.edits}
    assert 0 < len(moved) < 2000 and all(first.shards[s] == second.shards[s] for s in range(4096) if s not in moved)
    assert {r["shard"] for r in rows if r["virtual_slot"] not in moved} <= {0, 1, 2, 3} and all(second.shards[r["virtual_slot"]] == r["shard"] for r in rows)
    with pytest.raises(ValueError):
        shard_rows(one, 5, path)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shard_rows(df, 8, str(tmp_path / "a")).collect() == []
    assert assign_shards(df, 8, str(tmp_path / "b")).collect() == []


def test_map_versions(spark, tmp_path):
    slot_bytes = {s: (s * 7919) % 1000 + 1 for s in range(4096)}
    first = SlotMap.fresh(8)
    second = first.rebalanced(slot_bytes)
    third = second.grown(slot_bytes)
    assert [m.version for m in (first, second, third)] == [0, 1, 2]
    size = Counter()
    for s, x in enumerate(third.shards):
        size[x] += slot_bytes[s]
        assert x == second.shards[s] or x == 8  # one more shard takes rows only into itself
    assert max(size.values()) - min(size.values()) <= 1000
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map"), 2) == third
    assert SlotMap.load(spark, str(tmp_path / "map"), 0) == first
    with pytest.raises(Exception):
        second.save(spark, str(tmp_path / "map"))
    with pytest.raises(ValueError):
        SlotMap.fresh(0)
