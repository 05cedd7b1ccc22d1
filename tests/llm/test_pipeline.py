"""The pipeline: each stage on its own input, against the operators' brute-force twins."""

from collections import Counter

import corpus_pipeline
from lattica.llm.queries import MIX_WEIGHTS
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_dup import brute as brute_near

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "12 345", "en", "src1", 6), (10_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    before = rows(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix", "shard"]
    stage = dict(corpus_pipeline.STAGES)

    spoken = stage["language_id"](spark, docs, SF)
    assert spoken.columns == docs.columns and Counter(rows(spoken)) == Counter(r for r in before if r[0] < 10_000)

    single = stage["near_duplicates"](spark, spoken, SF).cache()
    kept = {i for i, _, _, keep in brute_near([r[:2] for r in rows(spoken)], corpus_pipeline.NEAR) if keep}
    assert single.columns == docs.columns and Counter(rows(single)) == Counter(r for r in rows(spoken) if r[0] in kept)

    clean = stage["decontaminate"](spark, single, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaky = {d for d, _ in brute_leaks([r[:2] for r in rows(single)], items)}
    assert leaky and clean.columns == docs.columns and Counter(rows(clean)) == Counter(r for r in rows(single) if r[0] not in leaky)

    mixed = stage["mix"](spark, clean, SF).cache()
    took = brute_mix(spark, [r[:4] for r in rows(clean)], corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_EPOCHS, MIX_WEIGHTS)
    assert mixed.columns == docs.columns and Counter(rows(mixed)) == Counter(r for r in rows(clean) if took.get(r[0]))

    sharded = stage["shard"](spark, mixed, SF)
    assert Counter(rows(sharded)) == Counter(rows(mixed)) and {r["shard"] for r in sharded.collect()} == set(range(8))


def test_run_and_empty(spark):
    got = corpus_pipeline.run(spark, SF)
    assert "shard" in got.columns and 0 < got.count() < 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
