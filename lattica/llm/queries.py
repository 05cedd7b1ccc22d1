"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import collocations, common, decontam, langid, license_scan, line_dedup, mixing, near_dup, sentence_pieces, sharding, token_count, topk, url_filter, vector_codes

N_SHARDS = 8
WORD_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 2048
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Sources by domain; the rest are "other".
DOMAINS = {"src0": "web", "src1": "web", "src2": "web", "src3": "books", "src4": "books", "src5": "code", "src6": "code", "src7": "code"}
MIX_WEIGHTS = {
    ("web",): 5.0, ("books",): 2.0, ("code",): 1.0, ("other",): 4.0,
    ("web", "en"): 3.0, ("other", "en"): 2.0, ("books", "en"): 2.0, ("web", "en", "src1"): 2.0,
}
MIX_SEED = 7


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return sharding.shard_rows(docs, N_SHARDS, f"{common.shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exact repeats of every length; edits from the length that the segments need.
    return line_dedup.repeated_lines(common.table(spark, sf_dir, "documents"), min_chars=line_dedup.EDITS + 1, equal_chars=1)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_findings(common.table(spark, sf_dir, "documents"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mixing.mix(docs, DOMAINS, MIX_WEIGHTS, budget_share=0.8, max_epochs=4, seed=MIX_SEED).drop("text_hash")


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(common.table(spark, sf_dir, "documents"), WORD_VOCABULARY, TOKEN_LIMIT)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))), PIECE_VOCABULARY)
    marked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.predict(marked, model, carry=("doc_id", "held_out"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages"), URL_RULES)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(common.table(spark, sf_dir, "documents"), near_dup.Measure(words=3, num=85, den=100))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_texts(common.table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(common.table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_lines, op3_licenses, op4_mixture, op5_leaks, op6_tokens, op7_language, op8_urls, op9_near_duplicates, op10_nearest, op11_pieces, op12_collocations, op13_codes)}

_URL_PARTS = r"""
    SELECT page_id, host, path FROM (
        SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/]*((?s:.*))', 1) AS path
        FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages)
    )"""

ORACLE_SQL = {
    "op8_urls": f"""
    WITH parts AS ({_URL_PARTS}),
    rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
    fits AS (
        SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
               row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS r
        FROM parts LEFT JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE r = 1""",
    "op10_nearest": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
          FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) q JOIN v d ON q.vec_id <> d.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_collocations": r"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n-\r]')) AS piece FROM texts)),
    runs AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM pieces, range(1, 5) s(size) WHERE len(w) >= size),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
    cuts AS (SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM c, range(1, 4) s(k) WHERE k < size),
    scores AS (SELECT cuts.*, h.a AS l, t.a AS r, (2000000::HUGEINT * cuts.a) // (h.a::HUGEINT + t.a) AS score
               FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
    lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT c.lang, array_to_string(c.w[i : i + k - 1], ' ') AS phrase, max(c.a) AS longer
               FROM c, range(2, 4) s(k), range(1, 4) p(i) WHERE k < size AND i + k - 1 <= size GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
