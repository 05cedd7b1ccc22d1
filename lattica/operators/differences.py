"""Deep comparison of JSON records, as rows: each value by its path, then one grouping of both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.runtime import cut

# How far numbers may be apart if one of them is no whole number.
RELATIVE, ABSOLUTE = 1e-6, 1e-9

CONTAINERS = ("OBJECT", "ARRAY")
REAL = ("DOUBLE", "FLOAT", "DECIMAL")


def values(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., path, kind, text, number) for each value inside a variant column, containers included.

    A path is `$`, then `["name"]` or `[position]` for each step. `kind` is the
    variant's type without its sizes; `text` and `number` are null for containers. A
    level of nesting is a step over the containers of the level above alone, so work
    grows with the values, and steps with the depth of the deepest record.
    """
    spark = records.sparkSession
    kind = F.regexp_extract(F.schema_of_variant("__v"), "^[A-Z]+", 0)
    level = records.select(*keys, F.lit("$").alias("path"), F.col(value).alias("__v")).where(F.col("__v").isNotNull()).withColumn("kind", kind)
    levels = []
    while True:
        plain = ~F.col("kind").isin(*CONTAINERS)
        levels.append(level.select(
            *keys, "path", "kind", F.when(plain, F.try_variant_get("__v", "$", "string")).alias("text"), F.when(plain, F.try_variant_get("__v", "$", "double")).alias("number"),
        ))
        quoted = F.concat(F.lit('["'), F.replace(F.replace(F.col("key"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))
        step = F.when(F.col("kind") == "ARRAY", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(quoted)
        inside = level.where(~plain).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        level = cut(inside.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("__v")).withColumn("kind", kind))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _close(a: Column, b: Column, tolerance: float) -> Column:
    gap = F.greatest(F.greatest(F.abs(a), F.abs(b)) * RELATIVE, F.lit(tolerance or ABSOLUTE))
    finite = ~F.abs(a).isin(float("inf"), float("nan")) & ~F.abs(b).isin(float("inf"), float("nan"))
    return (a == b) | finite & (F.abs(a - b) <= gap)  # Spark's NaN equals NaN


def differences(pairs: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 0.0, strict: bool = False) -> DataFrame:
    """(keys..., path, reason, a, b): where two columns of JSON texts differ, and in what: `missing` in b, `added` in b, `type` or `value`.

    Numbers may be apart by a millionth, or by `tolerance` (1e-9 if it is 0), if one
    is no whole number; two whole numbers must be equal, and a boolean is no number
    (`strict`: beside one that isn't whole it counts as 0 or 1). What is inside a
    container that only one side has is reported too. Pairs whose side is null, no
    JSON, or an object with a name twice give nothing; whole numbers beyond 64 bits
    count as numbers that aren't whole. Keys need not be unique.
    """
    return _differences(_numbered(pairs, a, b), keys, tolerance, strict)


def alike(pairs: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 0.0, strict: bool = False) -> DataFrame:
    """(keys..., n_differences, alike) for each pair: `differences` counted, null where a side can't be read."""
    rows = _numbered(pairs, a, b)
    counts = _differences(rows, [], tolerance, strict).groupBy("__row").agg(F.count(F.lit(1)).alias("__n"))
    read = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = rows.join(counts, "__row", "left").select(*keys, F.when(read, F.coalesce("__n", F.lit(0))).alias("n_differences"))
    return out.withColumn("alike", F.col("n_differences") == 0)


def _numbered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    read = pairs.withColumn("__a", F.try_parse_json(F.col(a))).withColumn("__b", F.try_parse_json(F.col(b)))
    return cut(read.drop(a, b).withColumn("__row", F.monotonically_increasing_id()))  # numbers must not change between two reads


def _differences(rows: DataFrame, keys: list[str], tolerance: float, strict: bool) -> DataFrame:
    both = rows.where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    sides = both.select("__row", F.lit(True).alias("__left"), F.col("__a").alias("__value")).unionByName(both.select("__row", F.lit(False).alias("__left"), F.col("__b").alias("__value")))
    found = values(sides, ["__row", "__left"], "__value")
    one = F.struct("kind", "text", "number")
    met = found.groupBy("__row", "path").agg(F.max(F.when(F.col("__left"), one)).alias("x"), F.max(F.when(~F.col("__left"), one)).alias("y"))
    real = F.col("x.kind").isin(*REAL) | F.col("y.kind").isin(*REAL)
    number = lambda side: F.col(f"{side}.kind").isin("BIGINT", *REAL, *(["BOOLEAN"] if strict else []))
    in_numbers = real & number("x") & number("y")
    reason = (
        F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added")
        .when(in_numbers, F.when(~_close(F.col("x.number"), F.col("y.number"), tolerance), "value"))
        .when(F.col("x.kind") != F.col("y.kind"), "type").when(~F.col("x.text").eqNullSafe(F.col("y.text")), "value")
    )
    out = met.select("__row", "path", reason.alias("reason"), F.col("x.text").alias("__x"), F.col("y.text").alias("__y")).where(F.col("reason").isNotNull())
    if keys:
        out = out.join(both.select("__row", *keys), "__row").select(*keys, "path", "reason", F.col("__x").alias("a"), F.col("__y").alias("b"))
    return out
