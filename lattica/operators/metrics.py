"""Scores of result records: accuracy, three-way metrics, paired tests, audits, suites."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb, exp, factorial, lgamma, log, pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.runtime import cut

LABELS = ("entailed", "contradicted", "unknown")
#: Fewer trials than this are summed in whole numbers.
WHOLE = 1000


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy): `correct`, or where it is null `passed`, or where both are false."""
    columns = [F.col(c) for c in ("correct", "passed") if c in records.columns]
    right = F.coalesce(*columns, F.lit(False)).cast("int")
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def three_way(records: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of claims (gold, pred); 0 where nothing is counted."""
    labels = records.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    # One pass: a row's label as gold, and as prediction.
    seen = records.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold").eqNullSafe(F.col("pred"))).cast("int").alias("t")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    sums = seen.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    out = labels.join(sums, "label", "left").fillna(0, ["g", "p", "t"])
    out = out.select("label", _ratio(F.col("t"), F.col("p")).alias("precision"), _ratio(F.col("t"), F.col("g")).alias("recall"))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def three_way_summary(records: DataFrame) -> DataFrame:
    """One row: n, macro_f1, false_verification_rate (claims not entailed that were called so)."""
    macro = three_way(records).agg(F.avg("f1").alias("macro_f1"))
    other = F.coalesce(F.col("gold") != "entailed", F.lit(True))
    rate = records.agg(F.count(F.lit(1)).alias("n"), _ratio(F.count_if(other & F.coalesce(F.col("pred") == "entailed", F.lit(False))), F.count_if(other)).alias("false_verification_rate"))
    return rate.crossJoin(macro).select("n", "macro_f1", "false_verification_rate")  # one row each


def mcnemar(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("task_id", "run")) -> DataFrame:
    """One row (b, c, p_value): tasks that only the first, or only the second, got right; exact two-sided test."""
    pairs = a.select(*keys, F.col("correct").alias("first")).join(b.select(*keys, F.col("correct").alias("second")), list(keys))
    counts = pairs.agg(F.count_if(F.col("first") & ~F.col("second")).alias("b"), F.count_if(~F.col("first") & F.col("second")).alias("c"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(p_value=[binomial_p(int(x), int(y)) for x, y in zip(batch["b"], batch["c"], strict=True)])

    return counts.mapInPandas(exact, "b bigint, c bigint, p_value double")


def binomial_p(b: int, c: int) -> float:
    """Two-sided exact binomial test of b against c: in whole numbers below WHOLE, to some 12 digits beyond.

    There the tail is summed from its largest term on, each a multiple of the one
    before, until the rest can't be seen: some 10 * sqrt(n) terms at most.
    """
    n, least = b + c, min(b, c)
    if n == 0:
        return 1.0
    if n < WHOLE:
        return min(1.0, 2 * sum(comb(n, i) for i in range(least + 1)) / 2**n)
    term, tail = 1.0, 0.0
    for i in range(least, -1, -1):
        tail += term
        term *= i / (n - i + 1)
        if term < tail * 1e-17:
            break
    return min(1.0, 2 * tail * _of_all(least, n))


def _of_all(k: int, n: int) -> float:
    """comb(n, k) / 2**n as a double, by Stirling's formula with its remainders, so that no large logarithms are subtracted."""
    if k in (0, n):
        return exp(-n * log(2))

    def rest(x: int) -> float:
        return lgamma(x + 1) - (x + 0.5) * log(x) + x - log(2 * pi) / 2 if x < 16 else (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x / x) / x / x) / x / x) / x

    def off(x: int, m: float) -> float:
        """x * log(x / m) + m - x; near m by a series."""
        if abs(x - m) >= 0.1 * (x + m):
            return x * log(x / m) + m - x
        v = (x - m) / (x + m)
        total, power, j, last = (x - m) * v, 2 * x * v, 1, None
        while total != last:
            power *= v * v
            last, total, j = total, total + power / (2 * j + 1), j + 1
        return total

    return sqrt(n / (2 * pi * k * (n - k))) * exp(rest(n) - rest(k) - rest(n - k) - off(k, n / 2) - off(n - k, n / 2))


#: A comparison's rows are dealt into so many cells, which are what a resample draws.
CELLS = 1024
#: Resamples that one md5 gives weights for: four of its hexadecimal digits each.
PER_HASH = 8
#: A weight is the number of these that its digits reach: quantiles of a Poisson draw of mean 1.
POISSON = [f"{u:04x}" for k in range(9) if (u := round(65536 * sum(exp(-1) / factorial(j) for j in range(k + 1)))) < 65536]


def bootstrap(pairs: DataFrame, by: str, key: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, mean_diff, low, high, p_value) of paired values (a, b): percentile interval and centred p-value.

    Rows are dealt by their key's hash into CELLS cells, at every size, and summed;
    a resample draws each cell as often as a Poisson weight says that comes from an
    md5 of seed, cell and resample. So rows of one key are drawn together, work after
    the first sums depends on comparisons alone, and no comparison is in one task
    before its `resamples` means are. Against drawing rows one by one, an interval's
    width differs by some 2 in 100 where cells hold many rows. A resample that draws
    nothing counts as the observed mean. Rows with a null value take no part.
    """
    if resamples % PER_HASH:
        raise ValueError(f"resamples must be a multiple of {PER_HASH}")
    spark = pairs.sparkSession
    cell = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(CELLS))
    diff = F.col("a") - F.col("b")
    cells = pairs.where(diff.isNotNull()).groupBy(F.col(by).alias("__by"), cell.alias("__cell")).agg(F.sum(diff).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    chunks = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__by", "__cell")
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__cell").cast("string"), F.col("__chunk").cast("string")).cast("binary"))
    drawn = chunks.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(resamples // PER_HASH - 1)))).withColumn("__digits", digits)
    weight = lambda k: sum((F.substring("__digits", 4 * k + 1, 4) >= F.lit(u)).cast("int") for u in POISSON)
    sums = [F.sum(weight(k) * F.col(c)).alias(f"{c}{k}") for k in range(PER_HASH) for c in ("__sum", "__n")]
    whole = drawn.groupBy("__by", "__chunk").agg((F.sum("__sum") / F.sum("__n")).alias("observed"), *sums)
    means = whole.select("__by", "observed", F.explode(F.array(*[F.coalesce(F.try_divide(F.col(f"__sum{k}"), F.col(f"__n{k}")), F.col("observed")) for k in range(PER_HASH)])).alias("mean"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("__by").orderBy("mean")))  # `resamples` rows each
    at = lambda share: F.max(F.when(F.col("rank") == int(share * resamples) + 1, F.col("mean")))
    extreme = F.abs(F.col("mean") - F.col("observed")) >= F.abs("observed") - 1e-15
    out = ranked.groupBy("__by").agg(F.max("observed").alias("mean_diff"), at(0.025).alias("low"), at(0.975).alias("high"), F.avg(extreme.cast("int")).alias("p_value"))
    return out.withColumnRenamed("__by", by)


def summary(records: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """(by..., n, accuracy, mean_cost_usd, mean_seconds, unparsed): means over the values that are there."""
    right = F.coalesce(*[F.col(c) for c in ("correct", "passed") if c in records.columns], F.lit(False)).cast("int")
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg("cost_usd").alias("mean_cost_usd"), F.avg("seconds").alias("mean_seconds"), F.count_if(F.col("pred").isNull()).alias("unparsed")
    )


def summary_by_hops(records: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """(by..., hops, n, accuracy) of answers to questions."""
    return accuracy(records, [*by, "hops"])


def audit_summary(records: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """(by..., mean_precision, mean_recall, f1) over the scores that are there: f1 is 0 where both means are, null where one is not measured."""
    p, r = F.col("mean_precision"), F.col("mean_recall")
    means = records.groupBy(*by).agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))
    return means.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def cached_verdicts(tasks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, open): `tasks` (id, n_mutants, ...) whose verdicts `cache` (id, n_mutants, killable) holds for as many mutants, with them, and the rest.

    A task whose mutants are another number is judged anew: another mutation engine made the cache.
    """
    held = tasks.join(cache.select("id", "n_mutants", "killable").dropDuplicates(["id", "n_mutants"]), ["id", "n_mutants"], "left")
    return held.where(F.col("killable").isNotNull()), held.where(F.col("killable").isNull()).drop("killable")


def tool_totals(records: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """(by..., tool, calls) over the map column tool_calls."""
    return records.select(*by, F.explode("tool_calls").alias("tool", "calls")).groupBy(*by, "tool").agg(F.sum("calls").cast("long").alias("calls"))


def audit_scores(records: DataFrame) -> DataFrame:
    """`records` (id, gold, pred as arrays) with precision, recall, exact and f1 of the sets."""
    both = F.size(F.array_intersect("gold", "pred"))
    p, r = _ratio(both, F.size(F.array_distinct("pred"))), _ratio(both, F.size(F.array_distinct("gold")))
    out = records.withColumn("precision", p).withColumn("recall", r).withColumn("exact", F.sort_array(F.array_distinct("gold")) == F.sort_array(F.array_distinct("pred")))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def shard(tasks: DataFrame, k: int, n: int, order: str = "id") -> DataFrame:
    """Every n-th task from the k-th on (k from 0), in order of `order`.

    The place comes from counts of hash ranges, so no task sorts all rows.
    """
    if not 0 <= k < n:
        raise ValueError(f"shard {k} of {n}")
    return numbered(tasks, order).where(F.pmod(F.col("place"), F.lit(n)) == k).drop("place")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """`rows` with `place`, from 0 in order of a column: ranks within ranges and the ranges' offsets."""
    ranged = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__at", inside).join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")


def shard_of(text: str) -> tuple[int, int]:
    """K/N, K from 1 to N, as (k from 0, n)."""
    left, _, right = text.partition("/")
    if not (left.isdigit() and right.isdigit()) or not 1 <= int(left) <= int(right):
        raise ValueError(f"not a shard: {text!r}")
    return int(left) - 1, int(right)


def kill_scores(suites: DataFrame) -> DataFrame:
    """`suites` (passes, kills array<int>, boundary array<boolean>, ...) with mutation_score and boundary_score.

    A suite that fails the original kills nothing; scores without mutants are null.
    """
    kills = F.when(F.col("passes"), F.col("kills")).otherwise(F.transform("kills", lambda _: F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    marked = F.zip_with(kills, "boundary", lambda k, b: F.when(b, k).otherwise(0))
    n_boundary = F.size(F.filter("boundary", lambda b: b))
    return suites.withColumn("mutation_score", F.try_divide(total(kills).cast("double"), F.size("kills"))).withColumn("boundary_score", F.try_divide(total(marked).cast("double"), n_boundary))


def rescored(suites: DataFrame) -> DataFrame:
    """`suites` (kills, boundary, verdicts array<boolean>) with scores over killable mutants; unknown verdicts count as killable."""
    bad = F.size("kills") != F.size("verdicts")
    killable = F.when(bad, F.raise_error(F.lit("kills and verdicts differ in length"))).otherwise(F.transform("verdicts", lambda v: F.coalesce(v, F.lit(True)).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    edge = F.zip_with("killable", "boundary", lambda k, b: F.when(b, k).otherwise(0))
    out = suites.withColumn("killable", killable)
    out = out.withColumn("n_killable", total("killable")).withColumn("n_unknown", F.size(F.filter("verdicts", lambda v: v.isNull())))
    killed = F.zip_with("kills", "killable", lambda k, a: k * a)
    return out.withColumn("score_norm", F.try_divide(total(killed).cast("double"), F.col("n_killable"))).withColumn("boundary_norm", F.try_divide(total(F.zip_with(killed, edge, lambda k, e: k * e)).cast("double"), total(edge))).drop("killable")


def suite_summary(records: DataFrame) -> DataFrame:
    """(model, condition, n, valid, raw, norm): valid share, and means over valid suites."""
    ok = lambda c: F.avg(F.when(F.col("passes"), F.col(c)))
    return records.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passes").cast("int")).alias("valid"), ok("mutation_score").alias("raw"), ok("score_norm").alias("norm"))


def completion(records: DataFrame) -> DataFrame:
    """`records` (feasible, declared, hidden_passed) with early_completion, stalled_detected and diverged."""
    done, stalled = F.col("declared").eqNullSafe("DONE"), F.col("declared").eqNullSafe("STALLED")
    return records.withColumn("early_completion", done & ~F.col("hidden_passed")).withColumn("stalled_detected", stalled & ~F.col("feasible")).withColumn("diverged", F.col("declared").isNull())


def infeasible(cases: DataFrame) -> DataFrame:
    """(task, args, n_expected): inputs for which a task expects more than one result."""
    return cases.groupBy("task", "args").agg(F.countDistinct("expected").alias("n_expected")).where("n_expected > 1")


def matched_sample(records: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, role): the failed tasks, and as many others in a seeded order."""
    failed = records.groupBy(key).agg(F.min(F.coalesce(F.col("correct"), F.lit(False))).alias("fine"))
    n = failed.where("NOT fine").count()
    chosen = failed.where("fine").orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    return failed.where("NOT fine").select(key, F.lit("failed").alias("role")).unionByName(chosen.select(key, F.lit("control").alias("role")))


def report(summaries: DataFrame, title: str) -> str:
    """A small result as a Markdown table."""
    rows, names = summaries.collect(), summaries.columns
    shown = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(shown(v) for v in r) + " |" for r in rows), ""])
