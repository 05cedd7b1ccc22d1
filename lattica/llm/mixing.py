"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, their languages and their sources carries weights. A token
budget flows down it in their proportion. A node that cannot use its share, even
repeating its documents up to `max_epochs` times, leaves the shortage to its
siblings; only what a whole family cannot use goes to its parent's siblings. Each
leaf then takes whole epochs and, of the next one, the longest prefix in a seeded
order that its budget covers.

Budgets are divided in columns, a level at a time, in whole numbers; so the number
of sources is bounded by nothing but their own sums, a row for each.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Weights are whole millionths.
UNIT = 1_000_000
#: Bits of a seeded order's ranges and of the ranges within one: a leaf's tokens are added up by 4,096 of each.
BIN_BITS = 12
FAMILY = ("domain", "lang", "source")

#: (domain,), (domain, language) or (domain, language, source) to its weight among its siblings; 1 where absent. Null is None.
Weights = Mapping[tuple[str | None, ...], float]


def _whole(x) -> Column:
    return x.cast("decimal(19,0)")


def divided(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """`children` (`family`..., `name`, amount, weight, room, ...) with `budget`: each family's `amount` in proportion to whole weights, none above its `room`.

    What one can't take goes to the others. Whole numbers: the largest fractions get
    what rounding leaves, ties to the first by name. Children without weight get
    something only when those with weight are full, in equal parts.
    """
    weighed = children.withColumn("__has", F.col("weight") > 0).withColumn("__w", F.greatest(F.col("weight"), F.lit(1)))
    siblings, alike = Window.partitionBy(*family), Window.partitionBy(*family, "__has")
    # Those with weight first; the others share what they leave.
    first = F.least("amount", F.sum(F.when(F.col("__has"), F.col("room")).otherwise(0)).over(siblings))
    weighed = weighed.withColumn("__amount", F.when(F.col("__has"), first).otherwise(F.col("amount") - first))
    # In order of the amount that fills each, one is full if what those before it leave fills it.
    filling = alike.orderBy(F.col("room") / F.col("__w"), F.col(name).asc_nulls_first())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    taken, gone = F.coalesce(F.sum("room").over(before), F.lit(0)), F.coalesce(F.sum("__w").over(before), F.lit(0))
    left, others = F.col("__amount") - taken, F.sum("__w").over(alike) - gone
    full = _whole(left) * _whole(F.col("__w")) >= _whole(F.col("room")) * _whole(others)
    # Then all after the first that is not full share what is left.
    weighed = weighed.withColumn("__full", full).withColumn("__left", F.col("__amount") - F.sum(F.when(F.col("__full"), F.col("room")).otherwise(0)).over(alike))
    weighed = weighed.withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("__w")).otherwise(0)).over(alike))
    product = _whole(F.col("__left")) * _whole(F.col("__w"))
    weighed = weighed.withColumn("__rest", F.when(~F.col("__full"), F.pmod(product, _whole(F.col("__open"))))).withColumn("__part", F.when(~F.col("__full"), F.call_function("div", product, _whole(F.col("__open")))))
    by_rest = alike.orderBy(F.desc_nulls_last("__rest"), F.col(name).asc_nulls_first())
    one = (F.row_number().over(by_rest) <= F.col("__left") - F.sum("__part").over(alike)).cast("long")
    budget = F.when(F.col("__full"), F.greatest(F.lit(0), F.col("room"))).otherwise(F.least("room", F.col("__part") + one))
    return weighed.withColumn("budget", budget.cast("long")).drop("__has", "__w", "__amount", "__full", "__left", "__open", "__rest", "__part")


def budgets(leaves: DataFrame, weights: Weights, amount: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of leaves (domain, lang, source, tokens); `amount` is at most what the root can use."""
    spark = leaves.sparkSession
    level = F.broadcast(spark.createDataFrame([(*k, *[None] * (3 - len(k)), len(k), round(w * UNIT)) for k, w in weights.items()], "w_domain string, w_lang string, w_source string, depth int, w bigint"))  # the caller's
    above = None
    for depth in (1, 2, 3):
        names, family = list(FAMILY[:depth]), list(FAMILY[: depth - 1])
        nodes = leaves.groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn("room", F.col("tokens") * max_epochs)
        own = level.where(F.col("depth") == depth).drop("depth")
        match = [F.col(n).eqNullSafe(F.col(f"w_{n}")) for n in names]
        nodes = nodes.join(own, match, "left").select(*names, "tokens", "room", F.coalesce("w", F.lit(UNIT)).alias("weight"))
        if above is None:
            nodes = nodes.withColumn("amount", F.lit(amount).cast("long"))
        else:
            up = above.select(*[F.col(n).alias(f"u_{n}") for n in family], F.col("budget").alias("amount"))
            nodes = nodes.join(up, [F.col(n).eqNullSafe(F.col(f"u_{n}")) for n in family]).drop(*[f"u_{n}" for n in family])
        above = divided(nodes, family, names[-1]).select(*names, "tokens", "budget")
    return above


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, domains: Mapping[str, str], weights: Weights, budget_share: float, max_epochs: int, seed: int,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", other_domain: str = "other",
) -> DataFrame:
    """Rows (`id_col`, domain, lang, source, n_tokens, copies, text_hash) of the documents that the mixture takes.

    The budget is `budget_share` of all tokens (words). `copies`: whole epochs of the
    leaf, plus one if the document is in the next epoch's prefix. A leaf never
    exceeds its budget; it stays below it by less than the first document beyond its
    prefix. Null languages and sources are leaves of their own, with null in the
    result; sources that `domains` doesn't name are in `other_domain`. Documents
    without words follow the prefix they fall in; a leaf without any words gives
    nothing. Rows that repeat an id are ordered by their texts' hash, and rows that
    repeat both count each. An empty table gives no rows. Other columns aren't read.

    Very long texts count whole. Columns of any of the names used here may clash.

    Of a leaf's seeded order only the range of a range in which the prefix ends, one
    of 16 million, is sorted, so a hot source needs no large task.
    """
    if not 0 < budget_share or max_epochs < 1 or any(w < 0 for w in weights.values()):
        raise ValueError("a positive share, at least one epoch and no negative weights")
    domain = F.coalesce(*[F.when(F.col(source_col) == s, F.lit(d)) for s, d in sorted(domains.items())], F.lit(other_domain))
    rows = docs.select(
        F.col(id_col).alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    rows = cut(rows)  # without texts: read once
    leaves = cut(rows.groupBy(*FAMILY).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    amount = min(int(Fraction(str(budget_share)) * total), total * max_epochs)
    plan = cut(budgets(leaves, weights, amount, max_epochs).where("tokens > 0").select(*FAMILY, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")))
    leaf = _with(rows, plan).withColumn("draw", F.xxhash64(F.lit(seed), F.col("epochs"), F.col("id")))
    leaf = leaf.withColumn("bin", F.shiftright("draw", 64 - BIN_BITS)).withColumn("sub", F.shiftright("draw", 64 - 2 * BIN_BITS).bitwiseAND(F.lit((1 << BIN_BITS) - 1)))
    # Every leaf of the plan has words, and fewer in its rest than in all: so each has a range in which its prefix ends, and in that a range.
    ends = cut(_end(leaf, "bin"))
    inner = _with(leaf, ends).where(F.col("bin") == F.col("end_bin")).withColumn("rest", F.col("rest") - F.col("before_bin"))
    ends = cut(_with(ends, _end(inner, "sub")))
    leaf = _with(leaf, ends)
    place, end = F.struct("bin", "sub"), F.struct(F.col("end_bin").alias("bin"), F.col("end_sub").alias("sub"))
    out = ["id", *FAMILY, "n_tokens", "epochs", "rest", "text_hash"]
    outside = leaf.where(place != end).select(*out, ((F.col("rest") > 0) & (place < end)).cast("long").alias("one"))
    upto = F.sum("n_tokens").over(Window.partitionBy(*FAMILY).orderBy("draw", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    inside = leaf.where(place == end).withColumn("upto", F.col("before_bin") + F.col("before_sub") + upto)
    inside = inside.select(*out, ((F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))).cast("long").alias("one"))
    taken = outside.unionByName(inside).withColumn("copies", F.col("epochs") + F.col("one")).where("copies > 0")
    return taken.select(F.col("id").alias(id_col), *FAMILY, "n_tokens", "copies", "text_hash")


def _with(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """`rows` with the columns of their leaf, a row of `leaves` for each; Spark broadcasts it where it is small enough."""
    named = leaves.select(*[F.col(n).alias(f"__{n}") for n in FAMILY], *[c for c in leaves.columns if c not in FAMILY])
    return rows.join(named, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in FAMILY]).drop(*[f"__{n}" for n in FAMILY])


def _end(rows: DataFrame, part: str) -> DataFrame:
    """(family, end_`part`, before_`part`): of each leaf's ranges by `part` the first whose tokens pass the leaf's rest, and the tokens before it."""
    sums = rows.groupBy(*FAMILY, part).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*FAMILY).orderBy(part)) - F.col("n")  # as many rows of a leaf as there are ranges, at most
    passing = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    return passing.select(*FAMILY, F.col(part).alias(f"end_{part}"), F.col("before").alias(f"before_{part}"))


def take_mixture(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `mix` took, each as often as its copies say, with the columns of `docs`.

    Rows that repeat an id and a text share one decision: the most copies that one of them got.
    """
    chosen = taken.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max("copies").cast("int").alias("__copies"))
    keyed = docs.withColumn("__text", F.xxhash64(F.col(text_col)))
    joined = keyed.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)
