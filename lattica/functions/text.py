"""Columns over texts: names, final answers, conversation records."""

from __future__ import annotations

import ast
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAILING = ".,;:"
ROLES = ("user", "assistant", "system")


def sanitized(text: Column) -> Column:
    """A local name: other characters than letters, digits, _, . and - become one _; x where nothing is left."""
    squeezed = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w.-]", "_"), "_+", "_")
    trimmed = F.regexp_replace(squeezed, "^_+|_+$", "")
    return F.when(text.isNotNull(), F.when(trimmed == "", F.lit("x")).otherwise(trimmed))


def curie_mapping(names: DataFrame, name: str = "name", order: str = "first_seen") -> DataFrame:
    """(name, curie): each name's own identifier, `base`, `base_2`, `base_3` ... in order of `order` where names collide.

    A numbered identifier that another name has as its base passes to the next
    number: rounds until none collides, in practice one or two.
    """
    todo = names.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("seen")).withColumn("base", sanitized(F.col("name")))
    by_base = Window.partitionBy("base").orderBy("seen", "name")
    ranked = todo.withColumn("k", F.row_number().over(by_base))
    bases = todo.select(F.col("base").alias("taken")).distinct()
    numbered = ranked.where("k > 1")
    # Numbers that are somebody's base are skipped: count those at or below.
    suffix = bases.withColumn("stem", F.regexp_extract("taken", r"^(.*)_(\d+)$", 1)).withColumn("n", F.regexp_extract("taken", r"^(.*)_(\d+)$", 2).try_cast("int")).where("n >= 2")
    blocked = suffix.groupBy(F.col("stem").alias("base")).agg(F.sort_array(F.collect_set("n")).alias("blocked"))
    free = numbered.join(blocked, "base", "left").withColumn("blocked", F.coalesce("blocked", F.array().cast("array<int>")))
    number = F.aggregate("blocked", F.col("k"), lambda at, b: F.when(b <= at, at + 1).otherwise(at))
    out = ranked.where("k = 1").select("name", F.concat(F.lit("ns:"), "base").alias("curie"))
    return out.unionByName(free.select("name", F.concat(F.lit("ns:"), F.col("base"), F.lit("_"), number.cast("string")).alias("curie")))


def normalized_answer(text: Column) -> Column:
    return F.regexp_replace(text, f"[{TRAILING}]+$", "")


def final_answer(text: Column) -> Column:
    """The token after the last "FINAL:", without punctuation at its end; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"FINAL:\s*(\S+)"), F.lit(1))
    return normalized_answer(F.trim(F.try_element_at(found, F.lit(-1))))


def final_pairs(text: Column) -> Column:
    """The `;`-separated entries of the last "FINAL:" line, distinct and sorted; null without one."""
    line = F.try_element_at(F.regexp_extract_all(text, F.lit(r"FINAL:[ \t]*([^\n]*)"), F.lit(1)), F.lit(-1))
    parts = F.transform(F.split(line, ";"), lambda x: F.replace(F.regexp_replace(F.trim(x), r"^[`*.]+|[`*.]+$", ""), F.lit(" "), F.lit("")))
    return F.sort_array(F.array_distinct(F.filter(parts, lambda x: x != "")))


def declaration(text: Column) -> Column:
    """The last of DONE and STALLED after "FINAL:", in capitals; null without one."""
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)FINAL:\s*(DONE|STALLED)"), F.lit(1)), F.lit(-1)))


def bracketed(text: Column) -> Column:
    """What stands in the first [brackets]; empty without any."""
    return F.regexp_extract(text, r"\[([^\]]+)\]", 1)


def unbracketed(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]+)\]", "$1")


def message_turns(lines: DataFrame, line: str = "value", at: str = "line_no", conversation: str | None = None) -> DataFrame:
    """(conversation, turn, role, text) of JSON lines that are messages, numbered in order.

    A record is a message or wraps one under `message`; its content is a text or a
    list of blocks, of which the texts count. Other lines, unknown roles and empty
    texts are skipped and not numbered.
    """
    whole = F.try_parse_json(F.col(line))
    inner = F.try_variant_get(whole, "$.message", "variant")
    wrapped = F.coalesce(F.startswith(F.schema_of_variant(inner), F.lit("OBJECT")), F.lit(False))
    pick = lambda path, kind: F.when(wrapped, F.try_variant_get(inner, path, kind)).otherwise(F.try_variant_get(whole, path, kind))
    content = pick("$.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    blocks = F.from_json(F.to_json(content), "array<struct<type:string,text:string>>", {"mode": "PERMISSIVE"})
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.trim(b["text"])), lambda t: t.isNotNull() & (t != ""))
    rows = lines.select(
        *([F.col(conversation).alias("conversation")] if conversation else [F.lit(0).alias("conversation")]), F.col(at).alias("at"), pick("$.role", "string").alias("role"),
        F.when(is_text, F.regexp_replace(pick("$.content", "string"), r"(?U)^\s+|\s+$", "")).otherwise(F.array_join(texts, "\n")).alias("text"),
    )
    known = rows.where(F.col("role").isin(*ROLES) & (F.coalesce("text", F.lit("")) != ""))
    return known.select("conversation", F.row_number().over(Window.partitionBy("conversation").orderBy("at")).alias("turn"), "role", "text")


def rendered(turns: DataFrame) -> DataFrame:
    """(conversation, rendered): each conversation's turns as numbered blocks."""
    block = F.concat(F.lit("[turn "), F.col("turn").cast("string"), F.lit(" - "), F.col("role"), F.lit("]\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", block.alias("block"))))
    return turns.groupBy("conversation").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("rendered"))


def phrase(start: Column, path: Column, templates: Mapping[str, str]) -> Column:
    """A question's text: each step's template about the phrase so far."""
    table = F.create_map(*[F.lit(x) for k, v in sorted(templates.items()) for x in (k, v)])
    return F.aggregate(path, start, lambda so_far, p: F.replace(table[p], F.lit("{x}"), so_far))


def fenced_code(text: Column) -> Column:
    """The last fenced Python block with a test in it; null without one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)?[ \t]*\n(.*?)```"), F.lit(1))
    return F.try_element_at(F.filter(blocks, lambda b: F.contains(b, F.lit("def test"))), F.lit(-1))


def count_tests(source: Column) -> Column:
    """How many functions of a Python source, at any depth, are tests; 0 where there is none or it can't be read."""

    @F.pandas_udf("int")
    def count(sources: pd.Series) -> pd.Series:
        def one(text):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError):
                return 0
            return sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test_") for n in ast.walk(tree))

        return sources.map(one).astype("int32")

    return count(F.coalesce(source, F.lit("")))


def module_name(path: Column) -> Column:
    """A dotted module name from a path without its suffix."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"^(\./|/)+", ""), F.lit("/"), F.lit("."))
