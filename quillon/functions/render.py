"""Texts put together from rows: option blocks, knowledge cards and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions.text import sentences

# Similarity bands of a delivered card.
BANDS = ((0.85, "high"), (0.60, "medium"), (0.0, "low"))


def band(sim: Column) -> Column:
    """high from 0.85, medium from 0.60, else low; null for a null similarity."""
    out = F.when(sim.isNull(), F.lit(None).cast("string"))
    for limit, name in BANDS[:-1]:
        out = out.when(sim >= limit, name)
    return out.otherwise(BANDS[-1][1])


@F.pandas_udf(StringType())
def three_places(x):
    """A number with three places, by its exact binary value; None for null."""
    import pandas as pd

    return pd.Series(["None" if pd.isna(v) else f"{v:.3f}" for v in x], dtype=object)


def option_block(options: Column) -> Column:
    """A. text on lines for up to eight options, else 0. text."""
    lettered = F.array_join(F.transform(options, lambda o, i: F.concat(F.substr(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(". "), o)), "\n")
    numbered = F.array_join(F.transform(options, lambda o, i: F.concat(i.cast("string"), F.lit(". "), o)), "\n")
    return F.when(F.size(options) <= 8, lettered).otherwise(numbered)


def card(version: Column, tag: Column, sim: Column, rank: Column, content: Column, directive: Column) -> Column:
    """One card as text: header, content, directive."""
    header = F.format_string("[knowledge-card v%d | %s | relevance=%s sim=%s rank=%d]", version, tag, band(sim), three_places(sim), rank)
    return F.concat_ws("\n", header, F.coalesce(content, F.lit("")), F.concat(F.lit("usage_directive: "), F.coalesce(directive, F.lit(""))))


def delivery(hits: DataFrame, by: str, order: str, passage: str, instruction: Column) -> DataFrame:
    """(by, prompt): the passages in order, divided by ---, in front of the instruction; a query's few hits meet in a row."""
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(passage).alias("p")))), lambda s: s["p"]), "\n---\n")
    head = F.lit("Reference material (retrieved, may or may not be relevant):\n")
    return hits.groupBy(by).agg(block.alias("block"), F.first(instruction).alias("_i")).select(by, F.when(F.col("block") != "", F.concat(head, "block", F.lit("\n\n"), "_i")).otherwise(F.col("_i")).alias("prompt"))


def compress(passage: Column, query: Column) -> Column:
    """The half of a passage's sentences that share most words with the query, in their order; at least one."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != ""))
    q = words(query)
    parts = F.filter(sentences(F.trim(passage)), lambda s: F.trim(s) != "")
    scored = F.transform(parts, lambda s, i: F.struct(F.when(F.size(F.array_union(words(s), q)) > 0, -F.size(F.array_intersect(words(s), q)) / F.size(F.array_union(words(s), q))).otherwise(0.0).alias("v"), i.alias("i"), s.alias("s")))
    kept = F.slice(F.array_sort(scored), F.lit(1), F.greatest(F.lit(1), F.floor(F.size(parts) / 2).cast("int")))
    inorder = F.array_sort(F.transform(kept, lambda k: F.struct(k["i"].alias("i"), k["s"].alias("s"))))
    return F.when(F.size(parts) <= 1, passage).otherwise(F.array_join(F.transform(inorder, lambda k: k["s"]), " "))
