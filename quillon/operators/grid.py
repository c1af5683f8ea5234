"""Grids of cells, joins of arms and replies, knowledge-table builds: what the drivers of experiments compute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells(*dims: DataFrame) -> DataFrame:
    """Every combination of small dimension tables (distinct values, not data)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)  # dimension tables of a grid


def one_factor(base: dict[str, str], axes: dict[str, list[str]]) -> list[tuple[str, dict[str, str]]]:
    """Arms that differ from the base in one dimension at a time, the base once."""
    out = [("base", dict(base))]
    for axis, values in axes.items():
        out += [(f"{axis}={v}", base | {axis: v}) for v in values if v != base[axis]]
    return out


def pending(grid: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """Cells without a finished result; a result without mean doesn't count as finished."""
    return grid.join(finished.select(*key).distinct(), key, "left_anti")


def paired(a: DataFrame, b: DataFrame, key: list[str], score: str, group: str) -> DataFrame:
    """Two arms' scores of the items both scored, with the first known group."""
    x = a.where(F.col(score).isNotNull()).select(*key, F.col(score).alias("a"), F.col(group).alias("ga"))
    y = b.where(F.col(score).isNotNull()).select(*key, F.col(score).alias("b"), F.col(group).alias("gb"))
    return x.join(y, key).select(*key, "a", "b", F.coalesce("ga", "gb").alias("grp"))


def rescored(replies: DataFrame, rows: DataFrame, key: list[str], score: Column) -> DataFrame:
    """Replies scored against re-derived rows; without a row the score is null and resolved false."""
    r = rows.withColumn("_r", F.lit(True))
    return replies.join(r, key, "left").withColumn("new_score", F.when(F.col("_r"), score)).withColumn("resolved", F.coalesce("_r", F.lit(False))).drop("_r")


def relevant(qrels: DataFrame, query: str, doc: str, score: str) -> DataFrame:
    """(query, docs): each query's judged documents with their scores, in order of document; a query's judgements are few."""
    return qrels.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(doc), F.col(score).cast("int").alias("score")))).alias("docs"))


def require_complete(docs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The join, after checking that nothing is missing."""
    missing = docs.join(vectors, key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no vector for {[r[key] for r in missing]}, perhaps others")
    return docs.join(vectors, key)


def require_disjoint(a: DataFrame, b: DataFrame, key: list[str]) -> None:
    common = a.select(*key).join(b.select(*key), key, "left_semi").limit(5).collect()
    if common:
        raise ValueError(f"in both sets: {[tuple(r) for r in common]}, perhaps others")


def running_best(df: DataFrame, by: list[str], order: str, score: str) -> DataFrame:
    """df with best_so_far and improved (strictly better than all before)."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best_so_far", F.max(score).over(w)).withColumn("improved", before.isNull() | (F.col(score) > before))


def full_outer(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key of any part, each part's other columns under its name."""
    named = [df.select(key, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c != key]) for n, df in parts.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def knowledge_values(df: DataFrame, source: str, key_ref: str, value: str, value_type: str, order: str, granularity: str = "utterance") -> DataFrame:
    """Knowledge rows: pairs without key or value are left out, the first of equal pairs is kept, ids are hashed from content."""
    from quillon.functions.text import entry_id
    from quillon.operators.sets import first_of

    clean = df.where(F.col(key_ref).isNotNull() & F.col(value).isNotNull() & (F.trim(value) != ""))
    kept = first_of(clean, [key_ref, value], [order])
    src = F.col(source) if source in df.columns else F.lit(source)
    return kept.select(entry_id(src, F.col(key_ref).cast("string"), F.col(value)).alias("kid"), src.alias("source"), F.lit(value_type).alias("value_type"), F.col(value).alias("value"), F.col(key_ref).alias("key_ref"), F.lit(granularity).alias("key_granularity"))


def child_rows(values: DataFrame, size: int = 2) -> DataFrame:
    """A row per part of each value, pointing to its parent: the sentences in size runs of equal length (the last is
    shorter, a value of fewer sentences has a part for each), which together are the whole value."""
    own = F.split(F.trim("value"), r"(?U)(?<=[.!?。！？]\s{1,100})(?=\S)")  # sentences, each with the white space behind it
    step = F.greatest(F.ceil(F.size(own) / size), F.lit(1)).cast("int")
    parts = F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(1), F.size(own), step), lambda i: F.regexp_replace(F.array_join(F.slice(own, i, step), ""), r"(?U)\s+$", "")))
    e = values.select(F.col("kid").alias("parent_ref"), "source", F.posexplode(parts).alias("part", "value"))
    return e.select(F.concat("parent_ref", F.lit("|"), F.col("part").cast("string")).alias("kid"), "source", "value", "parent_ref", F.lit("segment").alias("key_granularity"))


def cluster_summaries(members: DataFrame, cluster: str, text: str, order: str) -> DataFrame:
    """(cluster, n, summary): the first five members' first 80 characters, joined and cut at 300."""
    w = Window.partitionBy(cluster).orderBy(order)
    first = members.withColumn("_i", F.row_number().over(w)).where("_i <= 5").groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.substring(text, 1, 80).alias("t")))), lambda s: s["t"]), " | ").alias("s"))
    return members.groupBy(cluster).agg(F.count("*").alias("n")).join(first, cluster).select(cluster, "n", F.substring("s", 1, 300).alias("summary"))
