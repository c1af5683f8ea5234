"""Set operations and duplicates with a defined order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key, nulls being a value; rows of a key need not fit into memory.

    The first order is found by a partial aggregation, so a key that holds a third of all rows is one row per task.
    """
    small = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select(*[F.col(f"_first.{c}").alias(c) for c in order], *[F.col(c).alias(f"_k_{c}") for c in key])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in order] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b._k_{c}")) for c in key]
    return df.alias("a").join(small.alias("b"), same, "left_semi")


def number_copies(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with dup_id, 0 for the first row of a key."""
    return df.withColumn("dup_id", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def set_difference(a: DataFrame, b: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by..., missing, extra, common): ids of a not in b, of b not in a, and of both, by one full join."""
    x = a.select(*by, id_col).distinct().withColumn("_a", F.lit(1))
    y = b.select(*by, id_col).distinct().withColumn("_b", F.lit(1))
    return x.join(y, [*by, id_col], "full").groupBy(*by).agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))


def replay_ok(frozen: DataFrame, drawn: DataFrame, id_col: str) -> bool:
    """Whether a draw repeats a frozen one: the same ids as often."""
    return frozen.select(id_col).exceptAll(drawn.select(id_col)).isEmpty() and drawn.select(id_col).exceptAll(frozen.select(id_col)).isEmpty()


def intersections(ids: DataFrame, prior: DataFrame, name: str, id_col: str) -> DataFrame:
    """(name, n_ids, n_common): per prior list, its ids and those also in ids."""
    x = ids.select(id_col).distinct().withColumn("_hit", F.lit(1))
    return prior.select(name, id_col).distinct().join(x, id_col, "left").groupBy(name).agg(F.count("*").alias("n_ids"), F.count("_hit").alias("n_common"))


def jaccard(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with n_common, n_all and jaccard of two arrays of distinct values; null where both are empty."""
    n, m = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return df.withColumns({"n_common": n, "n_all": m, "jaccard": F.when(m > 0, n / m)})
