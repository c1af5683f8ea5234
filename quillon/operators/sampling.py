"""Deterministic draws and splits. The order of a draw is that of a seeded hash of the id, so that it needs no state and
no numbering of rows; numpy's permutation is offered too, for draws that must equal one made elsewhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.plans.runtime import bounded_rows


def draw_key(seed: int, *ids: str | Column) -> Column:
    """Place of an id in the draw of a seed: SHA-256 of seed:id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *ids)), 256)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int, id_order: bool = False) -> DataFrame:
    """The n ids first in the draw, in draw order or sorted by id; a top-n, not a sort of all rows. Null ids are left out."""
    out = df.where(F.col(id_col).isNotNull()).withColumn("_k", draw_key(seed, id_col)).orderBy("_k", id_col).limit(n)
    return (out.orderBy(id_col) if id_order else out).drop("_k")


def permutation_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """(id, pos): the ids at the first n places of numpy's permutation of the sorted distinct ids.

    Only n numbers are sent out; the ids are numbered per range partition, never in one task.
    """
    spark = df.sparkSession
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    parts = ids.repartitionByRange(F.col("id")).withColumn("_p", F.spark_partition_id()).persist()
    counts = {r["_p"]: r["count"] for r in bounded_rows(parts.groupBy("_p").count(), 1_000_000, "partitions")}
    base, bases = 0, []
    for p in sorted(counts):
        bases.append((p, base))
        base += counts[p]
    head = np.random.default_rng(seed).permutation(base)[:n] if base else []
    picks = spark.createDataFrame([(int(r), i) for i, r in enumerate(head)] or [], "r long, pos long")
    offsets = spark.createDataFrame(bases or [], "_p int, base long")
    numbered = parts.join(F.broadcast(offsets), "_p").withColumn("r", F.col("base") + F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1)
    return numbered.join(picks, "r").select(F.col("id").alias(id_col), "pos")


def stratified_quota(df: DataFrame, id_col: str, stratum: str, n: int, seed: int) -> DataFrame:
    """n ids shared evenly over the strata: n // L each, one more for the first n % L strata in order."""
    strata = df.where(F.col(stratum).isNotNull()).select(stratum).distinct()
    ranked = strata.withColumn("i", F.row_number().over(Window.orderBy(stratum)) - 1)  # a row per stratum
    total = strata.agg(F.count("*").alias("l"))
    quota = ranked.crossJoin(F.broadcast(total)).select(stratum, (F.floor(F.lit(n) / F.col("l")) + (F.col("i") < F.lit(n) % F.col("l")).cast("int")).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(draw_key(seed, id_col), id_col)
    placed = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)  # a group limit: n rows a task survive
    return placed.join(F.broadcast(quota), stratum).where(F.col("place") <= F.col("quota")).drop("quota")


def disjoint_sizes(pool: int, n_test: int, n_dev: int) -> tuple[int, int, int]:
    """(test, dev, shortfall): as asked, or 60/40 of a pool that is too small, rounded half to even."""
    if pool >= n_test + n_dev:
        return n_test, n_dev, 0
    test = round(pool * 0.6)
    return test, pool - test, n_test + n_dev - pool


def disjoint_draw(ids: DataFrame, id_col: str, n_test: int, n_dev: int, seed_test: int, seed_dev: int) -> DataFrame:
    """(id, split): test from the whole pool, then dev from the rest."""
    pool = ids.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    test_n, dev_n, _ = disjoint_sizes(pool.count(), n_test, n_dev)
    test = sample_n(pool, id_col, test_n, seed_test)
    dev = sample_n(pool.join(test, id_col, "left_anti"), id_col, dev_n, seed_dev)
    return test.withColumn("split", F.lit("test")).union(dev.withColumn("split", F.lit("dev")))


def _take_groups(sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """Whole groups in draw order until at least n items: those before which fewer than n were taken.

    The running sum is over groups, after keeping the n groups first in the draw (each holds an item, so no more are used).
    """
    first = sizes.withColumn("_k", draw_key(seed, "g")).orderBy("_k", "g").limit(n)
    before = F.sum("size").over(Window.orderBy("_k", "g").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).select("g", "size")


def group_disjoint_draw(items: DataFrame, id_col: str, group: Column, n_test: int, n_dev: int, seed: int) -> DataFrame:
    """(id, g, split): whole groups go to test until n_test items, then others to dev; a null group is a group of one."""
    known = items.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.coalesce(group.cast("string"), F.concat(F.lit("__single__"), F.col(id_col).cast("string"))).alias("g")).distinct()
    sizes = known.groupBy("g").agg(F.count("*").alias("size"))
    test = _take_groups(sizes, n_test, seed)
    dev = _take_groups(sizes.join(test.select("g"), "g", "left_anti"), n_dev, seed + 1)
    chosen = test.select("g", F.lit("test").alias("split")).union(dev.select("g", F.lit("dev").alias("split")))
    return known.join(chosen, "g").select(id_col, "g", "split")


def draw_summary(drawn: DataFrame, n_test: int, n_dev: int) -> DataFrame:
    """(split, n_items, n_groups, largest_group, overshoot)."""
    want = F.when(F.col("split") == "test", n_test).otherwise(n_dev)
    per = drawn.groupBy("split", "g").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_groups"), F.max("n").alias("largest_group")).withColumn("overshoot", F.col("n_items") - want)


def check_coverage(items: DataFrame, id_col: str, groups: DataFrame, group_col: str) -> DataFrame:
    """(id) without a group or with a blank one; the draw must refuse to run if there are any."""
    g = groups.select(F.col(id_col), F.col(group_col).alias("_g"))
    return items.select(id_col).distinct().join(g, id_col, "left").where(F.col("_g").isNull() | (F.trim("_g") == "")).select(id_col).distinct()


def conflicting_groups(manifest: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """(id, n_groups) of ids a manifest puts into several groups."""
    return manifest.where(F.col(group_col).isNotNull()).groupBy(id_col).agg(F.countDistinct(group_col).alias("n_groups")).where("n_groups > 1")


def tail_split(df: DataFrame, by: list[str], order: list[str], head_share: float = 0.8) -> DataFrame:
    """df with part head or tail: of each group's rows in order, the first max(1, int(share * n)) are the head."""
    w = Window.partitionBy(*by)
    cut = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(head_share))).cast("long")
    return df.withColumn("part", F.when(F.row_number().over(w.orderBy(*order)) <= cut, "head").otherwise("tail"))


def cohort(df: DataFrame, group: str, order: list[Column], n_groups: int, depth: int, seed: int) -> DataFrame:
    """The first depth rows of n_groups drawn from the groups that have so many."""
    rich = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= depth)
    chosen = rich.withColumn("_k", draw_key(seed, group)).orderBy("_k", group).limit(n_groups).select(group)
    return df.join(chosen, group, "left_semi").withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("position") <= depth)


def item_seed(pool_seed: Column, index: Column, candidate: Column) -> Column:
    """Seed of one candidate of one item."""
    return pool_seed * 100003 + index * 17 + candidate


def group_key(dataset: Column, item: Column, fields: dict[str, Column]) -> Column:
    """Group of an item by its dataset: cut from the id, taken from a field, hashed from a text, or null."""
    get = lambda n: fields.get(n, F.lit(None).cast("string"))
    return (
        F.when(dataset == "aishell-1", F.substring(item, 7, 5))
        .when(dataset == "thchs-30", F.split_part(item, F.lit("_"), F.lit(1)))
        .when(dataset == "librispeech", F.split_part(item, F.lit("-"), F.lit(1)))
        .when(dataset == "voicebench-bbh", F.regexp_replace(item, r"_[^_]*$", ""))
        .when(dataset == "voicebench-sd-qa", F.when(F.contains(item, F.lit("#")), F.split_part(item, F.lit("#"), F.lit(-1))))
        .when(dataset == "squtr", F.when(F.contains(item, F.lit("|")), F.split_part(item, F.lit("|"), F.lit(-1))))
        .when(dataset.isin("crema-d", "esd"), get("spk")).when(dataset == "csemotions", get("speaker"))
        .when(dataset == "meld", get("dialogue_id").cast("string"))
        .when(dataset == "voicebench-mmsu-spoken", F.coalesce(get("src"), get("domain")))
        .when(dataset == "mmsu", get("task_name"))
        .when(dataset == "vocalbench-zh", F.lit(None))
        .when(dataset.startswith("vocalbench-") & (dataset != "vocalbench-emotion"), F.coalesce(get("source"), get("topic"), get("category")))
        .when(dataset.startswith("voiceassistant-"), F.concat(get("category1"), F.lit("/"), get("category2")))
        .when(dataset.isin("slurp", "slurp-slot"), get("scenario"))
        .when(dataset.endswith("-attr"), get("speaker_id")).when(dataset.startswith("speech-massive"), get("scenario_str"))
        .when(dataset == "heysquad", F.substring(F.sha1(get("context")), 1, 16))
        .when(dataset.startswith("air-bench-foundation-"), get("clip_id"))
        .when(dataset == "audio2tool", get("query_idx").cast("string"))
        .when(dataset == "mmau-mini", get("group_key"))
    )


# -- custody ---------------------------------------------------------------------------------------------------------


def set_hash(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by..., n_ids, ids_sha256): SHA-256 over the sorted distinct ids, one a line. A group's ids meet in one row, as the
    definition demands; for groups without bound use set_digest."""
    return df.where(F.col(id_col).isNotNull()).groupBy(*by).agg(
        F.countDistinct(id_col).cast("long").alias("n_ids"), F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(id_col).cast("string"))), "\n"), 256).alias("ids_sha256")
    )


def set_digest(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by..., n_ids, digest): an order-free digest of any number of ids by partial sums of their hashes; for groups too large for one row."""
    one = df.where(F.col(id_col).isNotNull()).select(*by, id_col).distinct()
    parts = [F.sum((F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))).alias(f"s{i}") for i in range(4)]
    return one.groupBy(*by).agg(F.count("*").alias("n_ids"), *parts).select(*by, "n_ids", F.sha2(F.concat_ws("|", "n_ids", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def exposure(test: DataFrame, exposed: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by..., n_test, n_overlap, overlap_fraction): how many ids of a set were exposed before."""
    t, e = test.select(*by, id_col).distinct(), exposed.select(*by, id_col).distinct().withColumn("_hit", F.lit(1))
    return t.join(e, [*by, id_col], "left").groupBy(*by).agg(F.count("*").alias("n_test"), F.count("_hit").alias("n_overlap")).withColumn("overlap_fraction", F.round(F.col("n_overlap") / F.col("n_test"), 4))
