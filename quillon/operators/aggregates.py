"""Grouped measures: F1 over labels and slots, modes with a defined tie, coverage and selection gains, set hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def macro_f1(df: DataFrame, by: list[str], gold: str, pred: str) -> tuple[DataFrame, DataFrame]:
    """((by..., label, precision, recall, f1, support), (by..., macro_f1)): labels are the golds', a null prediction is a
    miss, each label's F1 is rounded to four places before the mean."""
    counts = df.where(F.col(gold).isNotNull()).groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    golds = counts.groupBy(*by, F.col("g").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    preds = counts.where("p is not null").groupBy(*by, F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    j = golds.join(preds, [*by, "label"], "left").withColumn("said", F.coalesce("said", F.lit(0)))
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    per = j.select(*by, "label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), "support")
    return per, per.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def slot_f1(gold: DataFrame, pred: DataFrame, by: list[str], item: str, label: str, phrase: str) -> DataFrame:
    """(by..., label, tp, fp, fn, f1): multiset intersection of (label, phrase) per item, repeated pairs numbered apart."""
    key = [*by, item, label, phrase]
    g = gold.groupBy(*key).agg(F.count("*").alias("g"))
    p = pred.groupBy(*key).agg(F.count("*").alias("p"))
    j = g.join(p, key, "full").select(*key, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    s = j.groupBy(*by, label).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    return s.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by..., value, n): the most frequent value, of several the one seen first; nulls don't count.

    Counted per value before the shuffle by group, so a hot group is as many rows as it has values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    best = c.groupBy(*by).agg(F.max(F.struct(F.col("n"), (-F.col("_o")).alias("_o"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def best_of(df: DataFrame, by: list[str], score: Column, tie: str, keep: list[str], highest: bool = True) -> DataFrame:
    """(by..., keep...): the row with the best score, ties to the lowest tie column; rows with a null score are left out."""
    s = score.cast("double")
    pack = F.struct((-s if highest else s).alias("s"), F.col(tie).alias("t"), *[F.col(c).alias(f"k_{c}") for c in keep])
    return df.where(s.isNotNull()).groupBy(*by).agg(F.min(pack).alias("b")).select(*by, *[F.col(f"b.k_{c}").alias(c) for c in keep])


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., upper_median): the element at n // 2 of the sorted values, by counting values rather than gathering them."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    r = c.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return r.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))


def coverage(df: DataFrame, by: list[str], item: str, index: str, correct: str, sizes: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(by..., n_first, predicted, observed): chance that one of the first N candidates is right, as 1 - (1 - p)^N from the
    item's rate and as seen among the first N. Items with fewer candidates than N are left out at that N."""
    n = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("n_first")
    per = df.where(F.col(correct).isNotNull()).groupBy(*by, item).agg(
        F.avg(F.col(correct).cast("double")).alias("rate"), F.count("*").alias("m"), *[F.max(F.when(F.col(index) < s, F.col(correct))).alias(f"hit{s}") for s in sizes]
    )
    hit = F.coalesce(*[F.when(F.col("n_first") == s, F.col(f"hit{s}")) for s in sizes])
    long = per.select(*by, item, "rate", "m", *[f"hit{s}" for s in sizes], n).where(F.col("m") >= F.col("n_first"))
    return long.groupBy(*by, "n_first").agg(F.count("*").alias("n_items"), F.avg(1 - F.pow(1 - F.col("rate"), F.col("n_first"))).alias("predicted"), F.avg(hit.cast("double")).alias("observed"))


def oracle_gain(df: DataFrame, by: list[str], item: str, index: str, correct: str) -> DataFrame:
    """(by..., greedy, oracle, delta, saturated): the first candidate against any candidate."""
    per = df.where(F.col(correct).isNotNull()).groupBy(*by, item).agg(F.min_by(correct, index).alias("g"), F.max(correct).alias("o"))
    s = per.groupBy(*by).agg(F.count("*").alias("n_items"), F.avg(F.col("g").cast("double")).alias("greedy"), F.avg(F.col("o").cast("double")).alias("oracle"))
    return s.withColumn("delta", F.col("oracle") - F.col("greedy")).withColumn("saturated", F.col("greedy") >= 0.9)


def realization(greedy: Column, selected: Column, oracle: Column) -> Column:
    """Share of the headroom a selector realizes; null where there is none."""
    return F.when(oracle - greedy > 1e-9, (selected - greedy) / (oracle - greedy))


def winner(df: DataFrame, mean: str, simplicity: list[str], eps: float) -> DataFrame:
    """The configuration with the best mean, or of those within eps of it the simplest."""
    top = df.agg(F.max(mean).alias("_top"))
    near = df.crossJoin(F.broadcast(top)).where(F.col(mean) >= F.col("_top") - eps).drop("_top")  # one row
    return near.orderBy(*simplicity).limit(1)


def ordered_stream_hash(df: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """(by..., n, stream_sha256): SHA-256 over the rows in order, fields joined by 0x1f and rows by 0x1e.

    The definition is sequential, so a group's fields meet in one row; meant for manifests, not for corpora (see corpus_lock).
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(packed, lambda s: s["r"]), "\x1e"), 256).alias("stream_sha256"))


def map_hash(pairs: Column) -> Column:
    """SHA-256 of a map<string,string> in canonical JSON: keys sorted, null values as null."""
    entries = F.array_sort(F.map_entries(pairs))
    quote = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.array_join(F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(": "), F.coalesce(quote(e["value"]), F.lit("null")))), ", ")
    return F.sha2(F.concat(F.lit("{"), text, F.lit("}")), 256)
