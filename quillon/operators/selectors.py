"""Choosing among candidates of a pool: batch selectors as expressions, and the ordered selectors with memory."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from heapq import nsmallest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillon.functions.scoring import align
from quillon.functions.text import speech_tokens, transcript


def number_candidates(df: DataFrame, pool: list[str], order: list[str]) -> DataFrame:
    """df with idx, 0 for the first candidate of a pool."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*pool).orderBy(*order)) - 1)


def consensus(df: DataFrame, pool: list[str], text: str, n: int = 8) -> DataFrame:
    """(pool..., idx, utility): mean negative word edit distance of each of the first n candidates to the others (symmetric).

    Equal candidates are compared once; pools are cut to their first n candidates, so a pool is at most n(n-1)/2 pairs.
    """
    first = df.where(F.col("idx") < n).select(*pool, "idx", F.coalesce(transcript(F.col(text)), F.lit("")).alias("t"))
    forms = first.groupBy(*pool, "t").agg(F.count("*").alias("m"))
    a, b = forms.alias("a"), forms.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in pool]
    pairs = a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in pool], F.col("a.t").alias("t"), F.col("b.t").alias("u"), F.col("b.m").alias("m"))
    far = pairs.withColumn("far", word_distance("t", "u"))
    total = far.groupBy(*pool, "t").agg(F.sum(F.col("far") * F.col("m")).alias("far"), F.sum("m").alias("all"))
    scored = total.withColumn("utility", F.when(F.col("all") > 1, -F.col("far") / (F.col("all") - 1)).otherwise(0.0)).select(*pool, "t", "utility")
    return first.join(scored, [*pool, "t"]).select(*pool, "idx", "utility")


@F.pandas_udf(DoubleType())
def word_distance(a, b):
    import pandas as pd

    out, known = [], {}
    for x, y in zip(a, b):
        k = (x, y) if x <= y else (y, x)
        if k not in known:
            s, d, i, _ = align(k[0].split(), k[1].split())
            known[k] = float(s + d + i)
        out.append(known[k])
    return pd.Series(out, dtype="float64")


def z_scores(df: DataFrame, pool: list[str], value: str, out: str = "z") -> DataFrame:
    """df with the value's z-score within its pool, by the population deviation; 0 where all are equal."""
    w = Window.partitionBy(*pool)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def pick(df: DataFrame, pool: list[str], value: str, highest: bool = True) -> DataFrame:
    """(pool..., idx): the candidate with the best value, the lowest index of equal ones."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*pool).agg(F.min(F.struct((-v if highest else v).alias("v"), F.col("idx").alias("idx"))).alias("b")).select(*pool, "b.idx")


def first_endorsed(df: DataFrame, pool: list[str], vote: str) -> DataFrame:
    """(pool..., idx): the first candidate with a vote, or candidate 0."""
    return df.groupBy(*pool).agg(F.coalesce(F.min(F.when(F.col(vote) == 1, F.col("idx"))), F.lit(0)).alias("idx"))


def agreement(df: DataFrame, pool: list[str], text: str, threshold: float = 0.6) -> DataFrame:
    """(pool..., n, rate, triggered): share of candidate pairs with equal texts, and whether it is too low for one pass.

    Pairs are counted from the sizes of equal texts; no pair is formed. A pool of one agrees with itself.
    """
    c = df.where(F.col(text).isNotNull()).groupBy(*pool, text).agg(F.count("*").alias("m"))
    s = c.groupBy(*pool).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("same"))
    rate = F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return s.select(*pool, "n", rate.alias("rate"), (rate < threshold).alias("triggered"))


def weighted_vote(df: DataFrame, pool: list[str], answer: str, weight: str) -> DataFrame:
    """(pool..., answer, weight): the answer with the largest sum of weights, ties to the one seen first."""
    s = df.where(F.col(answer).isNotNull()).groupBy(*pool, answer).agg(F.sum(weight).alias("w"), F.min("idx").alias("i"))
    return s.groupBy(*pool).agg(F.min(F.struct((-F.col("w")).alias("w"), "i", F.col(answer).alias("a"))).alias("b")).select(*pool, F.col("b.a").alias(answer), (-F.col("b.w")).alias("weight"))


# -- ordered memory --------------------------------------------------------------------------------------------------


def rare_tokens(df: DataFrame, key: list[str], text: str, most: int, least_chars: int = 4) -> DataFrame:
    """(key..., rare): the tokens of a text that the whole corpus holds at most `most` times, in order of first place."""
    t = df.select(*key, F.posexplode(speech_tokens(F.coalesce(F.col(text), F.lit("")))).alias("p", "token")).where(F.length("token") >= least_chars)
    freq = t.groupBy("token").agg(F.count("*").alias("f")).where(F.col("f") <= most).select("token")
    kept = t.join(freq, "token").groupBy(*key, "token").agg(F.min("p").alias("p"))
    rare = kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda s: s["token"]).alias("rare"))  # one text's tokens
    return df.select(*key).join(rare, key, "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


class Memory:
    """State of one speaker; score before update. variant: 'set' (token set), 'near' (weighted neighbours), 'count' (smoothed counts).

    Past candidates are kept as the places that hold each token, so a candidate is compared only with those it shares a
    token with, and no step costs more for what it has nothing in common with.
    """

    def __init__(self, variant: str, weight: float, support: int = 1):
        self.variant, self.weight, self.support = variant, weight, support
        self.tokens: set[str] = set()
        self.holders: dict[str, array] = {}
        self.sizes, self.values = array("q"), array("d")
        self.counts: dict[str, int] = {}
        self.total = 0

    def size(self) -> int:
        return len(self.tokens) if self.variant == "set" else len(self.values) if self.variant == "near" else self.total

    def score(self, pool: list[frozenset], lengths: list[int], z: list[float]) -> list[float]:
        if self.variant == "set":
            return [v + self.weight * len(r & self.tokens) / max(1, n) for r, n, v in zip(pool, lengths, z)]
        if self.variant == "near":
            out = []
            for r, v in zip(pool, z):
                near = self.nearest(r)
                out.append((1 - self.weight) * v + self.weight * (sum(s * u for s, u in near) / sum(s for s, _ in near) if near else 0.0))
            return out
        vocabulary = max(1, len(self.counts) + len({w for r in pool for w in r if w not in self.counts}))
        prior = [sum(math.log((self.counts.get(w, 0) + 1) / (self.total + vocabulary)) for w in r) / len(r) if r else 0.0 for r in pool]
        a = np.array(prior)
        zp = (a - a.mean()) / a.std() if a.std() > 0 else np.zeros(len(a))
        return [v + self.weight * float(p) for v, p in zip(z, zp)]

    def nearest(self, rare: frozenset, k: int = 8) -> list[tuple[float, float]]:
        """(Jaccard similarity, value) of the k past candidates most like this one; the earlier of equal ones, none without a common token."""
        shared = Counter(i for t in rare for i in self.holders.get(t, ()))
        best = nsmallest(k, ((-n / (len(rare) + self.sizes[i] - n), i) for i, n in shared.items()))
        return [(-s, self.values[i]) for s, i in best]

    def remember(self, pool: list[frozenset], z: list[float]) -> None:
        for r, v in zip(pool, z):
            for t in r:
                self.holders.setdefault(t, array("q")).append(len(self.values))
            self.sizes.append(len(r))
            self.values.append(v)

    def past(self) -> list[tuple[set, float]]:
        """The past candidates as they were remembered."""
        sets: list[set] = [set() for _ in self.values]
        for t, places in self.holders.items():
            for i in places:
                sets[i].add(t)
        return list(zip(sets, self.values))

    def add(self, counts: dict[str, int]) -> None:
        for t, n in counts.items():
            self.counts[t] = self.counts.get(t, 0) + n
            self.total += n

    def update(self, pool: list[frozenset], chosen: int, z: list[float]) -> None:
        rare = pool[chosen]
        if self.variant == "set":
            self.tokens |= {t for t in rare if sum(t in r for r in pool) >= self.support}
        elif self.variant == "near":
            self.remember(pool, z)
        else:
            self.add(dict.fromkeys(rare, 1))


def memory_select(df: DataFrame, speaker: str, order: str, variant: str = "set", weight: float = 0.2, support: int = 1) -> DataFrame:
    """(speaker, order, pick, memory): pools of candidates visited in order per speaker, the memory fed by each pick.

    df: (speaker, order, idx, z, n_tokens, rare). The update depends on the pick, so a speaker is a sequential fold; its
    rows stream through in sorted order, a pool at a time. This is the one place where a key's rows must follow each
    other: a speaker with very many pools makes one long task, though never a large one.
    """
    packed = df.groupBy(speaker, order).agg(F.array_sort(F.collect_list(F.struct("idx", "z", "n_tokens", "rare"))).alias("pool"))  # at most the pool size
    type_s, type_o = df.schema[speaker].dataType.simpleString(), df.schema[order].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        here, memory = object(), None
        for b in batches:
            rows = []
            for s, o, pool in zip(*(c.to_pylist() for c in b.columns)):
                if s != here:
                    here, memory = s, Memory(variant, weight, support)
                sets = [frozenset(c["rare"]) for c in pool]
                z = [c["z"] for c in pool]
                chosen = int(np.argmax(memory.score(sets, [c["n_tokens"] for c in pool], z)))
                rows.append((s, o, pool[chosen]["idx"], memory.size()))
                memory.update(sets, chosen, z)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], b.column(1).type), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=[speaker, order, "pick", "memory"])

    ordered = packed.repartition(speaker).sortWithinPartitions(speaker, order)
    return ordered.select(speaker, order, "pool").mapInArrow(run, f"`{speaker}` {type_s}, `{order}` {type_o}, pick int, memory bigint")


def past_union(df: DataFrame, by: str, order: str, values: str, last: int) -> DataFrame:
    """df with past: the distinct values of the last rows strictly before, newest state last; a window, since the update
    doesn't depend on a choice. last bounds the frame, so a long session costs no more per row than a short one."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-last, -1)
    return df.withColumn("past", F.array_distinct(F.flatten(F.collect_list(values).over(w))))


def past_distinct(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """df with n_past: how many distinct values all rows strictly before have; a running sum of first occurrences, so the
    memory has no bound and no row carries it."""
    first = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_b"), F.col(value).alias("_v")).agg(F.min(order).alias("_o"))
    new = first.groupBy("_b", "_o").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = df.withColumn("_i", F.row_number().over(Window.partitionBy(by, order).orderBy(F.lit(1)))).join(new, (F.col(by) == F.col("_b")) & (F.col(order) == F.col("_o")) & (F.col("_i") == 1), "left")
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(w)
    here = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy(by, order))
    return flagged.withColumn("n_past", upto - here).drop("_b", "_o", "_n", "_i")


def derangement(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, donor, value): every key with the value of the next one in order, the last with the first's; a row per key."""
    w = Window.orderBy(key)
    return df.select(
        key, F.coalesce(F.lead(key).over(w), F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("donor"),
        F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(value),
    )


def spans(df: DataFrame, by: list[str], order: str, label: str, outside: str) -> DataFrame:
    """(by..., label, first, last, n): runs of equal labels; `outside` breaks a run and forms none."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    runs = df.withColumn("_r", new).withColumn("_g", F.sum("_r").over(w)).where(F.col(label).isNotNull() & (F.col(label) != outside))
    return runs.groupBy(*by, label, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_g")


def edge_reorder(df: DataFrame, by: str, rank: str) -> DataFrame:
    """df with position: even ranks fill from the left, odd ones from the right, so the strongest stand at the edges."""
    n = F.count("*").over(Window.partitionBy(by))
    r = F.col(rank)
    return df.withColumn("position", F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2)).cast("int"))


def complete_cases(df: DataFrame, key: list[str], replica: str, n: int) -> DataFrame:
    """The rows of keys that have all n replicas."""
    full = df.where(F.col(replica).isNotNull()).groupBy(*key).agg(F.countDistinct(replica).alias("_n")).where(F.col("_n") == n).select(*key)
    return df.join(full, key, "left_semi")


def restrict(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is listed, each once however often it is listed; the rows' own order column keeps their order."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def truth_rank(df: DataFrame, by: list[str], token: str, order: str, truth: str) -> DataFrame:
    """(by..., rank, top1, top3): place of the true token among a key's tokens by frequency, the first seen of equal ones
    first; null where the key doesn't hold it. Counts are ranked, not occurrences."""
    c = df.groupBy(*by, F.col(token).alias("t")).agg(F.count("*").alias("n"), F.min(order).alias("o"), F.max((F.col(token) == F.col(truth)).cast("int")).alias("hit"))
    best = c.where("hit = 1").select(*by, F.col("n").alias("tn"), F.col("o").alias("to"))
    ahead = c.join(best, by).where((F.col("n") > F.col("tn")) | ((F.col("n") == F.col("tn")) & (F.col("o") < F.col("to")))).groupBy(*by).agg(F.count("*").alias("a"))
    rank = F.when(F.col("tn").isNotNull(), F.coalesce("a", F.lit(0)) + 1)
    return c.select(*by).distinct().join(best, by, "left").join(ahead, by, "left").select(*by, rank.alias("rank"), F.coalesce(rank == 1, F.lit(False)).alias("top1"), F.coalesce(rank <= 3, F.lit(False)).alias("top3"))


def overlap_flip(df: DataFrame, pool: list[str], overlap: str, z: str) -> DataFrame:
    """(pool..., first, idx, flipped): the candidate best by z, unless another has strictly more overlap with the memory;
    of those with the most overlap the best by z is taken. Ties go to the lower index."""
    lead = F.min(F.struct((-F.col(z)).alias("z"), F.col("idx").alias("i"), F.col(overlap).alias("o"))).alias("a")
    most = F.min(F.struct((-F.col(overlap)).alias("o"), (-F.col(z)).alias("z"), F.col("idx").alias("i"))).alias("b")
    flip = -F.col("b.o") > F.col("a.o")
    return df.groupBy(*pool).agg(lead, most).select(*pool, F.col("a.i").alias("first"), F.when(flip, F.col("b.i")).otherwise(F.col("a.i")).alias("idx"), flip.alias("flipped"))


def flip_weights(df: DataFrame, pool: list[str], overlap: str, z: str, length: str) -> DataFrame:
    """(pool..., weight): the smallest weight of a unit overlap per token at which the best candidate with more overlap than
    the one chosen by z overtakes it; pools without such a candidate are left out."""
    f = overlap_flip(df, pool, overlap, z).where("flipped").select(*pool, "first", "idx")
    a = df.select(*pool, F.col("idx").alias("first"), F.col(z).alias("za"))
    b = df.select(*pool, "idx", F.col(z).alias("zb"), F.col(length).alias("n"))
    return f.join(a, [*pool, "first"]).join(b, [*pool, "idx"]).select(*pool, ((F.col("za") - F.col("zb")) * F.col("n")).alias("weight"))


def battery(df: DataFrame, pool: list[str], values: dict[str, str], sizes: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(pool..., n_first, selector, idx): the pick of every selector, a value column to be highest, among the first n
    candidates; the candidates are exploded to the sizes they belong to and picked in one aggregation."""
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda n: F.col("idx") < n)
    long = df.select(*pool, "idx", F.explode(fits).alias("n_first"), F.array(*(F.struct(F.lit(s).alias("selector"), F.col(c).cast("double").alias("v")) for s, c in values.items())).alias("s"))
    each = long.select(*pool, "idx", "n_first", F.explode("s").alias("s")).where("s.v is not null")
    return each.groupBy(*pool, "n_first", F.col("s.selector").alias("selector")).agg(F.min(F.struct((-F.col("s.v")).alias("v"), F.col("idx").alias("i"))).alias("b")).select(*pool, "n_first", "selector", F.col("b.i").alias("idx"))
