"""Cluster-aware statistics. Point estimates and adjustments are window and aggregate expressions; bootstraps work on the
sums and counts of clusters, which are aggregated on the executors first."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95 = 1.959963984540054
#: Clusters of one family that a bootstrap task may hold (16 bytes each).
MAX_CLUSTERS = 5_000_000


def clusters(df: DataFrame, by: list[str], score: str, group: str, item: str) -> DataFrame:
    """(by..., cluster, s, n): sum and count of the scores of each cluster; null scores are dropped, a null group is the
    item alone."""
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("__single__"), F.col(item).cast("string")))
    return df.where(F.col(score).isNotNull()).groupBy(*by, key.alias("cluster")).agg(F.sum(F.col(score).cast("double")).alias("s"), F.count("*").alias("n"))


def _replicates(s: np.ndarray, n: np.ndarray, nboot: int, seed: int) -> np.ndarray:
    """Means of resampled clusters; draws are made a block at a time, so memory is bounded."""
    rng, k, out = np.random.default_rng(seed), len(n), []
    step = max(1, 4_000_000 // max(k, 1))
    for at in range(0, nboot, step):
        idx = rng.integers(0, k, size=(min(step, nboot - at), k))
        out.append(s[idx].sum(axis=1) / n[idx].sum(axis=1))
    return np.concatenate(out)


def _guard(pdf) -> None:
    if len(pdf) > MAX_CLUSTERS:
        raise ValueError("a family with more clusters than one bootstrap task holds")


def cluster_bootstrap(df: DataFrame, by: list[str], score: str, group: str, item: str, nboot: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(by..., mean, lo, hi, n_clusters, n_items, unit): percentile interval of the mean over resampled clusters.

    unit is item where every cluster holds one item. Only a family's clusters come to a task, aggregated beforehand.
    """
    import pandas as pd

    c = clusters(df, by, score, group, item)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(pdf)
        pdf = pdf.sort_values("cluster")
        s, n = pdf["s"].to_numpy(), pdf["n"].to_numpy()
        lo, hi = np.quantile(_replicates(s, n, nboot, seed), [alpha / 2, 1 - alpha / 2])
        row = {b: pdf[b].iloc[0] for b in by}
        return pd.DataFrame([row | {"mean": round(s.sum() / n.sum(), 4), "lo": round(lo, 4), "hi": round(hi, 4), "n_clusters": len(n), "n_items": int(n.sum()), "unit": "item" if len(n) == n.sum() else "cluster"}])

    types = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    return c.groupBy(*by).applyInPandas(run, f"{types}, mean double, lo double, hi double, n_clusters bigint, n_items bigint, unit string")


def paired_bootstrap(pairs: DataFrame, by: list[str], a: str, b: str, group: str, item: str, nboot: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(by..., delta, lo, hi, p, n_clusters, n_items) of mean(a) - mean(b), the same clusters drawn for both arms."""
    import pandas as pd

    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("__single__"), F.col(item).cast("string")))
    c = both.groupBy(*by, key.alias("cluster")).agg(F.sum((F.col(a) - F.col(b)).cast("double")).alias("s"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(pdf)
        pdf = pdf.sort_values("cluster")
        s, n = pdf["s"].to_numpy(), pdf["n"].to_numpy()
        r = _replicates(s, n, nboot, seed)
        lo, hi = np.quantile(r, [alpha / 2, 1 - alpha / 2])
        p = min(1.0, 2 * min((r <= 0).mean(), (r >= 0).mean()))
        return pd.DataFrame([{x: pdf[x].iloc[0] for x in by} | {"delta": round(s.sum() / n.sum(), 4), "lo": round(lo, 4), "hi": round(hi, 4), "p": round(float(p), 6), "n_clusters": len(n), "n_items": int(n.sum())}])

    types = ", ".join(f"`{x}` {pairs.schema[x].dataType.simpleString()}" for x in by)
    return c.groupBy(*by).applyInPandas(run, f"{types}, delta double, lo double, hi double, p double, n_clusters bigint, n_items bigint")


def max_t(pairs: DataFrame, family: str, test: str, a: str, b: str, group: str, nboot: int = 2_000, seed: int = 0) -> DataFrame:
    """(family, test, delta, z, p_adjusted): step-down adjustment over the tests of a family, clusters drawn jointly."""
    import pandas as pd

    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(group).isNotNull())
    c = both.groupBy(family, test, F.col(group).alias("cluster")).agg(F.sum((F.col(a) - F.col(b)).cast("double")).alias("s"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(pdf)
        names = sorted(pdf[test].unique())
        s = pdf.pivot_table(index="cluster", columns=test, values="s", fill_value=0.0).reindex(columns=names).to_numpy()
        n = pdf.pivot_table(index="cluster", columns=test, values="n", fill_value=0.0).reindex(columns=names).to_numpy()
        k, rng = len(s), np.random.default_rng(seed)
        delta = s.sum(0) / n.sum(0)
        reps = []
        for _ in range(nboot):
            i = rng.integers(0, k, k)
            m = n[i].sum(0)
            reps.append(np.divide(s[i].sum(0), m, out=delta.copy(), where=m > 0))
        reps = np.array(reps)
        se = np.maximum(reps.std(0, ddof=1), 1e-12)
        z = delta / se
        t = np.abs((reps - delta) / se)
        order = np.argsort(-np.abs(z), kind="stable")
        adj, last = np.empty(len(names)), 0.0
        for j, o in enumerate(order):
            last = max(last, float((t[:, order[j:]].max(1) >= abs(z[o])).mean()))
            adj[o] = last
        return pd.DataFrame({family: pdf[family].iloc[0], test: names, "delta": delta.round(4), "z": z.round(4), "p_adjusted": adj.round(6)})

    return c.groupBy(family).applyInPandas(run, f"`{family}` {pairs.schema[family].dataType.simpleString()}, `{test}` {pairs.schema[test].dataType.simpleString()}, delta double, z double, p_adjusted double")


def nested_bootstrap(df: DataFrame, outer: str, score: str, group: str, item: str, nboot: int = 2_000, seed: int = 0) -> DataFrame:
    """(mean, lo, hi, n_outer): datasets are drawn, then clusters within them; the mean of dataset means."""
    import pandas as pd

    c = clusters(df, [outer], score, group, item)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(pdf)
        rng = np.random.default_rng(seed)
        parts = [(g["s"].to_numpy(), g["n"].to_numpy()) for _, g in pdf.sort_values([outer, "cluster"]).groupby(outer, dropna=False)]
        point = float(np.mean([s.sum() / n.sum() for s, n in parts]))
        reps = []
        for _ in range(nboot):
            ms = []
            for j in rng.integers(0, len(parts), len(parts)):
                s, n = parts[j]
                i = rng.integers(0, len(n), len(n))
                ms.append(s[i].sum() / n[i].sum())
            reps.append(np.mean(ms))
        lo, hi = np.quantile(reps, [0.025, 0.975])
        return pd.DataFrame([{"mean": round(point, 4), "lo": round(lo, 4), "hi": round(hi, 4), "n_outer": len(parts)}])

    return c.groupBy(F.lit(1).alias("_one")).applyInPandas(run, "mean double, lo double, hi double, n_outer bigint")


def index_bootstrap(df: DataFrame, by: list[str], score: str, group: str, item: str, nboot: int = 2_000, seed: int = 42) -> DataFrame:
    """(by..., mean, lo, hi): the variant with the standard library's generator and truncated percentile indexes."""
    import pandas as pd

    c = clusters(df, by, score, group, item)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(pdf)
        pdf = pdf.sort_values("cluster")
        s, n, rng = pdf["s"].tolist(), pdf["n"].tolist(), random.Random(seed)
        reps = []
        for _ in range(nboot):
            pick = [rng.randrange(len(s)) for _ in s]
            reps.append(sum(s[i] for i in pick) / sum(n[i] for i in pick))
        reps.sort()
        return pd.DataFrame([{b: pdf[b].iloc[0] for b in by} | {"mean": sum(s) / sum(n), "lo": reps[int(0.025 * nboot)], "hi": reps[int(0.975 * nboot) - 1]}])

    types = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    return c.groupBy(*by).applyInPandas(run, f"{types}, mean double, lo double, hi double")


def hierarchical_bootstrap(df: DataFrame, by: list[str], item: str, replicate: str, errors: str, length: str, base_errors: str, nboot: int = 10_000, seed: int = 0) -> DataFrame:
    """(by..., macro_delta, macro_lo, macro_hi, macro_sig, corpus_delta, corpus_lo, corpus_hi, corpus_sig, n_items): how much
    a selection lowers error rates against a base; items are drawn, then each drawn item's replicates.

    Items need the same number of replicates (see complete_cases). The deltas are those of the data; a delta is
    significant if its lower bound is above 0. A family's items come to one task, bounded like the other bootstraps.
    """
    import pandas as pd

    rows = df.select(*by, item, replicate, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys((errors, length, base_errors))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(pdf)
        pdf = pdf.sort_values([item, replicate])
        table = lambda c: pdf[c].to_numpy().reshape(pdf[item].nunique(), -1)
        e, n, g = table(errors), table(length), table(base_errors)
        k, r = e.shape
        rng = np.random.default_rng(seed)

        def deltas(rows_, cols):
            es, ns, gs = e[rows_[:, None], cols], n[rows_[:, None], cols], g[rows_[:, None], cols]
            return (gs / ns - es / ns).mean(), (gs.sum() - es.sum()) / ns.sum()

        macro, corpus = deltas(np.arange(k), np.broadcast_to(np.arange(r), (k, r)))
        reps = np.array([deltas(rng.integers(0, k, k), rng.integers(0, r, (k, r))) for _ in range(nboot)])
        lo, hi = np.quantile(reps, [0.025, 0.975], axis=0)
        row = {b: pdf[b].iloc[0] for b in by}
        for i, (name, point) in enumerate((("macro", macro), ("corpus", corpus))):
            row |= {f"{name}_delta": round(float(point), 5), f"{name}_lo": round(float(lo[i]), 5), f"{name}_hi": round(float(hi[i]), 5), f"{name}_sig": bool(round(float(lo[i]), 5) > 0)}
        return pd.DataFrame([row | {"n_items": k}])

    types = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    out = ", ".join(f"{n}_delta double, {n}_lo double, {n}_hi double, {n}_sig boolean" for n in ("macro", "corpus"))
    return rows.groupBy(*by).applyInPandas(run, f"{types}, {out}, n_items bigint")


# -- closed forms ----------------------------------------------------------------------------------------------------


def holm(df: DataFrame, p: str, family: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """df with p_holm and reject: running maximum of min(1, (m - i) p), within each family; null p-values are left out."""
    w = Window.partitionBy(*family)
    o = w.orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count("*").over(w) + 1 - F.row_number().over(o)) * F.col(p))
    out = df.where(F.col(p).isNotNull()).withColumn("_s", step)
    return out.withColumn("p_holm", F.round(F.max("_s").over(o.rowsBetween(Window.unboundedPreceding, 0)), 6)).withColumn("reject", F.max("_s").over(o.rowsBetween(Window.unboundedPreceding, 0)) <= alpha).drop("_s")


def variance_from_interval(lo: Column, hi: Column, z: float = Z95) -> Column:
    return F.pow((hi - lo) / 2 / z, F.lit(2))


def random_effects(df: DataFrame, by: list[str], effect: str, variance: str) -> DataFrame:
    """(by..., k, q, tau2, i2, pooled, se, lo, hi): DerSimonian-Laird; variances of nothing count as 1e-12, a single
    effect has no heterogeneity."""
    w = 1 / F.when(F.col(variance) > 0, F.col(variance)).otherwise(1e-12)
    one = df.where(F.col(effect).isNotNull() & F.col(variance).isNotNull()).select(*by, F.col(effect).alias("y"), F.col(variance).alias("v"), w.alias("w"))
    sums = one.groupBy(*by).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("y")).alias("swy"))
    q = one.join(sums, by).groupBy(*by).agg(F.first("k").alias("k"), F.first("sw").alias("sw"), F.first("sw2").alias("sw2"), F.sum(F.col("w") * F.pow(F.col("y") - F.col("swy") / F.col("sw"), F.lit(2))).alias("q"))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    q = q.withColumn("tau2", F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0))
    q = q.withColumn("q", F.when(F.col("k") > 1, F.col("q")).otherwise(0.0)).withColumn("i2", F.when((F.col("k") > 1) & (F.col("q") > 0), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0))
    star = 1 / (F.when(F.col("v") > 0, F.col("v")).otherwise(1e-12) + F.col("tau2"))
    pooled = one.join(q.select(*by, "tau2"), by).groupBy(*by).agg((F.sum(star * F.col("y")) / F.sum(star)).alias("pooled"), F.sqrt(1 / F.sum(star)).alias("se"))
    return q.join(pooled, by).select(*by, "k", "q", "tau2", "i2", "pooled", "se", (F.col("pooled") - Z95 * F.col("se")).alias("lo"), (F.col("pooled") + Z95 * F.col("se")).alias("hi"))


def intraclass(df: DataFrame, by: list[str], score: str, group: str) -> DataFrame:
    """(by..., n_groups, n_items, f, icc): one-way ICC(1) with the size correction of unequal groups."""
    g = df.where(F.col(score).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(F.col(score).cast("double")).alias("m"), F.var_pop(F.col(score).cast("double")).alias("v"))
    s = g.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    between = (F.col("smm") - F.col("sm") * F.col("sm") / F.col("t")) / (F.col("k") - 1)
    within = F.col("within") / (F.col("t") - F.col("k"))
    n0 = (F.col("t") - F.col("n2") / F.col("t")) / (F.col("k") - 1)
    ok = (F.col("k") > 1) & (F.col("t") > F.col("k")) & (F.col("within") > 0)
    return s.select(*by, F.col("k").alias("n_groups"), F.col("t").alias("n_items"), F.when(ok, between / within).alias("f"), F.when(ok, (between - within) / (between + (n0 - 1) * within)).alias("icc"))


def interval_verdict(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "SIG(+)").when(hi < 0, "SIG(-)").otherwise("n.s.")
