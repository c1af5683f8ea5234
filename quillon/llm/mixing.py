"""Problem 9: mixing sources to target weights by raking (iterative proportional fitting) of token weights.

Cells are source x language x topic. Raking gives each cell a token weight such that the sources have their target
shares while languages and topics keep the shares they have in the listed corpus. A weight is the expected number of
times a document of the cell is taken: its whole part is taken surely, its fraction by a hash of the document id,
calibrated per source so that the tokens taken meet the target. Per-document rows never leave the executors; the
driver sees the cells and a histogram of at most HASH_BINS bins a source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.encode import count_tokens
from quillon.plans.runtime import bounded_rows, broadcast_if_small, cut

HASH_BINS = 2048
#: Bounds of what the driver holds; more raises an error instead of dropping rows.
MAX_TARGETS = 10_000
MAX_CELLS = 200_000
MAX_BINS = 4_000_000


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Fitted cell masses, starting from tokens; axes gives each cell's category on an axis, targets its mass there.

    The first axis is fitted last in every round, so its marginal is exact when the axes contradict each other.
    """
    mass = tokens.astype(float).copy()
    for _ in range(rounds):
        before = mass.copy()
        for axis, want in reversed(list(zip(axes, targets))):
            have = np.bincount(axis, weights=mass, minlength=len(want))
            mass *= np.divide(want, have, out=np.zeros_like(want), where=have > 0)[axis]
        if np.abs(mass - before).max(initial=0) <= tol * max(mass.sum(), 1):
            break
    return mass


def fit_cells(cells: list, targets: dict, total_tokens: float | None = None) -> tuple[dict, float]:
    """Weight of each (source, lang, topic) cell and the token budget.

    Shares are taken over the listed sources that have tokens and may be taken. The budget is total_tokens, or as many
    tokens as these sources have: only the caps limit what is used. A source whose cap doesn't reach its share of the
    budget gives all it may and falls short, which the report shows.
    """
    cells = [c for c in cells if c["source"] in targets and c["tokens"] > 0 and (targets[c["source"]][0] or 0) > 0 and (targets[c["source"]][1] or 0) > 0]
    if not cells:
        return {}, 0.0
    cells.sort(key=lambda c: (c["source"], str(c["lang"]), str(c["topic"])))  # the same sums in every layout
    number = lambda xs: np.unique(np.array([str(x) for x in xs]), return_inverse=True)
    tok = np.array([c["tokens"] for c in cells], dtype=float)
    names, src = number([c["source"] for c in cells])
    _, lang = number([c["lang"] for c in cells])
    _, topic = number([c["topic"] for c in cells])
    have = np.bincount(src, weights=tok)
    share = np.array([targets[n][0] for n in names], dtype=float)
    share /= share.sum()
    caps = np.array([targets[n][1] for n in names], dtype=float)
    budget = float(tok.sum()) if total_tokens is None else float(total_tokens)
    want = np.minimum(share * budget, caps * have)
    total = want.sum()
    mass = rake(tok, [src, lang, topic], [want, np.bincount(lang, weights=tok) / tok.sum() * total, np.bincount(topic, weights=tok) / tok.sum() * total])
    weight = mass / tok
    # no cell above its source's cap; what is cut is spread over the source's other cells
    for _ in range(100):
        over = weight > caps[src] + 1e-12
        weight = np.minimum(weight, caps[src])
        missing = want - np.bincount(src, weights=weight * tok, minlength=len(names))
        if not over.any() or (missing <= 1e-6 * np.maximum(want, 1)).all():
            break
        room = weight < caps[src]
        base = np.bincount(src[room], weights=(weight * tok)[room], minlength=len(names))
        weight[room] *= 1 + np.divide(np.maximum(missing, 0), base, out=np.zeros_like(base), where=base > 0)[src[room]]
    return {(c["source"], c["lang"], c["topic"]): float(w) for c, w in zip(cells, weight)}, budget


def key_limits(bins: list) -> list[tuple[str, float]]:
    """(source, limit): the sampling key up to which a source's fractional takes add up to the tokens wanted.

    bins: rows (source, bin, tokens, wanted) of the histogram of keys. The bins are sorted once, for all sources.
    """
    out: list[tuple[str, float]] = []
    per: dict[str, list] = {}
    for b in bins:
        per.setdefault(b["source"], []).append(b)
    for s, own in sorted(per.items()):
        wanted = sum(b["wanted"] for b in own)
        got, limit = 0.0, 0.0
        for b in sorted(own, key=lambda b: b["bin"]):
            if got + b["tokens"] > wanted:
                limit = (b["bin"] + (wanted - got) / b["tokens"]) / (HASH_BINS // 4)
                break
            got, limit = got + b["tokens"], (b["bin"] + 1) / (HASH_BINS // 4)
        out.append((s, float(limit)))
    return out


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic_col: str = "doc_kind", salt: str = "mix-1", tokenizer: str = "byte_bpe_50k",
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, repeats): every document taken, with how often it is repeated.

    Sources that are not listed, null sources, and documents without tokens are left out; a listed source without
    documents contributes nothing and its share goes to the others in proportion, as does that of a source whose
    max_repeats is null or below 1, which may not be taken at all. repeats never exceeds max_repeats.
    Of repeated target rows of a source the largest share counts. The same ids are chosen in every run and layout.
    """
    spark = docs.sparkSession
    goals: dict = {}
    for r in bounded_rows(targets.select("source", "target_share", "max_repeats"), MAX_TARGETS, "mix targets"):
        if r["source"] is not None and (r["target_share"] or 0) > (goals.get(r["source"], (0, 0))[0] or 0):
            goals[r["source"]] = (r["target_share"], r["max_repeats"])
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
        F.col(topic_col).alias("topic"), F.col(text_col).alias("text"),
    ).where(F.col("source").isin(list(goals)))
    # the tokens are counted once; only ids, categories and counts are kept
    sized = cut(count_tokens(d, "text").drop("text").where("n_tokens > 0"))
    cells = bounded_rows(sized.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), MAX_CELLS, "mix cells")
    weights, _ = fit_cells(cells, goals, total_tokens)
    schema = "source string, lang string, topic string, weight double"
    w = spark.createDataFrame([(*k, v) for k, v in weights.items()] or [], schema)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("source", "lang", "topic")]
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.col("doc_id").cast("string")), 256), 1, 13), 16, 10).cast("double") / F.lit(16.0**13)
    d = (
        sized.alias("d").join(F.broadcast(w.alias("w")), same)  # at most MAX_CELLS short rows
        .select("d.*", "w.weight").where("weight > 0")
        .withColumn("whole", F.floor("weight").cast("int")).withColumn("part", F.col("weight") - F.floor("weight"))
        .withColumn("key", F.when(F.col("part") > 1e-9, unit / F.col("part")))
    )
    # sequential Poisson sampling: a source's fractional takes are its smallest keys, up to the tokens still wanted
    bin_ = F.least(F.floor(F.col("key") * (HASH_BINS // 4)), F.lit(HASH_BINS - 1)).cast("int")
    bins = bounded_rows(
        d.where("key is not null").groupBy("source", bin_.alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("part") * F.col("n_tokens")).alias("wanted")),
        MAX_BINS, "mix bins",
    )
    lim = spark.createDataFrame(key_limits(bins) or [], "source string, limit double")
    return (
        d.join(F.broadcast(lim), "source", "left")
        .withColumn("repeats", F.col("whole") + F.when(F.col("key") < F.col("limit"), 1).otherwise(0))
        .where("repeats > 0").select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "repeats")
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_taken, tokens, actual_share, share_gap): a row per listed source, 0
    where nothing was taken; share_gap is actual less target, below 0 for a source its cap keeps short."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("repeats").alias("n_taken"), F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens")
    )
    got = cut(got)  # a row per source, read for the total too
    every = got.agg(F.sum("tokens").alias("all_tokens"))
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    return (
        targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(F.broadcast(every))  # one row
        .select(
            "source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_taken", "tokens")),
            share.alias("actual_share"), (share - F.col("target_share")).alias("share_gap"),
        )
    )


def mix_marginals(mixed: DataFrame) -> DataFrame:
    """(axis, value, tokens, actual_share): what the mix holds of each language and topic; null is a value."""
    pair = lambda axis: F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("value"))
    long = mixed.select(F.explode(F.array(pair("lang"), pair("topic"))).alias("a"), (F.col("n_tokens").cast("long") * F.col("repeats")).alias("t"))
    got = cut(long.groupBy("a.axis", "a.value").agg(F.sum("t").alias("tokens")))
    every = got.groupBy("axis").agg(F.sum("tokens").alias("all"))
    return got.join(F.broadcast(every), "axis").select("axis", "value", "tokens", (F.col("tokens") / F.col("all")).alias("actual_share"))  # two rows


def mix_limits(mixed: DataFrame, docs: DataFrame, targets: DataFrame, text_col: str = "text") -> DataFrame:
    """(source, n_texts, n_above_cap): the listed sources' documents with a text, and how many were taken too often."""
    t = targets.groupBy("source").agg(F.max("max_repeats").alias("cap"))
    n = docs.where(F.col(text_col) != "").groupBy("source").agg(F.count("*").alias("n_texts"))
    above = mixed.join(broadcast_if_small(t), "source").where(F.col("cap").isNull() | (F.col("repeats") > F.col("cap"))).groupBy("source").agg(F.count("*").alias("n_above_cap"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return t.join(n, "source", "left").join(above, "source", "left").select("source", zero("n_texts"), zero("n_above_cap"))
