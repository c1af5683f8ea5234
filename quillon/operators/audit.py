"""Contamination audits, scrubbing, corpus locks and governed knowledge tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import content_form, ngrams, norm, scrub, tokens
from quillon.plans.runtime import bounded_rows, broadcast_if_small, cut

#: Golds are held in the workers as one automaton; more raise an error.
MAX_GOLDS = 1_000_000


_BUILT: dict = {}


def _machine(name: str, words):
    """An automaton of words, built once in a worker process and kept for its later tasks; the last search's only."""
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        if len(machine):
            machine.make_automaton()
        _BUILT[name] = machine
    return _BUILT[name]


def verdict(rate: Column) -> Column:
    """LEAKAGE from a half on, SUSPECT above nothing, else CLEAN; on the unrounded rate."""
    return F.when(rate >= 0.5, "LEAKAGE").when(rate > 0, "SUSPECT").otherwise("CLEAN")


def containment(entries: DataFrame, entry_id: str, text: Column, golds: DataFrame, gold_id: str, gold: Column) -> DataFrame:
    """(gold_id, entry_id) for every entry that contains a gold's text, both as given (normalize beforehand).

    One pass of an Aho-Corasick automaton of all golds over every entry, linear in the text, instead of a nested loop;
    the golds are a stated, bounded set. Empty and null golds match nothing.
    """
    pairs = [(r["i"], r["g"]) for r in bounded_rows(golds.select(F.col(gold_id).alias("i"), gold.alias("g")).where("g is not null and g <> ''"), MAX_GOLDS, "golds")]
    shared, name = entries.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex
    type_e, type_g = entries.schema[entry_id].dataType.simpleString(), golds.schema[gold_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        owners: dict[str, list] = {}
        for i, g in shared.value:
            owners.setdefault(g, []).append(i)
        machine = _machine(name, owners)
        for b in batches:
            out = []
            if owners:
                for e, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if t:
                        out += [(i, e) for g in {g for _, g in machine.iter(t)} for i in owners[g]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64() if type_g == "bigint" else pa.string()), pa.array([e for _, e in out], b.column(0).type)], names=["gold_id", "entry_id"])

    return entries.select(F.col(entry_id), text.alias("_t")).mapInArrow(run, f"gold_id {type_g}, entry_id {type_e}")


def overlap_audit(found: DataFrame, golds: DataFrame, gold_id: str) -> DataFrame:
    """(n_golds, n_leaked, overlap_rate, verdict): repeated golds count each; no golds give rate 0 and CLEAN."""
    hit = found.select("gold_id").distinct().withColumn("_h", F.lit(1))
    n = golds.select(F.col(gold_id).alias("gold_id")).join(hit, "gold_id", "left").agg(F.count("*").alias("n_golds"), F.count("_h").alias("n_leaked"))
    rate = F.when(F.col("n_golds") > 0, F.col("n_leaked") / F.col("n_golds")).otherwise(0.0)
    return n.select("n_golds", "n_leaked", F.round(rate, 3).alias("overlap_rate"), verdict(rate).alias("verdict"))


def ngram_overlap(entries: DataFrame, text: Column, golds: DataFrame, gold_id: str, gold: Column, n: int = 8) -> DataFrame:
    """(gold_id, n_grams, n_found, overlap): share of a gold's word n-grams that some entry holds.

    Words are projected before the grams are formed, so that a text is normalized once. The entries' grams meet the
    golds' distinct grams in the scan stage where those are small by their written size, so that only matches are
    shuffled. Golds without words have no row.
    """
    words = golds.select(F.col(gold_id).alias("gold_id"), tokens(norm(gold)).alias("w"))
    g = cut(words.select("gold_id", F.explode(F.array_distinct(ngrams(F.col("w"), n))).alias("gram")))
    known = cut(g.select("gram").distinct())
    w = entries.select(tokens(norm(text)).alias("w")).where(F.size("w") > 0)
    e = w.select(F.explode(ngrams(F.col("w"), n)).alias("gram"))
    hit = e.join(broadcast_if_small(known), "gram", "left_semi").distinct().withColumn("_h", F.lit(1))
    return g.join(hit, "gram", "left").groupBy("gold_id").agg(F.count("*").alias("n_grams"), F.count("_h").alias("n_found")).withColumn("overlap", F.round(F.col("n_found") / F.col("n_grams"), 3))


def scrubbed(entries: DataFrame, text: str, golds: DataFrame, gold: str, max_golds: int = MAX_GOLDS) -> DataFrame:
    """entries with every gold removed from the text, whatever its case, longest first, and spaces collapsed.

    An automaton of all golds finds those a text holds, so that only these are replaced. It is repeated until none is
    left, as collapsed spaces and removed parts can join the rest of a gold; null texts stay null.
    """
    rows = [r[0] for r in bounded_rows(golds.where(F.col(gold).isNotNull() & (F.trim(gold) != "")).select(gold).distinct(), max_golds, "golds to scrub")]
    shared = entries.sparkSession.sparkContext.broadcast(sorted({" ".join(g.lower().split()) for g in rows} | {g.lower() for g in rows}))
    name = uuid.uuid4().hex

    @F.pandas_udf("string")
    def remove(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        machine = _machine(name, shared.value)

        def clean(t):
            if t is None or not shared.value:
                return t
            while True:
                held = {g for _, g in machine.iter(t.lower())}
                new = t
                for g in sorted(held, key=lambda g: (-len(g), g)):
                    new = re.sub(re.escape(g), " ", new, flags=re.I)
                new = " ".join(new.split())
                if new == t or not held:
                    return new
                t = new

        for texts in parts:
            yield pd.Series([clean(t) for t in texts], dtype=object)

    return entries.withColumn(text, remove(F.col(text)))


def max_similarity_audit(hits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(n_golds, n_near, near_rate, verdict) from the best similarity (query_id, sim, rank) of every gold."""
    best = hits.where("rank = 0")
    rate = F.when(F.count("*") > 0, F.avg((F.col("sim") >= threshold).cast("double"))).otherwise(0.0)
    return best.agg(F.count("*").alias("n_golds"), F.count_if(F.col("sim") >= threshold).alias("n_near"), F.round(rate, 3).alias("near_rate"), verdict(rate).alias("verdict"))


def corpus_axes(axes: DataFrame) -> DataFrame:
    """axes (name, state) per build -> overall: FAIL(names), PASS-with-NOT_EVALUATED(names) or CLEAN."""
    failing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "FAIL", F.col("axis")))), ",")
    missing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "NOT_EVALUATED", F.col("axis")))), ",")
    return axes.groupBy("source").agg(
        F.when(failing != "", F.concat(F.lit("FAIL("), failing, F.lit(")"))).when(missing != "", F.concat(F.lit("PASS-with-NOT_EVALUATED("), missing, F.lit(")"))).otherwise("CLEAN").alias("overall")
    )


def corpus_lock(docs: DataFrame, by: list[str], doc_id: str, text: str) -> DataFrame:
    """(by..., n_docs, ids_digest, content_digest): a lock of any number of documents, by sums of hashes; the content in
    its normalized form, so that white space and width don't matter. Independent of order and partitioning."""
    c = docs.select(*by, F.col(doc_id).cast("string").alias("i"), F.coalesce(content_form(F.col(text)), F.lit("")).alias("t"))
    num = lambda x: F.conv(F.substring(F.sha2(x, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return c.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(num(F.col("i"))).alias("ids_digest"), F.sum(num(F.concat_ws("\x1f", "i", "t"))).alias("content_digest"))


def verify_lock(lock: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """(by..., verified, mismatches): what differs between a lock and the present state; missing sides fail."""
    parts = ["n_docs", "ids_digest", "content_digest"]
    a = lock.select(*by, *[F.col(p).alias(f"a_{p}") for p in parts])
    b = now.select(*by, *[F.col(p).alias(f"b_{p}") for p in parts])
    bad = F.filter(F.array(*[F.when(~F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")), F.lit(p)) for p in parts]), lambda x: x.isNotNull())
    return a.join(b, by, "full").select(*by, (F.size(bad) == 0).alias("verified"), F.array_join(bad, ",").alias("mismatches"))


def scrub_each(entries: DataFrame, text: str, golds: Column) -> DataFrame:
    """entries scrubbed of their own golds, an array column."""
    return entries.withColumn(text, scrub(F.col(text), golds))


def content_inventory(cards: DataFrame, by: str, content: str) -> DataFrame:
    """(by, n, n_content, n_distinct, mean_chars) per source."""
    return cards.groupBy(by).agg(F.count("*").alias("n"), F.count(content).alias("n_content"), F.countDistinct(content).alias("n_distinct"), F.avg(F.length(content)).alias("mean_chars"))
