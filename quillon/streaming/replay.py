"""Streams: ordered sessions with state per key, resumable micro-batches, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.selectors import Memory


def memory_stream(candidates: DataFrame, speaker: str, step: str, variant: str = "set", weight: float = 0.2, support: int = 1) -> DataFrame:
    """(speaker, step, pick, memory) as a stream: the fold of memory_select with the memory kept as state per speaker.

    candidates: a stream of (speaker, step, idx, z, n_tokens, rare). The pools of a speaker in one micro-batch are taken
    in the order of step; a pool must arrive whole in one batch, and batches in order.
    """
    import pandas as pd

    type_s, type_o = candidates.schema[speaker].dataType.simpleString(), candidates.schema[step].dataType.simpleString()

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Memory(variant, weight, support)
        if state.exists:
            tokens, past, counts = state.get
            m.tokens = set(tokens)
            m.remember([frozenset(p["t"]) for p in past], [p["u"] for p in past])
            m.add({c["t"]: c["n"] for c in counts})
        rows = []
        for o, pool in pd.concat(list(frames)).groupby(step, sort=True):
            pool = pool.sort_values("idx")
            sets, z = [frozenset(r) for r in pool["rare"]], pool["z"].tolist()
            scores = m.score(sets, pool["n_tokens"].tolist(), z)
            best = max(range(len(scores)), key=lambda i: (scores[i], -i))
            rows.append((key[0], o, int(pool["idx"].iloc[best]), m.size()))
            m.update(sets, best, z)
        state.update((sorted(m.tokens), [{"t": sorted(s), "u": float(u)} for s, u in m.past()], [{"t": t, "n": n} for t, n in sorted(m.counts.items())]))
        yield pd.DataFrame(rows, columns=[speaker, step, "pick", "memory"])

    return candidates.groupBy(speaker).applyInPandasWithState(
        fold, f"`{speaker}` {type_s}, `{step}` {type_o}, pick int, memory bigint",
        "tokens array<string>, past array<struct<t:array<string>,u:double>>, counts array<struct<t:string,n:int>>", "append", GroupStateTimeout.NoTimeout,
    )


def snapshots(picks: DataFrame, speaker: str, step: str, donors: DataFrame) -> DataFrame:
    """(speaker, step, donor, donor_step): every step with the donor's step at the same position, or the donor's last."""
    from pyspark.sql.window import Window

    n = picks.withColumn("p", F.row_number().over(Window.partitionBy(speaker).orderBy(step)))
    size = n.groupBy(F.col(speaker).alias("donor")).agg(F.max("p").alias("size"))
    j = n.join(donors.select(F.col(speaker), "donor"), speaker).join(size, "donor").withColumn("q", F.least("p", "size"))
    d = n.select(F.col(speaker).alias("donor"), F.col("p").alias("q"), F.col(step).alias("donor_step"))
    return j.join(d, ["donor", "q"]).select(speaker, step, "donor", "donor_step")


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id_col: str) -> None:
    """Processes what is available in micro-batches and ends; a rerun goes on where it stopped.

    A batch that was interrupted is done again: ids already written are left out, so nothing is written twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        from quillon.sources.sinks import resume

        work(resume(batch, out, id_col)).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, by, n, total) over tumbling or sliding windows; later events than the watermark allows are dropped by
    a stream, never by a batch."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): sessions that end when a key is silent for the gap."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first delivery of every key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
