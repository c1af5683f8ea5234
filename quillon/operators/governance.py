"""Governed knowledge sources: what may be persisted, loaded and asked in which modality."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import audit
from quillon.sources import scans, sinks


class Refused(RuntimeError):
    """A source that may not be persisted or loaded."""


#: Ways a query may ask a source keyed in another modality, by the source's embedder.
ROUTES = {"glap": "pending", "clap": "supported"}


def audited(values: DataFrame, value_id: str, text: Column, golds: DataFrame, gold_id: str, gold: Column, source: str = "source") -> DataFrame:
    """(source, n_golds, n_leaked, overlap_rate, verdict): the share of all golds that each source's values hold."""
    owner = values.select(F.col(value_id).alias("entry_id"), F.col(source).alias("source"))
    found = audit.containment(values, value_id, text, golds, gold_id, gold).join(owner, "entry_id").select("source", "gold_id").distinct()
    leaked = found.groupBy("source").agg(F.count("*").alias("n_leaked"))
    n = golds.agg(F.count("*").alias("n_golds"))
    rate = F.when(F.col("n_golds") > 0, F.col("n_leaked") / F.col("n_golds")).otherwise(0.0)
    j = owner.select("source").distinct().join(leaked, "source", "left").crossJoin(F.broadcast(n)).withColumn("n_leaked", F.coalesce("n_leaked", F.lit(0)))  # one row
    return j.select("source", "n_golds", "n_leaked", F.round(rate, 3).alias("overlap_rate"), audit.verdict(rate).alias("verdict"))


def persist_source(values: DataFrame, path: str, verdict: str | None, manifest: dict | None = None, force: bool = False, enforce: bool = True, supersede: str | None = None) -> dict:
    """Writes values and manifest; a source with the verdict LEAKAGE is refused unless forced, which the manifest says.

    enforce is False for open corpora, whose audit only describes.
    """
    forced = verdict == "LEAKAGE" and enforce
    if forced and not force:
        raise Refused(f"{path}: the audit found LEAKAGE")
    record = (manifest or {}) | {"verdict": verdict, "forced": forced}
    sinks.write_version(values, path, record, supersede)
    return record


def load_source(spark: SparkSession, path: str, allow_unclean: bool = False) -> tuple[DataFrame, dict]:
    """(values, manifest) of a persisted source; one whose verdict isn't CLEAN (a missing one isn't) is refused unless allowed."""
    manifest = scans.kb_manifest(spark, path)
    if manifest.get("verdict") != "CLEAN" and not allow_unclean:
        raise Refused(f"{path}: verdict {manifest.get('verdict')}")
    return scans.kb_values(spark, path), manifest


def routed(key_modality: Column, query_modality: Column, embedder: Column, routes: dict[str, str] | None = None) -> Column:
    """same, cross, or the reason why a query may not ask a source: equal modalities always may, others if the embedder's
    route is supported."""
    table = F.create_map(*[F.lit(x) for kv in (routes or ROUTES).items() for x in kv])
    status = F.coalesce(F.try_element_at(table, embedder), F.lit("unknown"))
    return F.when(key_modality == query_modality, "same").when(status == "supported", "cross").otherwise(F.concat(F.lit("refused: "), status))


def require_routed(df: DataFrame, route: str) -> DataFrame:
    """df, whose evaluation raises at the first row with a refused route."""
    return df.withColumn(route, F.when(F.col(route).startswith("refused"), F.raise_error(F.col(route)).cast("string")).otherwise(F.col(route)))


def check_config(config: dict, allowed: dict[str, tuple], forbidden: tuple[str, ...] = ()) -> None:
    """Raises with every setting that is unknown, forbidden, or has a value that isn't allowed (an empty tuple allows all)."""
    bad = [f"{k} is forbidden" for k in config if k in forbidden]
    bad += [f"{k} is unknown" for k in config if k not in allowed and k not in forbidden]
    bad += [f"{k}={json.dumps(v)} isn't one of {list(allowed[k])}" for k, v in config.items() if allowed.get(k) and v not in allowed[k]]
    if bad:
        raise ValueError("; ".join(sorted(bad)))
