"""Sinks: versioned, append-only and create-once outputs, with manifests beside the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.sampling import set_hash
from quillon.plans.runtime import bounded_rows


class Exists(RuntimeError):
    """A target that must not be overwritten is there already."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file, written beside its place and renamed into it, so that no reader sees half of it."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and not overwrite:
        raise Exists(path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"can't rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_cells(df: DataFrame, path: str) -> None:
    """Result cells partitioned by data set, backbone and split; only the partitions written are replaced."""
    df.write.partitionBy("dataset", "backbone", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_version(df: DataFrame, path: str, manifest: dict, supersede: str | None = None) -> None:
    """A knowledge source: table and manifest. An existing one is refused, or moved to archive/ under the name given."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p):
        if not supersede:
            raise Exists(path)
        old = f"{path.rstrip('/').rpartition('/')[0]}/archive/{path.rstrip('/').rpartition('/')[2]}__superseded_{supersede}"
        _, target = _fs(spark, old)
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"can't move {path}")
        manifest = manifest | {"supersedes": old}
    df.write.mode("errorifexists").parquet(f"{path}/values")
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True, ensure_ascii=False))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def create_once(spark: SparkSession, path: str, manifest: dict) -> None:
    """A manifest that is never replaced."""
    write_text(spark, path, json.dumps(manifest, sort_keys=True, ensure_ascii=False))


def freeze(df: DataFrame, id_col: str, path: str, extra: dict | None = None) -> None:
    """The ids of a sample as a table, with their hash in a manifest."""
    ids = df.select(F.col(id_col).cast("string").alias("id"))
    ids.write.mode("errorifexists").parquet(f"{path}/ids")
    h = bounded_rows(set_hash(ids, [], "id"), 1, "set hash")[0]
    create_once(df.sparkSession, f"{path}/manifest.json", {"n_ids": h["n_ids"], "ids_sha256": h["ids_sha256"]} | (extra or {}))


def replay(spark: SparkSession, df: DataFrame, id_col: str, path: str) -> bool:
    """Whether a sample has exactly the frozen ids, as often."""
    from quillon.operators.sets import replay_ok

    return replay_ok(spark.read.parquet(f"{path}/ids"), df.select(F.col(id_col).cast("string").alias("id")), "id")


def resume(todo: DataFrame, done_path: str, id_col: str) -> DataFrame:
    """What isn't in the append-only table of finished ids yet; everything where there is no table."""
    spark = todo.sparkSession
    return todo.join(spark.read.parquet(done_path).select(id_col).distinct(), id_col, "left_anti") if exists(spark, done_path) else todo


def counts_only(df: DataFrame, by: list[str], id_cols: list[str]) -> DataFrame:
    """(by..., n_...): sizes of id lists, without the ids."""
    return df.select(*by, *[F.size(c).alias(f"n_{c}") for c in id_cols])


def markdown(df: DataFrame, limit: int = 10_000) -> str:
    """A small result as a table; more rows than limit raise."""
    rows = bounded_rows(df, limit, "a report")
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *(line(r) for r in rows)])
