"""Scans: every source with a declared schema, read lazily and pruned by Spark."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.plans.runtime import broadcast_if_small

KB_VALUE = (
    "row int, kid string, source string, key_modality string, value_type string, value string, key_audio_ref string, "
    "provenance struct<dataset:string,revision:string,build_seed:int,from_item_id:string,leakage_checked:boolean>, key_granularity string, "
    "parent_ref string, start_s double, end_s double, grain string, key_text_ref string"
)
RESULT_CELL = (
    "stage string, dataset string, k_type string, backbone string, split string, slice_mode string, n_requested int, seed bigint, model string, "
    "per_item array<struct<item_id:string,instr:string,reply:string,score:double,detail:string,error:string,group_id:string>>, "
    "aggregate struct<mean:double,n_scored:int,n_total:int>, elapsed_s double, _corrupt_record string"
)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Shards under a path or glob; only the columns asked for are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_address(df: DataFrame) -> DataFrame:
    """df with _file and _row, the place of each row in its file."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def late_materialized(spark: SparkSession, path: str, id_col: str, light: list[str], heavy: list[str], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Choose ids on the light columns, then fetch the heavy ones for the chosen rows only."""
    chosen = choose(spark.read.parquet(path).select(id_col, *light)).select(id_col)
    return spark.read.parquet(path).select(id_col, *light, *heavy).join(broadcast_if_small(chosen), id_col, "left_semi")


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Files that each hold one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str | StructType, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"', **options).csv(path)


def tab_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines with exactly as many tab-divided fields as names; others are left out."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") == len(names))
    return parts.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def zip_members(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line_no, line) of the text members of zip files; an archive is read by one task."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if member.endswith(suffix):
                            with z.open(member) as f:
                                lines = []
                                for i, line in enumerate(io.TextIOWrapper(f, encoding="utf-8")):
                                    lines.append((i, line.rstrip("\n")))
                                    if len(lines) == 10_000:
                                        yield _lines(pa, name, member, lines)
                                        lines = []
                                if lines:
                                    yield _lines(pa, name, member, lines)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line_no bigint, line string")


def _lines(pa, name, member, lines):
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(lines)), pa.array([member] * len(lines)), pa.array([i for i, _ in lines], pa.int64()), pa.array([x for _, x in lines], pa.string())],
        names=["archive", "member", "line_no", "line"],
    )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, size, modified) of the files under a path; contents aren't read, and files without any are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def pointers(lines: DataFrame) -> DataFrame:
    """(path, text): a sidecar's first line, or where that names another sidecar, that one's; followed once."""
    by_name = lines.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("text").alias("target"))
    ref = F.when(F.col("text").endswith(".trn"), F.regexp_extract("text", r"([^/]+)$", 1))
    return lines.withColumn("name", ref).join(by_name, "name", "left").select("path", F.coalesce("target", "text").alias("text"))


def name_fields(stem: str, names: list[str], sep: str = "_") -> list:
    """Columns cut from a file stem; a stem with another number of parts gives nulls."""
    parts = F.split(stem, sep)
    return [F.when(F.size(parts) == len(names), parts[i]).alias(n) for i, n in enumerate(names)]


def mapped_code(code, table: dict[str, str], what: str):
    """A code's meaning; an unknown code raises."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), F.raise_error(F.concat(F.lit(f"unknown {what}: "), code)).cast("string"))


def same_schema_files(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """Union by name of the parquet files that have the required columns; others are skipped by their schema alone."""
    from quillon.operators.sets import union_all

    found = [df for df in (spark.read.parquet(p) for p in paths) if set(required) <= set(df.columns)]
    if not found:
        raise ValueError("no file has the required columns")
    return union_all(found)


def result_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, warnings): JSON result cells; unreadable or incomplete files become rows of warnings, nothing raises."""
    raw = spark.read.schema(RESULT_CELL).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").json(path).withColumn("file", F.col("_metadata.file_path"))
    bad = F.col("_corrupt_record").isNotNull() | F.col("dataset").isNull() | F.col("per_item").isNull()
    why = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise("incomplete")
    return raw.where(~bad).drop("_corrupt_record"), raw.where(bad).select("file", why.alias("reason"))


def exploded_items(cells: DataFrame) -> DataFrame:
    """A row per item of result cells; cells without items give none."""
    return cells.select("dataset", "backbone", "split", F.explode("per_item").alias("i")).select("dataset", "backbone", "split", "i.*")


def embeddings_npz(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, vector) of checkpoint archives with arrays doc_ids and vectors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0).to_pylist():
                z = np.load(io.BytesIO(content), allow_pickle=False)
                ids, v = z["doc_ids"], z["vectors"]
                if len(ids) != len(v):
                    raise ValueError("ids and vectors differ in number")
                for at in range(0, len(ids), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in ids[at : at + 10_000]]), pa.array(v[at : at + 10_000].astype("float32").tolist(), pa.list_(pa.float32()))], names=["doc_id", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id string, vector array<float>")


def resolve_pool(spark: SparkSession, spec: dict, loaders: dict[str, Callable] | None = None) -> DataFrame:
    """(id) of a pool given as explicit ids, as a file with an ids list, or as a whole data set of a registered loader."""
    kind = spec.get("kind")
    if kind == "ids":
        return spark.createDataFrame([(str(i),) for i in spec["ids"]], "id string")
    if kind == "file":
        return spark.read.schema("ids array<string>").option("multiLine", True).json(spec["path"]).select(F.explode("ids").alias("id"))
    if kind == "dataset":
        return (loaders or {})[spec["name"]](spark).select(F.col("item_id").cast("string").alias("id"))
    raise ValueError(f"unknown kind of pool: {kind}")


def group_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, group_id) from a JSON object or a list of pairs; an item in two groups raises."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one manifest file
    pairs = json.loads(text, object_pairs_hook=lambda kv: kv)
    rows = [(str(a), str(b)) for a, b in pairs]
    seen: dict[str, str] = {}
    for a, b in rows:
        if seen.setdefault(a, b) != b:
            raise ValueError(f"{a} is in the groups {seen[a]} and {b}")
    return spark.createDataFrame(sorted(seen.items()), "item_id string, group_id string")


def kb_values(spark: SparkSession, path: str) -> DataFrame:
    """The values of a persisted knowledge source."""
    return spark.read.parquet(f"{path}/values")


def kb_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a persisted knowledge source."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))  # one small file


def kb_sources(spark: SparkSession, root: str) -> DataFrame:
    """(source, verdict, forced): the knowledge sources under a folder, by their manifests; archived ones are left out."""
    f = spark.read.schema("verdict string, forced boolean").option("multiLine", True).json(f"{root}/*/manifest.json")
    return f.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest\.json$", 1).alias("source"), "verdict", "forced")


def sampled_lines(spark: SparkSession, path: str, n: int, seed: int) -> DataFrame:
    """(value): n lines of text files of any size, the same in every run; one pass with a top-n instead of a count and a scan."""
    lines = spark.read.text(path)
    return lines.withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}:"), "value"), 256)).orderBy("_k", "value").limit(n).select("value")


def with_media(rows: DataFrame, name: str, files: DataFrame) -> DataFrame:
    """The rows whose media file is in a listing (see listing), by the file's stem."""
    return rows.join(files.select(F.col("stem").alias(name)).distinct(), name, "left_semi")


def token_frequencies(texts: DataFrame, text: str) -> DataFrame:
    """(token, n) over all texts, counted map-side."""
    return texts.select(F.explode(F.split(F.col(text), " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


class Registry:
    """Named loaders; a loader that can't be set up is kept with its reason instead of failing the rest."""

    def __init__(self):
        self.loaders: dict[str, Callable] = {}
        self.failed: dict[str, str] = {}

    def add(self, name: str, make: Callable[[], Callable]) -> None:
        try:
            self.loaders[name] = make()
        except Exception as e:  # noqa: BLE001 - any failure is reported by name
            self.failed[name] = f"{type(e).__name__}: {e}"

    def smoke(self, spark: SparkSession) -> DataFrame:
        """(name, ok, detail): one row of every loader is read."""
        rows = [(n, False, why) for n, why in self.failed.items()]
        for n, f in self.loaders.items():
            try:
                rows.append((n, True, ",".join(f(spark).limit(1).columns)))
            except Exception as e:  # noqa: BLE001
                rows.append((n, False, f"{type(e).__name__}: {str(e)[:200]}"))
        return spark.createDataFrame(sorted(rows), "name string, ok boolean, detail string")


# Loaders of the data sets differ in where their fields lie; a declarative entry replaces a function each.
def loader(path: str, reader: str, schema: str | None, item_id: str, gold: str, split: str, keep: str = "true", meta: dict[str, str] | None = None, sort: str | None = None) -> Callable[[SparkSession], DataFrame]:
    """A loader: read, filter, and project to (dataset fields) item_id, gold (JSON), split, meta (map), in canonical order.

    item_id, gold, split, keep and the values of meta are SQL expressions over the source's columns.
    """

    def load(spark: SparkSession) -> DataFrame:
        read = {"parquet": lambda: spark.read.parquet(path), "jsonl": lambda: json_lines(spark, path, schema), "json": lambda: json_array(spark, path, schema), "csv": lambda: csv(spark, path, schema)}[reader]
        entries = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.expr(f"cast({v} as string)"))]
        out = read().where(keep).select(
            F.expr(f"cast({item_id} as string)").alias("item_id"), F.to_json(F.expr(f"named_struct('gold', {gold})")).alias("gold"), F.expr(f"cast({split} as string)").alias("split"),
            (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("meta"), *([F.expr(sort).alias("_o")] if sort else []),
        )
        return out.orderBy("_o", "item_id").drop("_o") if sort else out

    return load
