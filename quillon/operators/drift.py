"""Problem 7: records whose schema drifts between files, read into one table, with every change reported.

Rescue-column ingestion: a target schema is enforced, fields that are unknown or can't be cast are kept as JSON in a
rescue column, approved fields are promoted, and the rescued values are replayed into the typed columns. Changes and the
consistent table are both taken from the enforced records, so that every body is parsed once.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.plans.runtime import broadcast_if_small, cut

#: Target of the project's result records: path in the record, column, type.
TARGET = (
    ("item_id", "item_id", "string"), ("group_id", "group_id", "string"), ("instr", "instr", "string"), ("reply", "reply", "string"),
    ("score", "score", "double"), ("error", "error", "string"), ("logprob_mean", "logprob_mean", "double"), ("elapsed_s", "elapsed_s", "double"),
    ("cached", "cached", "boolean"), ("retries", "retries", "bigint"), ("detail.pred", "pred", "string"), ("detail.gold", "gold", "string"),
    ("detail.reused", "reused", "string"), ("detail.task", "task", "string"),
)
#: New fields approved for a column of their own.
PROMOTED = (
    ("detail.lang", "lang", "string"), ("detail.matched", "matched", "boolean"), ("detail.scorer", "scorer", "string"), ("detail.reward_fn", "reward_fn", "string"),
)
KEEP = ("raw_id", "stream_id", "file_no", "line_no")
_ARROW = {"string": "string", "double": "float64", "bigint": "int64", "boolean": "bool_"}


def _refuse(constant: str):
    raise ValueError(constant)


def parse_record(body: str | None) -> dict | None:
    """The object of a body; None where it is null, not valid JSON, or no object."""
    if body is None:
        return None
    try:
        record = json.loads(body, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def flatten(record: dict) -> dict:
    """Top-level keys other than detail, and the keys in detail as detail.key."""
    out = {k: v for k, v in record.items() if k != "detail"}
    detail = record.get("detail")
    if isinstance(detail, dict):
        out.update(("detail." + k, v) for k, v in detail.items())
    return out


def kind(value) -> str | None:
    """The JSON kind of a value; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "whole"
    if isinstance(value, float):
        return "fraction"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def item_number(value) -> str | None:
    """The trailing number of an item id, however it is written; None if there is none."""
    if value is None or isinstance(value, (bool, list, dict)):
        return None
    text = str(value)
    digits = text[len(text.rstrip("0123456789")) :]
    return (digits.lstrip("0") or "0") if digits else None


# -- casts -----------------------------------------------------------------------------------------------------------

NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")  # the grammar of JSON


def _storable(text: str) -> bool:
    """Whether a text can be stored as UTF-8; JSON can escape halves of surrogate pairs."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def to_text(value) -> str:
    """A value as JSON; characters are written as they are where they can be stored."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    return text if _storable(text) else json.dumps(value, sort_keys=True)


def strict_cast(value, to: str) -> tuple[bool, object]:
    """(ok, value) of the first pass: a value is taken only if it is of the column's own kind and fits it unchanged."""
    if value is None:
        return True, None
    own = kind(value)
    if to == "string":
        ok = own == "string" and _storable(value)
    elif to == "double":
        ok = own == "fraction" and abs(value) != float("inf") or own == "whole" and abs(value) <= 1 << 53
    elif to == "bigint":
        ok = own == "whole" and -(1 << 63) <= value < 1 << 63
    else:
        ok = own == "boolean"
    return (True, float(value) if to == "double" else value) if ok else (False, None)


def replay_cast(value, to: str) -> tuple[bool, object]:
    """(ok, value) of the second pass: as strict_cast, and the only element of a list, numbers and booleans as text,
    objects as JSON text, text that is a number or boolean as JSON writes them, and 0 and 1 for booleans and back."""
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    ok, cast = strict_cast(value, to)
    if ok:
        return ok, cast
    own = kind(value)
    if to == "string":
        return (True, to_text(value)) if own in ("whole", "fraction", "boolean", "object") and abs(value if own == "fraction" else 0) != float("inf") else (False, None)
    if to == "boolean":
        if own == "string" and value.lower() in ("true", "false"):
            return True, value.lower() == "true"
        return (True, bool(value)) if own in ("whole", "fraction") and value in (0, 1) else (False, None)
    if own == "boolean":
        return strict_cast(int(value), to)
    if own == "string":
        if not NUMBER.fullmatch(value):
            return False, None
        value = float(value) if to == "double" or not value.lstrip("-").isdigit() else int(value)
    if isinstance(value, float) and to == "bigint" and value == value and abs(value) < 1 << 53 and value == int(value):
        value = int(value)
    return strict_cast(value, to) if isinstance(value, (int, float)) else (False, None)


# -- first pass ------------------------------------------------------------------------------------------------------


def enforce(raw: DataFrame, target=TARGET, keep: tuple[str, ...] = KEEP, body: str = "body") -> DataFrame:
    """(keep..., valid, item_no, typed columns..., rescued, shape, corrupt): the target schema enforced, a row per raw row.

    Fields that are unknown, or not of their column's kind, go to rescued, a JSON object by path; nothing is lost. shape
    is a JSON list of [field, kind], sorted, with the kind '' for null. item_no is the trailing number of the item id,
    the same however the id is written. Bodies that are no JSON object have valid = false, no shape, and their text in
    corrupt; a null body has null in both.
    """
    types = {path: t for path, _, t in target}
    head = ", ".join(f"`{c}` {raw.schema[c].dataType.simpleString()}" for c in keep)
    schema = ", ".join(x for x in (head, "valid boolean, item_no string", *(f"`{n}` {t}" for _, n, t in target), "rescued string, shape string, corrupt string") if x)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            valid, numbers, rescued, shapes, corrupt = [], [], [], [], []
            cols: dict[str, list] = {path: [] for path in types}
            for text in b.column(len(keep)).to_pylist():
                record = parse_record(text)
                valid.append(record is not None)
                corrupt.append(text if record is None else None)
                numbers.append(item_number(record.get("item_id")) if record is not None else None)
                row, left, shape = {}, {}, []
                for path, v in flatten(record).items() if record is not None else ():
                    ok, cast = strict_cast(v, types[path]) if path in types else (False, None)
                    if ok:
                        row[path] = cast
                    else:
                        left[path] = v
                    shape.append((path, kind(v) or ""))
                if record is not None and "detail" in record and not isinstance(record["detail"], dict):
                    left["detail"] = record["detail"]  # no field by the definition, but a value to keep
                for path, values in cols.items():
                    values.append(row.get(path))
                rescued.append(to_text(left) if left else None)
                shapes.append(None if record is None else to_text(sorted(shape)))
            arrays = [*(b.column(i) for i in range(len(keep))), pa.array(valid, pa.bool_()), pa.array(numbers, pa.string())]
            arrays += [pa.array(cols[path], getattr(pa, _ARROW[t])()) for path, _, t in target]
            arrays += [pa.array(x, pa.string()) for x in (rescued, shapes, corrupt)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "valid", "item_no", *(n for _, n, _ in target), "rescued", "shape", "corrupt"])

    return raw.select(*keep, body).mapInArrow(run, schema)


# -- changes ---------------------------------------------------------------------------------------------------------


def _placed(df: DataFrame) -> DataFrame:
    return df.where("stream_id is not null and file_no is not null").withColumns({c: F.col(c).cast("bigint") for c in ("stream_id", "file_no")})


def field_kinds(enforced: DataFrame) -> DataFrame:
    """(stream_id, file_no, field, kinds): the fields of each file with the sorted kinds of their non-null values ('' if none).

    The few shapes of a file are told apart first, so that a hot stream is not exploded record by record.
    """
    shapes = _placed(enforced).where("shape is not null").select("stream_id", "file_no", "shape").distinct()
    pairs = shapes.select("stream_id", "file_no", F.explode(F.from_json("shape", "array<array<string>>")).alias("p")).select("stream_id", "file_no", F.col("p")[0].alias("field"), F.col("p")[1].alias("kind"))
    return pairs.groupBy("stream_id", "file_no", "field").agg(F.array_join(F.sort_array(F.collect_set(F.nullif("kind", F.lit("")))), "|").alias("kinds"))


def _same_form(value: Column, kind_: Column) -> Column:
    """A value's text on which equal JSON values of one kind agree, whether it was typed or rescued."""
    return F.concat(kind_, F.lit(":"), F.when(kind_ == "fraction", value.cast("double").cast("string")).otherwise(value))


def _values(enforced: DataFrame, needed: DataFrame, target) -> DataFrame:
    """(stream_id, file_no, item, field, value) of the fields needed (stream_id, file_no, fields), non-null values only."""
    rows = _placed(enforced).where("valid and item_no is not null").join(needed, ["stream_id", "file_no"])
    text = lambda n, t: F.col(n).cast("decimal(20,0)").cast("string") if t == "double" else F.col(n).cast("string")
    kinds = F.map_from_entries(F.transform(F.from_json("shape", "array<array<string>>"), lambda p: F.struct(p[0], p[1])))
    rows = rows.withColumn("kinds", kinds).withColumn("others", F.from_json("rescued", "map<string,string>"))
    # a double that was written as a whole number is compared as one
    typed = [F.when(F.col("f") == path, F.when(F.col("k") == "whole", text(n, t)).otherwise(F.col(n).cast("string"))) for path, n, t in target]
    one = rows.select("*", F.explode("fields").alias("f")).withColumn("k", F.try_element_at("kinds", "f")).where("k <> ''")
    value = _same_form(F.coalesce(F.try_element_at("others", "f"), *typed), F.col("k"))
    return one.select("stream_id", "file_no", F.col("item_no").alias("item"), F.col("f").alias("field"), value.alias("value")).distinct()


def schema_changes(raw: DataFrame, target=TARGET) -> DataFrame:
    """(stream_id, file_no, change, old_field, new_field): every change from the file before, as defined for the records.

    The records are enforced once (see enforce). Files are ordered by file_no, whenever they arrive. Lines delivered
    twice count once; rows without stream_id or file_no, null bodies and bodies that are no JSON object hold no field,
    but their file counts as a file. Values are gathered for the files at a change only, and are joined per item, so
    that no stream is pulled into one task; a stream's files pass through sorted windows, a row per file and field.
    """
    return _History(cut(enforce(raw, target, ("stream_id", "file_no"))), target).changes()


class _History:
    """The fields of every file of enforced records, and what became of them."""

    def __init__(self, enforced: DataFrame, target=TARGET):
        order = Window.partitionBy("stream_id").orderBy("file_no")
        files = _placed(enforced).select("stream_id", "file_no").distinct().withColumn("prev", F.lag("file_no").over(order)).withColumn("idx", F.row_number().over(order))
        files = cut(files)
        self.kinds = cut(field_kinds(enforced).join(files, ["stream_id", "file_no"]).select("stream_id", "file_no", "prev", "idx", "field", F.expr("nullif(kinds, '')").alias("kind")))
        by_field = Window.partitionBy("stream_id", "field").orderBy("idx")
        rows = self.kinds.withColumn("before", F.lag("idx").over(by_field)).withColumn("after", F.lead("idx").over(by_field))
        new = rows.where("prev is not null and (before is null or before <> idx - 1)").select("stream_id", "file_no", "prev", F.col("field").alias("new_field"))
        nxt = files.select("stream_id", F.col("prev").alias("at"), F.col("file_no").alias("next"))
        gone = (
            rows.where("after is null or after <> idx + 1").select("stream_id", F.col("file_no").alias("at"), F.col("field").alias("old_field"))
            .join(nxt, ["stream_id", "at"]).select("stream_id", F.col("next").alias("file_no"), F.col("at").alias("prev"), "old_field")
        )
        self.new, self.gone = cut(new), cut(gone)
        pairs = self.gone.join(self.new.drop("prev"), ["stream_id", "file_no"])  # a file's fields, not its records
        old_side = pairs.select("stream_id", F.col("prev").alias("file_no"), F.col("old_field").alias("field"))
        new_side = pairs.select("stream_id", "file_no", F.col("new_field").alias("field"))
        needed = old_side.union(new_side).groupBy("stream_id", "file_no").agg(F.collect_set("field").alias("fields"))
        values = cut(_values(enforced, needed, target))
        o = values.select("stream_id", F.col("file_no").alias("prev"), "item", F.col("field").alias("old_field"), F.col("value").alias("was"))
        n = values.select("stream_id", "file_no", "item", F.col("field").alias("new_field"), F.col("value").alias("is"))
        agree = (
            pairs.join(o, ["stream_id", "prev", "old_field"]).join(n, ["stream_id", "file_no", "new_field", "item"])
            .groupBy("stream_id", "file_no", "old_field", "new_field").agg(F.min((F.col("was") == F.col("is")).cast("int")).alias("all"), F.count("*").alias("n")).where("all = 1")
        )
        # a field is renamed once: of several that agree, the one with most values, then by name
        best = lambda side: F.row_number().over(Window.partitionBy("stream_id", "file_no", side).orderBy(F.desc("n"), "old_field", "new_field"))
        self.renamed = cut(agree.withColumn("i", best("old_field")).where("i = 1").withColumn("j", best("new_field")).where("j = 1").select("stream_id", "file_no", "old_field", "new_field"))
        self._stretches()

    def _stretches(self) -> None:
        """rows: each field of a file with the stretch of files without a gap it lies in; segs: the stretches, linked to
        the stretch they go on from, by a rename or as the same field after a gap."""
        kinds, renamed = self.kinds, self.renamed
        by_field = Window.partitionBy("stream_id", "field").orderBy("idx")
        rows = kinds.withColumn("start", (F.coalesce(F.lag("idx").over(by_field), F.lit(-1)) != F.col("idx") - 1).cast("int"))
        rows = rows.withColumn("seg", F.sum("start").over(by_field))
        in_seg = Window.partitionBy("stream_id", "field", "seg").orderBy("idx")
        self.rows = rows = cut(rows.withColumn("last", F.last("kind", True).over(in_seg.rowsBetween(Window.unboundedPreceding, -1))))
        ends = rows.groupBy("stream_id", "field", "seg").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("idx"))).alias("seg_kind"), F.min("file_no").alias("from_file"), F.max("idx").alias("end_idx"), F.min("idx").alias("begin_idx"))
        # a stretch continues the renamed field's, or its own name's earlier one unless that was renamed away
        r = renamed.select("stream_id", F.col("file_no").alias("from_file"), F.col("new_field").alias("field"), "old_field")
        idx_of = kinds.select("stream_id", F.col("file_no").alias("from_file"), F.col("idx").alias("at_idx")).distinct()
        away = renamed.join(idx_of.withColumnRenamed("from_file", "file_no"), ["stream_id", "file_no"]).select("stream_id", F.col("old_field").alias("field"), (F.col("at_idx") - 1).alias("end_idx"), F.lit(True).alias("away"))
        segs = ends.join(r, ["stream_id", "from_file", "field"], "left").join(away, ["stream_id", "field", "end_idx"], "left")
        segs = cut(segs.withColumn("own_away", F.lag("away").over(Window.partitionBy("stream_id", "field").orderBy("seg"))))
        tail = segs.select("stream_id", F.col("field").alias("old_field"), (F.col("end_idx") + 1).alias("begin_idx"), F.col("seg").alias("old_seg"))
        alone = (F.col("seg") > 1) & F.col("own_away").isNull()
        self.segs = cut(segs.join(tail, ["stream_id", "old_field", "begin_idx"], "left").select(
            "stream_id", "field", "seg", "seg_kind", F.col("old_seg").isNotNull().alias("by_rename"),
            F.when(F.col("old_seg").isNotNull(), F.col("old_field")).when(alone, F.col("field")).alias("link_field"),
            F.when(F.col("old_seg").isNotNull(), F.col("old_seg")).when(alone, F.col("seg") - 1).alias("link_seg"),
        ))

    def changes(self) -> DataFrame:
        renamed = self.renamed
        removed = self.gone.join(renamed, ["stream_id", "file_no", "old_field"], "left_anti").select("stream_id", "file_no", F.lit("removed"), "old_field", F.lit(""))
        added = self.new.join(renamed, ["stream_id", "file_no", "new_field"], "left_anti").select("stream_id", "file_no", F.lit("added"), F.lit(""), "new_field")
        return (
            renamed.select("stream_id", "file_no", F.lit("renamed").alias("change"), "old_field", "new_field").union(removed).union(added)
            .union(self._type_changes().select("stream_id", "file_no", F.lit("type_changed"), "field", "field"))
        )

    def _type_changes(self) -> DataFrame:
        """(stream_id, file_no, field) where a field that was in the file before has another kind than last seen on its line."""
        link = self.segs
        target = link.select("stream_id", F.col("field").alias("link_field"), F.col("seg").alias("link_seg"), F.col("seg_kind").alias("found"), F.col("link_field").alias("on_field"), F.col("link_seg").alias("on_seg"))
        done = self.rows.where("kind is not null and start = 0 and last is not null and last <> kind").select("stream_id", "file_no", "field")
        todo = self.rows.where("kind is not null and start = 0 and last is null").join(link, ["stream_id", "field", "seg"]).where("link_field is not null").select("stream_id", "file_no", "field", "kind", "link_field", "link_seg")
        todo = cut(todo)
        while not todo.isEmpty():  # a step per renamed or absent stretch that held nulls only
            step = cut(todo.join(target, ["stream_id", "link_field", "link_seg"]))
            done = done.union(step.where("found is not null and found <> kind").select("stream_id", "file_no", "field"))
            todo = cut(step.where("found is null and on_field is not null").select("stream_id", "file_no", "field", "kind", F.col("on_field").alias("link_field"), F.col("on_seg").alias("link_seg")))
        return done

    def meanings(self, target) -> DataFrame:
        """(stream_id, file_no, field, path): the target path that a file's unknown field stands for.

        Renames tie the stretches of a stream into lines; a line that bears the name of one target field anywhere gives
        that path to its other names, in its own files only. A line with two target fields is ambiguous: its other names
        stay rescued. A name without a line in its stream takes the path it has in all other streams, if they agree.
        """
        paths = [t[0] for t in target]
        node = lambda field, seg: F.struct(F.col("stream_id"), F.col(field).alias("field"), F.col(seg).alias("seg"))
        tied = self.segs.where("by_rename").select(node("field", "seg").alias("n"), node("link_field", "link_seg").alias("p"))
        heads = tied.select(F.col("p").alias("n")).join(tied.select("n"), "n", "left_anti").distinct().withColumn("p", F.col("n"))
        line = cut(tied.union(heads))
        while True:  # pointer doubling: log2 of the longest line's renames
            up = line.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            further = cut(line.join(up, "p").select("n", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            line = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        known = F.when(F.col("n.field").isin(paths), F.col("n.field"))
        ends = line.groupBy("p").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
        own = cut(line.join(ends, "p").where(~F.col("n.field").isin(paths)).select("n.stream_id", "n.field", "n.seg", "lo", "hi"))
        elsewhere = own.groupBy("field").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select("field", F.col("lo").alias("other"))
        unknown = self.rows.where(~F.col("field").isin(paths)).select("stream_id", "file_no", "field", "seg")
        j = unknown.join(broadcast_if_small(own.withColumn("mine", F.lit(True))), ["stream_id", "field", "seg"], "left").join(broadcast_if_small(elsewhere), "field", "left")
        mine = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
        path = F.when(F.col("mine") & F.col("lo").isNotNull(), mine).otherwise(F.col("other"))
        return j.select("stream_id", "file_no", "field", path.alias("path")).where("path is not null")


# -- second pass -----------------------------------------------------------------------------------------------------


def replay(enforced: DataFrame, meanings: DataFrame | None = None, target=TARGET, promoted=(), approved: dict[str, str] | None = None, keep: tuple[str, ...] = KEEP) -> DataFrame:
    """(keep..., valid, item_no, typed columns..., promoted columns..., rescued, corrupt): rescued values put into columns.

    A rescued value goes to its own path's column, to a promoted field's column, or to the column its name stands for in
    that file (meanings: stream_id, file_no, field, path) or everywhere (approved: {field: path}), if that is still null
    and the value can be cast (see replay_cast). Its own path comes first, then the other names in order. What is placed
    leaves rescued; everything else stays there, so that no value is lost. Rows without rescued values don't pass Python.
    """
    every = (*target, *promoted)
    types = {path: t for path, _, t in every}
    approved = approved or {}
    filled = enforced.select("*", *(F.lit(None).cast(t).alias(n) for _, n, t in promoted))
    names = [n for _, n, _ in every]
    shown = [*keep, "valid", "item_no", *names, "rescued", "corrupt"]
    some = filled.where("rescued is not null")
    if meanings is not None:
        m = meanings.groupBy(F.col("stream_id").alias("_s"), F.col("file_no").alias("_f")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "path")))).alias("_names"))  # a file's fields
        some = some.join(broadcast_if_small(m), (F.col("stream_id").cast("bigint") == F.col("_s")) & (F.col("file_no").cast("bigint") == F.col("_f")), "left")
    else:
        some = some.withColumn("_names", F.lit(None).cast("string"))

    @F.pandas_udf(", ".join([*(f"`{n}` {t}" for _, n, t in every), "rescued string"]))
    def place(rescued, names_, open_):
        import pandas as pd

        out: dict[str, list] = {path: [] for path in types}
        rest = []
        for text, own, free in zip(rescued, names_, open_):
            fields, own, free = json.loads(text), json.loads(own) if own else {}, set(free)
            got: dict = {}
            for path in sorted(fields, key=lambda p: (p not in types, p)):
                to = path if path in types else own.get(path) or approved.get(path)
                if to in free and to not in got:
                    ok, v = replay_cast(fields[path], types[to])
                    if ok:
                        got[to] = v
                        del fields[path]
            for path, values in out.items():
                values.append(got.get(path))
            rest.append(to_text(fields) if fields else None)
        cols = {n: pd.Series(out[path], dtype=object) for path, n, _ in every}
        return pd.DataFrame(cols | {"rescued": pd.Series(rest, dtype=object)})

    free = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(path)) for path, n, _ in every)), lambda x: x.isNotNull())
    placed = some.withColumn("_r", place("rescued", "_names", free)).select(
        *keep, "valid", "item_no", *(F.coalesce(F.col(n), F.col(f"_r.{n}")).alias(n) for n in names), F.col("_r.rescued").alias("rescued"), "corrupt"
    )
    return filled.where("rescued is null").select(*shown).union(placed)


def ingest(raw: DataFrame, target=TARGET, promoted=PROMOTED, approved: dict[str, str] | None = None, keep: tuple[str, ...] = KEEP) -> DataFrame:
    """One consistent table of all records, repeated lines included: enforced, then replayed by what the renames found in
    the data say of each stream and file, and by the approved names. keep must hold stream_id and file_no."""
    enforced = cut(enforce(raw, target, keep))
    return replay(enforced, _History(enforced, target).meanings((*target, *promoted)), target, promoted, approved, keep)
