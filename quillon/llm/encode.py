"""Problem 8: token ids of every document by a public byte-level vocabulary."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import encoder, vocabulary

#: Rows encoded into one Arrow batch; keeps the ids of long texts from piling up in a worker.
SLICE_ROWS = 1000


def encode_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", path: str | None = None
) -> DataFrame:
    """(id, ids): one row per input row, repeated rows included; null and empty texts give an empty list.

    No shuffle: a map over the scan, which reads the two columns only. Special-token strings are ordinary text.
    """
    file, pattern = vocabulary(tokenizer, path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                flat, ends = array("i"), np.zeros(part.num_rows + 1, dtype=np.int32)
                for i, text in enumerate(part.column(1).to_pylist()):
                    flat.extend(enc.encode(text))
                    ends[i + 1] = len(flat)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """(id, text): the texts of id lists, by the offset table; an empty list gives '' and null ids give null."""
    file, pattern = vocabulary(tokenizer, path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(file, pattern)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def count_tokens(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", tokenizer: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """df with the token count of a text column; 0 for null and empty texts."""
    file, pattern = vocabulary(tokenizer, path)

    @F.pandas_udf("int")
    def n(texts):
        import pandas as pd

        enc = encoder(file, pattern)
        return pd.Series([enc.count(t) for t in texts], dtype="int32")

    return df.withColumn(out_col, n(F.col(text_col)))
