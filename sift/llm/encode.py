"""Encoding of a whole corpus, and token counts, with a public byte-level BPE vocabulary."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.llm.bpe import EncodedText, load, tokenizer_path
from sift.session import spread


def _texts(column: pa.Array) -> Iterator[str]:
    for raw in column:
        value = raw.as_buffer()
        yield "" if value is None else bytes(value).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids): one row per input row with the token ids of its text.

    Null and empty texts give an empty list; bytes that aren't UTF-8 are read as U+FFFD; blank texts are encoded like
    any other; spellings of special tokens are ordinary text.  Repeated ids are kept as repeated rows.  Other columns
    of df are ignored.  One map stage, no shuffle (small inputs in few files are first spread over the cores)."""
    file = tokenizer_path(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in batches:
            raws = [bpe.encode_raw(t) if t else b"" for t in _texts(batch.column(1))]
            ends = np.zeros(len(raws) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in raws], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])
            bpe.trim()

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = spread(df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw")))
    return rows.mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns in keep plus n_tokens (BIGINT, 0 for null and empty texts), one row per input row."""
    file = tokenizer_path(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in batches:
            n = [len(bpe.encode_raw(t)) // 4 if t else 0 for t in _texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])
            bpe.trim()

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])
    rows = spread(df.select(*keep, F.col(text_col).cast("binary").alias("_raw")))
    return rows.mapInArrow(run, schema)


def prefix_tables(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, text, pieces, last): the texts with what edited() needs to go on from them.

    pieces: characters of each of the pattern's pieces; last: the unique valid last token of each byte prefix within its
    piece, four bytes a byte of text. Null texts are stored as empty ones; one row per input row, no shuffle."""
    return _edited(
        df.select(id_col, F.lit("").alias("text"), F.array().cast("array<int>").alias("pieces"), F.array().cast("array<int>").alias("last"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col(text_col).alias("new")),
        id_col, path,
    ).drop("ids")


def edited(stored: DataFrame, id_col: str = "doc_id", start_col: str = "start", end_col: str = "end", new_col: str = "new", path: str | None = None) -> DataFrame:
    """(id_col, text, pieces, last, ids): stored texts with [start, end) replaced by new, and their encoding.

    stored: prefix_tables' columns and the edit of each row, counted in characters; a NULL start appends, a NULL end is
    the start, places beyond the text are its end, a NULL new is empty. Only pieces near the edit are solved again, and
    of those that grow only the added prefixes; the result can be stored and edited again."""
    return _edited(stored.select(id_col, "text", "pieces", "last", F.col(start_col).alias("start"), F.col(end_col).alias("end"), F.col(new_col).alias("new")), id_col, path)


def _edited(rows: DataFrame, id_col: str, path: str | None) -> DataFrame:
    file = tokenizer_path(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in batches:
            texts, pieces, tables, ids = [], [], [], []
            starts, ends = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for text, cut, last, start, end, new in zip(_texts(batch.column(1)), batch.column(2), batch.column(3), starts, ends, _texts(batch.column(6))):
                doc = EncodedText.restored(bpe, text, cut.values.to_pylist(), array("i", last.values.to_numpy().tobytes()))
                start = len(text) if start is None else min(max(start, 0), len(text))
                doc.replace(start, max(start, start if end is None else min(end, len(text))), new)
                lengths, table = doc.stored()
                texts.append(doc.text)
                pieces.append(lengths)
                tables.append(table.tolist())
                ids.append(doc.ids())
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (pieces, tables, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *lists], names=[id_col, "text", "pieces", "last", "ids"])
            bpe.trim()

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema[id_col], T.StructField("text", T.StringType()), *(T.StructField(c, numbers) for c in ("pieces", "last", "ids"))])
    binary = rows.withColumns({c: F.col(c).cast("binary") for c in ("text", "new")}).withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("pieces", "last")})
    return spread(binary).mapInArrow(run, schema)
