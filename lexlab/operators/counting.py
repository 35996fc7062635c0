"""Counts of the tokens of whole texts, row by row, in Arrow batches.

A row's tokens are counted where the row is: a task holds a slice of a batch at a time
and never a hash table of all its (row, token) pairs, so its memory does not follow
the size of its partition.  Texts are split into tokens by a column expression; rows
whose other columns are all equal are one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from lexlab.functions.text import word_tokens

SLICE_BYTES = 8 << 20
FEATS = ty.ArrayType(ty.StructType([ty.StructField("i", ty.IntegerType()), ty.StructField("x", ty.DoubleType())]))


def slices(frames: Iterator[pa.RecordBatch], n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``n_bytes``, one row at least."""
    for batch in frames:
        if batch.num_rows:
            rows = max(1, int(batch.num_rows * n_bytes / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)


def with_tokens(df: DataFrame, text_col: str, tokens: Callable[[str | Column], Column]) -> DataFrame:
    """``df`` without its text, one row per value of the other columns, with ``_tokens``:
    those of all its texts.  One shuffle, of the texts."""
    keep = [c for c in df.columns if c != text_col]
    texts = df.groupBy(*keep).agg(F.collect_list(text_col).alias("_texts"))
    return texts.select(*keep, F.flatten(F.transform("_texts", lambda t: tokens(t))).alias("_tokens"))


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every element of a list column, and the elements."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _coded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every token that is not NULL, and the tokens by code."""
    rows, values = lists_of(column)
    coded = values.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = codes >= 0
    return rows[there], codes[there], coded.dictionary


@lru_cache(maxsize=1 << 18)
def _number(token: bytes) -> int:
    """The first 8 hex digits of a token's md5, as in :func:`text.token_index`."""
    return int.from_bytes(hashlib.md5(token).digest()[:4], "big")


def _hashed_batches(num_features: int, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(frames):
        rows, codes, words = _coded(batch.column(batch.num_columns - 1))
        index = np.array([_number(w) % num_features for w in words.cast(pa.binary()).to_pylist()], np.int64)
        cell, n = np.unique(rows * num_features + index[codes], return_counts=True)
        row = cell // num_features
        root = np.sqrt(np.maximum(np.bincount(rows, minlength=batch.num_rows), 1).astype(np.float64))
        pairs = pa.StructArray.from_arrays([pa.array((cell % num_features).astype(np.int32)), pa.array(n / root[row])], ["i", "x"])
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        feats = pa.ListArray.from_arrays(pa.array(ends), pairs)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], feats], [*batch.schema.names[:-1], "feats"])


def hashed_counts(df: DataFrame, num_features: int, text_col: str, tokens: Callable[[str | Column], Column]) -> DataFrame:
    """``df`` without its text, with ``feats``: ``(i, x)`` in the order of ``i``, ``x`` the count of the tokens
    hashed to ``i`` over the root of the text's token count."""
    rows = with_tokens(df, text_col, tokens)
    schema = ty.StructType([*rows.schema.fields[:-1], ty.StructField("feats", FEATS)])
    return rows.mapInArrow(partial(_hashed_batches, num_features), schema)


def _term_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(frames):
        rows, codes, words = _coded(batch.column(batch.num_columns - 1))
        cell, n = np.unique(rows * max(1, len(words)) + codes, return_counts=True)
        row, code = np.divmod(cell, max(1, len(words)))
        kept = [c.take(pa.array(row)) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, words.take(pa.array(code)), pa.array(n.astype(np.int64))],
                                         [*batch.schema.names[:-1], "term", "n"])


def word_counts(df: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """``keep..., term, n`` of the words of whole texts."""
    rows = with_tokens(df.select(*keep, text_col), text_col, word_tokens)
    schema = ty.StructType([*rows.schema.fields[:-1], ty.StructField("term", ty.StringType()), ty.StructField("n", ty.LongType())])
    return rows.mapInArrow(_term_batches, schema)
