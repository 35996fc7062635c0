"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text into pieces wherever it
hits the block size; each piece gives one of 64 characters, so an edit changes
the characters of the pieces it touches and no others.  A fingerprint
``b:s1:s2`` holds the block size ``b`` (3 times a power of two, chosen so that
the signature has about 32 to 64 characters), the signature at ``b`` and the
one at ``2 b``.  As in the published scheme a signature has 64 characters at
most and its last one covers all the rest of the text, so every byte counts.

Two fingerprints are compared at a block size that both have, by the edit
distance of their signatures over the longer one's length; signatures without a
common run of four characters are unlike.  The comparison is a column
expression.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import U, batches, splitmix
from lexlab.session import stage_table

SIGNATURE = 64
SMALLEST = 3
WINDOW = 7
GRAM = 4
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = splitmix(np.arange(256, dtype=U) + U(1000)).astype(np.uint32)
_PIECE = splitmix(np.arange(256, dtype=U) + U(2000)) | U(1)
_ROLL_STEP, _PIECE_STEP = 0x01000193, U(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the piece hash's step, kept between calls."""
    global _POWERS
    if n > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(2 * n, _PIECE_STEP, U))])
    return _POWERS[:n]


def _signature(data: np.ndarray, cuts: np.ndarray) -> str:
    """One character per piece; ``cuts`` are the ends of the pieces."""
    starts = np.concatenate([np.zeros(1, np.int64), cuts[:SIGNATURE - 1]])
    starts = starts[starts < len(data)]
    lengths = np.diff(np.append(starts, len(data)))
    with np.errstate(over="ignore"):
        depth = np.arange(len(data)) - np.repeat(starts, lengths)
        sums = np.add.reduceat(_PIECE[data] * _powers(int(lengths.max()))[depth], starts)
        return _CHARS[(splitmix(sums ^ lengths.astype(U)) & U(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """Fingerprint of one text; an empty one gives ``3::``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if n == 0:
        return f"{SMALLEST}::"
    rolled = _ROLL[data]
    roll, step = rolled.copy(), 1
    for k in range(1, min(WINDOW, n)):
        step = step * _ROLL_STEP % (1 << 32)
        roll[k:] += rolled[:-k] * np.uint32(step)
    roll ^= roll >> np.uint32(15)
    block = SMALLEST
    while block * SIGNATURE < n:
        block *= 2
    while True:
        at = np.flatnonzero(roll % np.uint32(block) == np.uint32(block - 1))
        if block == SMALLEST or len(at) >= SIGNATURE // 2:
            break
        block //= 2
    double = at[roll[at] % np.uint32(2 * block) == np.uint32(2 * block - 1)]
    return f"{block}:{_signature(data, at + 1)}:{_signature(data, double + 1)}"


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the next document."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def _alike(a: Column, b: Column) -> Column:
    """Likeness of two signatures."""
    a, b = (F.regexp_replace(x, r"(.)\1{3,}", "$1$1$1") for x in (a, b))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (GRAM - 1), F.lit(1))),
                         lambda i, x=x: F.substring(x, i, F.lit(GRAM))) for x in (a, b)]
    longest = F.greatest(F.length(a), F.length(b))
    return (F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
            .when(~F.arrays_overlap(*grams), F.lit(0.0))
            .otherwise(1.0 - F.levenshtein(a, b) / longest))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 at incompatible block sizes."""
    a, b = F.split(one, ":"), F.split(other, ":")
    size_a, size_b = a[0].cast("long"), b[0].cast("long")
    return (F.when(one == other, F.lit(1.0))
            .when(size_a == size_b, F.greatest(_alike(a[1], b[1]), _alike(a[2], b[2])))
            .when(size_a == 2 * size_b, _alike(a[1], b[2]))
            .when(2 * size_a == size_b, _alike(a[2], b[1]))
            .otherwise(F.lit(0.0)))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` per row; null texts count as empty."""
    src = docs.select(key, text)
    schema = T.StructType([src.schema[key], T.StructField("fingerprint", T.StringType())])

    def run(frames):
        for batch in batches(frames):
            prints = [fingerprint(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


_RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")


def _compared(text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own,
            own if changed == text else fingerprint(changed), next_own)


def against_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the
    next document: ``key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, next_fingerprint, near_edited, near_next``.

    The next document is the one after it by descending ``key`` (null keys come
    last; ties go by a hash of the text), and the first one after the last.
    The table is sorted by range once, so neighbours meet in a task's stream;
    the first and last row of each range, two per partition, are joined
    afterwards.  A single document is its own next.  Null text counts as empty;
    repeated rows follow each other; other columns are ignored; an empty table
    gives an empty result.
    """
    src = docs.select(F.col(key).alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))
    order = [F.col("__key").desc_nulls_last(), F.xxhash64("__text")]
    ranged = src.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = src.schema["__key"].dataType
    fields = ([T.StructField("__key", kind), T.StructField("part", T.LongType()), T.StructField("edge", T.IntegerType()),
               T.StructField("__text", T.StringType())]
              + [T.StructField(c, T.LongType() if c == "n_chars" else T.StringType()) for c in _RESULT])
    schema = T.StructType(fields)

    def frame(rows, key_type):
        cols = list(zip(*rows))
        types = [key_type, pa.int64(), pa.int32(), pa.string(), pa.int64()] + [pa.string()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    def run(frames):
        part, held, key_type = TaskContext.get().partitionId(), None, None
        for batch in batches(frames):
            key_type, out = batch.schema.field(0).type, []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fingerprint(body)
                if held is None:
                    out.append((k, part, 1, body) + (None,) * 5)  # first of the range
                else:
                    out.append((held[0], part, 0, None) + _compared(held[1], held[2], body, own))
                held = (k, body, own)
            yield frame(out, key_type)
        if held is not None:
            yield frame([(held[0], part, 2, held[1]) + (None,) * 5], key_type)  # last of the range

    staged = stage_table(ranged.mapInArrow(run, schema), "neighbours")
    inner = staged.filter("edge = 0").select("__key", *_RESULT)

    firsts = staged.filter("edge = 1").select("part", F.col("__text").alias("next_text"))
    parts = staged.filter("edge = 1").select("part")  # one row per partition
    following = parts.select("part", F.coalesce(
        F.lead("part").over(Window.orderBy("part")),
        F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    lasts = (staged.filter("edge = 2").select("__key", "part", "__text").join(following, "part")
             .join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("__key", "__text", "next_text"))
    border = T.StructType([fields[0]] + fields[4:])

    def run_borders(frames):
        for batch in frames:
            rows = []
            for body, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows.append(_compared(body, fingerprint(body), after, fingerprint(after)))
            if rows:
                types = [pa.int64()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=border.names)

    every = inner.unionByName(lasts.mapInArrow(run_borders, border))
    return every.select(F.col("__key").alias(key), *_RESULT,
                        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
