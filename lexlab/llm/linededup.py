"""Line dedup: pairwise alignment of documents that share rare lines.

Documents are ordered by key (then by a hash of the text).  Lines are made rare
enough to speak for an overlap: a line of ``min_words`` words or more counts by
its own hash, a shorter one only together with the longer line before it (or,
at the top, after it; in a text without any, with the whole text), and the
n-th occurrence of a line in a document is told apart from the first.  So a
hash occurs once in a document at most, which is what patience diff anchors on.

The *holder* of a hash is the earliest document with it.  Every later document
is paired with the holders of its lines: a line in a million documents makes a
million pairs and not half the square of that, and no line is left out for
being frequent.  Per pair, patience diff takes the longest common subsequence
in order of the shared hashes; the aligned lines, which form the common blocks,
are deleted from the later document.  The holder's line is never deleted on
that account, so one copy of everything stays.

A line that an earlier document has, but that does not align with its holder
(the two share other lines in another order), is *left over*.  Documents with
left-over lines are aligned, on all lines that they share, with further earlier
ones: the first with the same neighbouring pair of shared lines, the first with
the same shared lines throughout, and, for lines that are left even then, the
other earlier documents with the line (of those with the same shared lines
throughout the first, as they align alike), from the nearest back, 4 at first
and 8 times as many in each further round, until the line aligns or none is
left.  So a line goes exactly if it aligns with its holder or with any other
earlier document.

Lines, holders and matches travel as hashes and positions; a frequent hash
meets its holder in a skew-splittable join of two stored tables, and lists are
gathered per document only, never per line or per holder.  The rounds try
documents back to the last one that aligns: documents that cross in the same
way find each other, so the tries of each way of crossing add up to a multiple
of the documents with the line, however many they are.  Only a line that crosses
in a way of its own is tried with all of them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import batches
from lexlab.session import stage_table

MIN_WORDS = 5
#: parts of the rows of a frequent key
SALTS = 16
#: earlier documents tried at first for a line that is still left, and the factor from one round to the next
FIRST_TRIES, GROWTH = 4, 8


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=16).digest()


def line_keys(text: str, min_words: int = MIN_WORDS) -> list[bytes]:
    """A 16-byte key for each line, different for all lines of the text."""
    lines = text.split("\n")
    plain = [x.strip().encode("utf-8", "surrogatepass") for x in lines]
    own = [_hash(p) if len(x.split()) >= min_words else None for p, x in zip(plain, lines)]
    first = next((k for k in own if k), None)
    context = b"<" + first if first else _hash(b"=", *plain)
    seen: dict[bytes, int] = {}
    out, ahead = [], 0
    for p, k in zip(plain, own):
        if k:
            key, context, ahead = k, k, 0
        else:
            key, ahead = _hash(b"+", context, str(ahead).encode(), p), ahead + 1
        n = seen[key] = seen.get(key, 0) + 1
        out.append(key if n == 1 else _hash(b"#", key, str(n).encode()))
    return out


def aligned(pairs: list[tuple[int, int]]) -> list[int]:
    """Patience: of ``(position in the later, position in the earlier)`` of the
    shared keys, the later's positions on the longest common subsequence."""
    pairs.sort()
    piles, tops, back = [], [], []
    for i, (_, e) in enumerate(pairs):
        k = bisect_left(tops, e)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(e)
            piles.append(i)
        else:
            tops[k], piles[k] = e, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i][0])
        i = back[i]
    return out


def _further(signs: DataFrame, left: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc, i`` of the lines of ``left`` that align within ``pairs`` (``doc, e``:
    a document and an earlier one); ``i`` counts shared lines."""
    later = pairs.distinct().join(left.groupBy("doc").agg(F.collect_set("i").alias("left")), "doc")
    later = later.join(signs.select("doc", "keys"), "doc")
    both = later.join(signs.select(F.col("doc").alias("e"), F.col("keys").alias("e_keys")), "e")
    schema = T.StructType([signs.schema["doc"], T.StructField("i", T.IntegerType())])

    def align(frames):
        for batch in batches(frames):
            of, at = [], []
            for n, (wanted, keys, others) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                place = {k: j for j, k in enumerate(others)}
                found = set(aligned([(i, place[k]) for i, k in enumerate(keys) if k in place])).intersection(wanted)
                of += [n] * len(found)
                at += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(at, pa.int32())],
                                             names=schema.names)

    return both.select("doc", "left", "keys", "e_keys").mapInArrow(align, schema).distinct()


def _salted_join(rows: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for a key at most; the rows of
    a frequent key are dealt to ``SALTS`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    each = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [*on, "salt"])


def _ranked(signs: DataFrame, lines: DataFrame) -> DataFrame:
    """``hash, doc, rank``: for each line of ``lines`` the first documents of the
    different sequences of shared lines that hold it, numbered in their order.

    Numbers come from two levels, within ranges of a sort and from the sums over
    earlier ranges, so a frequent line is never numbered in one task."""
    firsts = signs.groupBy("sign").agg(F.min("doc").alias("doc")).select("doc")
    held = signs.join(firsts, "doc", "left_semi").select("doc", F.explode("keys").alias("hash"))
    wanted = lines.select("hash").distinct()
    ranges = _salted_join(held, wanted, ["hash"]).select("hash", "doc").repartitionByRange("hash", "doc")
    ranges = stage_table(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    before = (ranges.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("hash", "part", (F.sum("n").over(Window.partitionBy("hash").orderBy("part")) - F.col("n")).alias("before")))
    inside = F.row_number().over(Window.partitionBy("hash", "part").orderBy("doc"))
    return stage_table(ranges.withColumn("inside", inside).join(before, ["hash", "part"])
                       .select("hash", "doc", (F.col("before") + F.col("inside")).alias("rank")), "ranked")


def _left_over(signs: DataFrame) -> DataFrame | None:
    """``doc, i`` of the left-over lines that align with an earlier document
    other than their holder; None if no line is left over."""
    left = stage_table(signs.filter(F.size("left") > 0).select("doc", F.explode("left").alias("i")), "left")
    if left.isEmpty():
        return None
    own = signs.join(left.select("doc").distinct(), "doc", "left_semi")
    # neighbouring pairs of shared lines around a left-over line, and the first document with each
    pair = F.explode(F.expr("filter(flatten(transform(left, i -> array(i - 1, i))), j -> j >= 0 AND j + 1 < size(keys))"))
    around = (own.select("doc", "keys", pair.alias("j"))
              .select("doc", F.expr("keys[j]").alias("a"), F.expr("keys[j + 1]").alias("b")).distinct())
    every = (signs.filter(F.size("keys") > 1)
             .select("doc", F.explode(F.expr("transform(sequence(0, size(keys) - 2), j -> struct(keys[j] AS a, keys[j + 1] AS b))")).alias("p"))
             .select("doc", "p.a", "p.b"))
    first = (_salted_join(every, around.select("a", "b").distinct(), ["a", "b"])
             .groupBy("a", "b").agg(F.min("doc").alias("e")))
    alike = (_salted_join(signs.select("doc", "sign"), own.select("sign").distinct(), ["sign"])
             .groupBy("sign").agg(F.min("doc").alias("e")))
    near = (_salted_join(around, first, ["a", "b"]).select("doc", "e")
            .unionByName(_salted_join(own.select("doc", "sign"), alike, ["sign"]).select("doc", "e")).filter("e < doc"))
    found = stage_table(_further(signs, left, near), "aligned")
    rest = stage_table(left.join(found, ["doc", "i"], "left_anti"), "left")
    if rest.isEmpty():
        return found
    lines = stage_table(rest.join(signs.select("doc", "keys"), "doc").select("doc", "i", F.expr("keys[i]").alias("hash")), "left")
    ranked = _ranked(signs, lines)
    # a line that is left belongs to the first document with its sequence, so it has a rank itself
    tries = stage_table(lines.join(ranked, ["hash", "doc"]), "tries")
    low, width = 1, FIRST_TRIES
    while True:
        tries = tries.filter(F.col("rank") > low)
        if tries.isEmpty():
            return found
        ranks = F.sequence(F.greatest(F.col("rank") - (low + width - 1), F.lit(1)), F.col("rank") - low)
        others = (tries.select("doc", "hash", F.explode(ranks).alias("rank"))
                  .join(ranked.withColumnRenamed("doc", "e"), ["hash", "rank"]).select("doc", "e"))
        more = stage_table(_further(signs, tries.select("doc", "i"), others), "aligned")
        found = found.unionByName(more)
        tries = stage_table(tries.join(more, ["doc", "i"], "left_anti"), "tries")
        low, width = low + width, width * GROWTH


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, text, n_lines, n_removed`` and the columns in ``keep``, one row per row of ``docs``.

    Lines end at ``\\n`` and are compared without outer white space.  An exact
    copy of an earlier document loses every line and is left with the empty
    text; a null text stays null with 0 lines; an empty text has no lines.
    Rows equal in key and text are the same document, and neither loses lines
    to the other.  Null keys come first in the order.  Other columns, also of
    the names used here, are ignored unless kept; an empty table gives an empty
    result.
    """
    src = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__th"), F.col(text).alias("__text"),
                      *[F.col(c).alias(f"__keep_{c}") for c in keep])
    key_field = T.StructField("__key", src.schema["__key"].dataType)
    line_schema = T.StructType([key_field, T.StructField("__th", T.LongType()), T.StructField("hash", T.BinaryType()),
                                T.StructField("pos", T.IntegerType())])

    def lines(frames):
        for batch in batches(frames):
            of, hashes, pos = [], [], []
            for i, body in enumerate(batch.column(2).to_pylist()):
                if body:
                    keys = line_keys(body, min_words)
                    of += [i] * len(keys)
                    hashes += keys
                    pos += range(len(keys))
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes, pa.binary()), pa.array(pos, pa.int32())],
                names=line_schema.names)

    table = stage_table(src.select("__key", "__th", "__text").mapInArrow(lines, line_schema), "lines")
    holders = (table.groupBy("hash").agg(F.min(F.struct("__key", "__th", "pos")).alias("h"), F.count(F.lit(1)).alias("n"))
               .filter("n > 1").select("hash", F.col("h.__key").alias("e_key"), F.col("h.__th").alias("e_th"),
                                       F.col("h.pos").alias("e_pos")))
    holders = stage_table(holders, "holders")
    mine = F.col("__key").eqNullSafe(F.col("e_key")) & (F.col("__th") == F.col("e_th"))
    shared = (table.join(holders, "hash")
              .select(F.struct("__key", "__th").alias("doc"),
                      F.struct("pos", "hash", F.when(~mine, F.xxhash64("e_key", "e_th")).alias("e"), "e_pos").alias("m")))
    # a set, as repeated rows bring the same matches again
    shared = shared.groupBy("doc").agg(F.array_sort(F.collect_set("m")).alias("m"))
    ints = T.ArrayType(T.IntegerType())
    sign_schema = T.StructType([shared.schema["doc"], T.StructField("sign", T.BinaryType()),
                                T.StructField("keys", T.ArrayType(T.BinaryType())), T.StructField("pos", ints),
                                T.StructField("gone", ints), T.StructField("left", ints)])

    def sign(frames):
        # gone: positions that align with the holders; left: places of the left-over lines in keys
        for batch in batches(frames):
            cols = [[], [], [], [], []]
            for found in batch.column(1).to_pylist():
                partners: dict[int, list] = {}
                for m in found:
                    if m["e"] is not None:
                        partners.setdefault(m["e"], []).append((m["pos"], m["e_pos"]))
                gone = set()
                for pairs in partners.values():
                    gone.update(aligned(pairs))
                keys = [m["hash"] for m in found]
                left = [i for i, m in enumerate(found) if m["e"] is not None and m["pos"] not in gone]
                for col, x in zip(cols, (_hash(*keys), keys, [m["pos"] for m in found], sorted(gone), left)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 3)))],
                names=sign_schema.names)

    signs = stage_table(shared.mapInArrow(sign, sign_schema), "signs")
    gone = signs.filter(F.size("gone") > 0).select("doc", "gone")
    more = _left_over(signs)
    if more is not None:
        more = (more.join(signs.select("doc", "pos"), "doc").groupBy("doc")
                .agg(F.collect_set(F.expr("pos[i]")).alias("more")))
        gone = (gone.join(more, "doc", "full")
                .select("doc", F.array_union(F.coalesce("gone", F.array().cast(ints)), F.coalesce("more", F.array().cast(ints))).alias("gone")))
    matches = gone.select(F.col("doc.__key").alias("m_key"), F.col("doc.__th").alias("m_th"), F.col("gone").alias("m"))
    joined = src.join(matches, F.col("__key").eqNullSafe(F.col("m_key")) & (F.col("__th") == F.col("m_th")), "left")
    joined = joined.select("__key", "__text", "m", *[f"__keep_{c}" for c in keep])
    schema = T.StructType([T.StructField(key, key_field.dataType), T.StructField(text, T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
                          + [T.StructField(c, docs.schema[c].dataType) for c in keep])

    def delete(frames):
        for batch in batches(frames):
            texts, counts, removed = [], [], []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = body.split("\n") if body else []
                gone = set(found or ())
                texts.append("\n".join([r for i, r in enumerate(rows) if i not in gone]) if gone else body)
                counts.append(len(rows))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 *(batch.column(3 + i) for i in range(len(keep)))], names=schema.names)

    return joined.mapInArrow(delete, schema)
