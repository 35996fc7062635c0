"""Cross-tokenizer alignment over exactly de-duplicated texts.

Two tokenizers read the same bytes, a blank and the text.  Byte offsets where
tokens of both end cut them into groups; the two tokens that end there are linked.
How often an id pair is linked is counted over all documents.

* The rows are shuffled by their full text, copies fold into one row and a count
  (a hot text is one row per task before the shuffle), and each distinct text is
  tokenised and aligned once.
* Aligned texts are stored in blocks of some 2 MB of text: a block lists its
  distinct id pairs once, weighted by the copies of its texts, and its texts refer
  to that list.  Only these lists go through the count and come back with the
  totals, so a pair that every text holds is one row per block.
* Measures are worked out block by block, then joined to the documents by the
  SHA-256 of the text.  Texts of more than a thousandth of all documents, less than
  a thousand, go by a broadcast, so no key of the shuffled join is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlab.llm.common import batches
from lexlab.llm.tokens import byte_level, piece_model, slices
from lexlab.session import drop_staged, stage_table

BLOCK = 2 << 20  # bytes of text in a block; a longer text is a block of its own


# ---- one text ---------------------------------------------------------------------
class Aligner:
    """Aligns texts under a byte-level file and a ``sentencepiece`` file."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a, True), piece_model(path_b)
        sides = [x.bytes_of for x in (self.a, self.b)]
        self.names = [[x.get(i, b"") for i in range(max(x) + 1)] for x in sides]
        self.lengths = [np.array([len(s) for s in names], np.int64) for names in self.names]
        self.b_size = len(self.names[1])
        # an id and what follows it: in a group a comma, at its end | (left) or ; (right)
        self.words = [b"%d%s" % (i, c) for names, end in zip(self.names, (b"|", b";")) for i in range(len(names)) for c in (b",", end)]
        self.shift = 2 * len(self.names[0])

    def align(self, text: str):
        """``(n_a, n_b, digest, links)``; ``links`` are pairs ``a * b_size + b``,
        one for each offset where tokens of both sides end.  None if the text is empty or
        either side's bytes are not those of a blank and the text."""
        if not text:
            return None
        parts = slices(text) if self.b.by_slice else [text]
        sha, links, n_a, n_b, tail = hashlib.sha256(), [], 0, 0, b""
        for part in parts:
            want = (" " + part).encode()
            ids = (self.a.ids(" " + part), self.b.ids(part))
            if any(b"".join(map(names.__getitem__, x.tolist())) != want for names, x in zip(self.names, ids)):
                return None
            a, b = ids
            end_a, end_b = (np.cumsum(n[x]) for n, x in zip(self.lengths, ids))
            both = np.intersect1d(end_a, end_b, assume_unique=True)
            last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
            links.append(a[last_a].astype(np.int64) * self.b_size + b[last_b])
            # groups in order, each with its left ids before its right ids
            closed_a, closed_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            closed_a[last_a], closed_b[last_b] = 1, 1
            in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            order = np.empty(len(a) + len(b), np.int64)
            order[np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = 2 * a.astype(np.int64) + closed_a
            order[np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)] = self.shift + 2 * b.astype(np.int64) + closed_b
            sha.update(tail)
            tail = b"".join(map(self.words.__getitem__, order.tolist()))
            n_a, n_b = n_a + len(a), n_b + len(b)
        sha.update(tail[:-1])
        return n_a, n_b, sha.hexdigest(), np.concatenate(links)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


# ---- blocks of texts ----------------------------------------------------------------
_BLOCKS = ("block long, sha array<binary>, copies array<long>, n_a array<long>, n_b array<long>, digest array<string>, "
           "n_links array<int>, links binary, pairs array<long>, weights array<long>, b_size long")
_ARROW = pa.schema([("block", pa.int64()), ("sha", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())),
                    ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("digest", pa.list_(pa.string())),
                    ("n_links", pa.list_(pa.int32())), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())),
                    ("weights", pa.list_(pa.int64())), ("b_size", pa.int64())])
_NONE = (0, 0, "", np.zeros(0, np.int64))


def aligned_blocks(texts: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Blocks of aligned texts from ``(text, sha, copies)``, each text once."""
    def run(frames):
        al, number, rows, size = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0

        def flush():
            sha, copies, n_a, n_b, digest, links = zip(*rows)
            n_links = np.array([len(x) for x in links], np.int64)
            pairs, inverse = np.unique(np.concatenate(links), return_inverse=True)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, inverse, np.repeat(np.array(copies, np.int64), n_links))
            return pa.RecordBatch.from_pylist([{
                "block": number, "sha": sha, "copies": copies, "n_a": n_a, "n_b": n_b, "digest": digest,
                "n_links": n_links, "links": inverse.astype(np.uint32).tobytes(), "pairs": pairs, "weights": weights,
                "b_size": al.b_size}], schema=_ARROW)

        for batch in batches(frames):
            for text, sha, copies in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((sha, copies, *(al.align(text) or _NONE)))
                size += len(text) + 100
                if size >= block:
                    yield flush()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield flush()

    return texts.select("text", "sha", "copies").mapInArrow(run, _BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best`` over all documents; ``best``: no pair of the same
    right id has a higher count."""
    counts = stage_table(blocks.select("b_size", F.explode(F.arrays_zip("pairs", "weights")).alias("x"))
                         .groupBy(F.col("x.pairs").alias("pair"), (F.col("x.pairs") % F.col("b_size")).alias("b"))
                         .agg(F.sum("x.weights").alias("count")), "pair-counts")
    # one row per id of the right vocabulary
    top = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("top")))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


_MEASURES = "sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def text_measures(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per distinct text, from blocks and the totals of their pairs."""
    listed = (blocks.select("block", F.posexplode("pairs").alias("i", "pair")).join(counts, "pair")
              .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "count", "best"))).alias("x"))
              .select("block", F.col("x.count").alias("count"), F.col("x.best").alias("best")))
    rows = (blocks.select("block", "sha", "copies", "n_a", "n_b", "digest", "n_links", "links")
            .join(listed, "block", "left").drop("block"))

    def run(frames):
        for batch in frames:
            for r in range(batch.num_rows):
                sha, copies, n_a, n_b, digest, n_links, links, count, best = (c[r] for c in batch.columns)
                n = np.array(n_links.as_py(), np.int64)
                ends = np.cumsum(n)
                at = np.frombuffer(links.as_py(), np.uint32)
                out = []
                for values in (best.values, count.values) if len(at) else (None, None):
                    if values is None:
                        out.append(np.zeros(len(n), np.int64))
                        continue
                    flat = np.asarray(values.to_numpy(zero_copy_only=False)).astype(np.int64)[at]
                    run_sum = np.r_[0, np.cumsum(flat)]
                    out.append(run_sum[ends] - run_sum[ends - n])
                n = pa.array(n)
                yield pa.RecordBatch.from_arrays(
                    [sha.values, copies.values, n_a.values, n_b.values, n, n, pa.array(out[0]), pa.array(out[1]), digest.values],
                    names=["sha", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, _MEASURES)


# ---- documents ------------------------------------------------------------------------
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text",
                    block: int = BLOCK) -> DataFrame:
    """``key`` and :data:`MEASURES` for every row of ``docs``.

    Null and empty texts, and texts that a side does not give back byte by byte,
    have zeros and an empty digest.  Rows with equal texts have equal measures and
    all count; repeated rows and null keys stay row by row; ties for the highest
    count are all best; other columns are ignored; an empty table gives an empty
    result.  A text is worked on in slices cut before blanks, so memory follows
    its tokens, and the tokenizers' own need its longest stretch without a blank.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sha = F.unhex(F.sha2(body.cast("binary"), 256))
    distinct = (docs.select(body.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
                .withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    blocks = stage_table(aligned_blocks(distinct, path_a, path_b, block), "aligned")
    measures = stage_table(text_measures(blocks, pair_counts(blocks)), "measures")
    drop_staged(blocks)
    n = measures.agg(F.sum("copies")).first()[0] or 0
    keys = stage_table(docs.select(F.col(key).alias("__key"), sha.alias("sha")), "text-keys")
    hot = F.col("copies") * 1000 > n  # less than a thousand texts
    columns = [F.col("__key").alias(key), *MEASURES]
    by_broadcast = keys.join(F.broadcast(measures.filter(hot)), "sha").select(*columns)
    rest = keys.join(F.broadcast(measures.filter(hot).select("sha")), "sha", "left_anti")
    return by_broadcast.unionByName(rest.join(measures.filter(~hot), "sha").select(*columns))
