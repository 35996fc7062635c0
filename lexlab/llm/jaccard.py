"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed word shingles.  Texts with the same set form one class
from the start and are represented by one of them, so copies cost nothing more.

A run starts at a root node and sends a set down one branch per *sampled*
token: every node samples each token of a set with probability
``1 / (threshold * size)`` by a hash of node and token, so two sets that share
much share a branch often.  A bucket of one set is dropped, one of up to
``limit`` sets is solved by brute force, a larger one splits again by its own
samples, ``depth`` levels in all.  As many runs are made as bring a pair at the
threshold together with probability ``recall`` (see :func:`runs_for`; more alike
pairs meet more often).

What is still large at the last level is mostly alike, and is compared in
blocks: tasks of two blocks of ``block`` sets, so no bucket is ever held or
sorted as a whole.  Buckets of different runs overlap much, and work is saved
without leaving a pair out: equal member lists and lists inside another list
are solved once; large buckets of mostly the same members are solved as their
union; in a large bucket, members that met in an earlier large one
are not compared among each other again.  Each set carries the ids of all its
buckets, and a pair counts in the first bucket that both are in, hence once.

Similarity is exact, on all shingles.  Pairs are not written out: a task returns,
per set, the number of its links and one edge to the root of its part, so the
rows stay linear in the input.  Classes are connected components, found by
alternating star steps on tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import FINE, U, batches, shingle_hashes, splitmix, utf8, word_hashes
from lexlab.session import forget_shuffles, stage_table

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99
DEPTH = 2
LIMIT = 64
BLOCK = 256
_ALL = float(1 << 64)


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a bucket with this
    probability.  At each level it shares a sampled token with probability
    1 - 1/e at least, independently in each run."""
    p = (1 - math.exp(-1)) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def paths(tokens: np.ndarray, nodes: np.ndarray, threshold: float) -> np.ndarray:
    """Buckets below the given nodes that a set of tokens goes to."""
    if len(tokens) == 0:
        return np.zeros(0, np.int64)
    limit = U(min(_ALL - 2048, _ALL / (threshold * len(tokens))))
    with np.errstate(over="ignore"):
        h = (tokens[None, :] ^ nodes[:, None]) * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        at, j = np.nonzero((h ^ (h >> U(32))) <= limit)
        return np.unique(splitmix(tokens[j] * U(0xD6E8FEB86659FD93) + nodes[at]).astype(np.int64))


def _roots(runs: int) -> np.ndarray:
    return splitmix(np.arange(runs, dtype=U) * U(7919) + U(17))


def _sets(batch, shingle: int):
    """The sorted shingle hashes of each text of a batch's last column."""
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    words, first = word_hashes(data, offsets)
    for i in range(len(offsets) - 1):
        yield data[offsets[i]:offsets[i + 1]], shingle_hashes(words[first[i]:first[i + 1]], shingle)


# ---- brute force of one bucket or pair of blocks ------------------------------------
def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    m = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    hold = often[column]
    owner, column = owner[hold], (np.cumsum(often) - 1)[column[hold]]
    out = np.zeros((m, m), np.float32)
    width = 4096  # columns at a time: what is held does not grow with the texts
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def links(nids, sets, groups, copies, sides, group: int, threshold: float):
    """``(nid, links, root)`` of the members that have links in this task."""
    m = len(sets)
    n = np.array([len(s) for s in sets], float)
    sides = np.array(sides)
    todo = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    todo &= np.arange(m)[:, None] < np.arange(m)[None, :]
    if sides.any():
        todo &= sides[:, None] != sides[None, :]
    earlier = sorted({g for own in groups for g in own if g < group})
    if earlier:
        at = {g: i for i, g in enumerate(earlier)}
        in_earlier = np.zeros((m, len(earlier)), np.float32)
        for i, own in enumerate(groups):
            for g in own:
                if g < group:
                    in_earlier[i, at[g]] = 1
        todo &= in_earlier @ in_earlier.T == 0
    rows, cols = np.nonzero(todo)
    if len(rows) == 0:
        return []
    if len(rows) <= 2 * m:
        both = np.empty(len(rows))
        for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist())):
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            both[k] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
    else:
        both = _shared(sets)[rows, cols]
    like = both >= threshold * (n[rows] + n[cols] - both) - 1e-9
    rows, cols = rows[like], cols[like]
    if len(rows) == 0:
        return []
    weight = np.array(copies, np.int64)
    total = np.bincount(rows, weight[cols], m) + np.bincount(cols, weight[rows], m)
    up = list(range(m))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(rows.tolist(), cols.tolist()):
        i, j = root(i), root(j)
        if i != j:
            lo, hi = (i, j) if nids[i] <= nids[j] else (j, i)
            up[hi] = lo
    return [(nids[i], int(total[i]), nids[root(i)]) for i in np.flatnonzero(total).tolist()]


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows ``g, i, j, side, nid, tokens, groups, copies``, sorted by task within
    their partitions, to ``nid, links, root``."""
    names = ["nid", "links", "root"]

    def run(frames):
        task, held, out = None, {}, []
        for batch in batches(frames):
            cols = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            tokens = cols["tokens"]
            values = tokens.values.to_numpy(zero_copy_only=False).view(U)
            offs = tokens.offsets.to_numpy()
            small = [cols[c].to_pylist() for c in ("g", "i", "j", "side", "nid", "groups", "copies")]
            for k, (g, i, j, side, nid, groups, copies) in enumerate(zip(*small)):
                if (g, i, j) != task:
                    if len(held) > 1:
                        out += links(list(held), *zip(*held.values()), task[0], threshold)
                    task, held = (g, i, j), {}
                held[nid] = (values[offs[k]:offs[k + 1]].copy(), groups, copies, side)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        if len(held) > 1:
            out = links(list(held), *zip(*held.values()), task[0], threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return rows.mapInArrow(run, "nid long, links long, root long")


# ---- connected components --------------------------------------------------------
def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges (hi, lo)`` that is not a root
    itself; the root is the least node of the component.

    Alternating large-star and small-star steps; the neighbours of a node are
    never gathered, only their minimum, and a node with many of them meets it in
    a join of stored tables, which can be split.
    """
    e = stage_table(edges.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
                    .distinct(), "edges")
    mark = None
    for _ in range(max_steps):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).collect()[0]
        if now == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = stage_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stage_table(both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
                            "large-star")
        least = stage_table(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi")
        e = stage_table(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
                        .union(small.select("hi", "m")).distinct(), "small-star")
    raise RuntimeError("components did not settle")


# ---- the join ---------------------------------------------------------------------
def _leaves(first: DataFrame, sets, threshold: float, limit: int, depth: int):
    """``(small, large)`` buckets ``(bucket, nid)`` at the end of the recursion."""
    level, small, large = first, [], None
    for d in range(1, depth + 1):
        sizes = stage_table(level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        level = stage_table(level.join(sizes, "bucket"), "level")
        small.append(level.filter(F.col("size") <= limit).select("bucket", "nid"))
        large = level.filter(F.col("size") > limit).select("bucket", "nid")
        if d == depth or large.isEmpty():
            break

        def run(frames):
            for batch in batches(frames):
                tokens = batch.column(2)
                values, offs = tokens.values.to_numpy(zero_copy_only=False).view(U), tokens.offsets.to_numpy()
                at, below = [], []
                nodes = batch.column(0).to_numpy(zero_copy_only=False).view(U)
                for k in range(len(nodes)):
                    got = paths(values[offs[k]:offs[k + 1]], nodes[k:k + 1], threshold)
                    below += got.tolist()
                    at += [k] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(below, pa.int64()), batch.column(1).take(pa.array(at, pa.int64()))],
                                                 names=["bucket", "nid"])

        level = stage_table(large.join(sets(level.select("nid")), "nid").select("bucket", "nid", "tokens")
                            .mapInArrow(run, "bucket long, nid long"), "split")
    out = small[0]
    for s in small[1:]:
        out = out.union(s)
    return out, large


def _small_tasks(small: DataFrame, large: DataFrame) -> DataFrame:
    """``(g, nid)`` of the small buckets, without those that another holds."""
    lists = (small.groupBy("bucket").agg(F.array_sort(F.collect_list("nid")).alias("m"))
             .groupBy("m").agg(F.min("bucket").alias("g")))
    lists = stage_table(lists, "lists")
    member = lists.select("g", F.size("m").alias("n"), F.explode("m").alias("nid"))
    # lists inside a larger one that has their first member too
    wider = lists.select(F.col("g").alias("w"), F.col("m").alias("wm"), F.explode("m").alias("first"))
    inside = (lists.withColumn("first", F.col("m")[0]).join(wider, "first")
              .filter((F.size("wm") > F.size("m")) & (F.size(F.array_except("m", "wm")) == 0)).select("g"))
    in_large = (member.join(large.select("nid", "bucket"), "nid").groupBy("g", "bucket", "n")
                .agg(F.count(F.lit(1)).alias("k")).filter("k = n").select("g"))
    gone = stage_table(inside.union(in_large).distinct(), "held")
    return lists.join(gone, "g", "left_anti").select("g", F.explode("m").alias("nid"))


def _merged(large: DataFrame, share: float = 0.5) -> DataFrame:
    """Large buckets that are mostly the same sets, as one: two buckets join if
    one follows the other in the bucket lists of at least ``share`` of the larger
    one's members.  A union only adds pairs to compare, and replaces the same
    comparisons in each of its buckets."""
    if large.isEmpty():
        return large
    of = large.groupBy("nid").agg(F.array_sort(F.collect_set("bucket")).alias("own"))
    follows = (of.select("own", F.posexplode("own").alias("at", "hi")).filter("at > 0")
               .select("hi", F.element_at("own", F.col("at")).alias("lo")).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("k")))
    sizes = stage_table(large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "large-sizes")
    edges = (follows.join(sizes.select(F.col("bucket").alias("hi"), F.col("n").alias("n_hi")), "hi")
             .join(sizes.select(F.col("bucket").alias("lo"), F.col("n").alias("n_lo")), "lo")
             .filter(F.col("k") >= share * F.greatest("n_hi", "n_lo")).select("hi", "lo"))
    roots = components(edges)
    return stage_table(large.join(roots.withColumnRenamed("node", "bucket"), "bucket", "left")
                       .select(F.coalesce("root", "bucket").alias("bucket"), "nid").distinct(), "merged")


def _large_tasks(large: DataFrame, block: int) -> DataFrame:
    """``(g, i, j, side, nid)``: pairs of blocks of the large buckets."""
    # each member's large buckets in order; the one that most members of a bucket come from is its
    # predecessor, and members that are in that one too have met there
    of = large.groupBy("nid").agg(F.array_sort(F.collect_set("bucket")).alias("own"))
    rows = of.select("nid", "own", F.posexplode("own").alias("at", "bucket"))
    before = (rows.filter("at > 0").select("bucket", F.element_at("own", F.col("at")).alias("prev"))
              .groupBy("bucket", "prev").agg(F.count(F.lit(1)).alias("k"))
              .groupBy("bucket").agg(F.max(F.struct("k", "prev")).alias("b")).select("bucket", F.col("b.prev").alias("prev")))
    marked = (rows.join(before, "bucket", "left")
              .select("bucket", "nid", F.coalesce(F.expr("array_contains(own, prev)"), F.lit(False)).alias("old")))
    marked = stage_table(marked, "large")
    sizes = stage_table(marked.groupBy("bucket").agg(
        F.ceil(F.count_if(~F.col("old")) / block).cast("int").alias("n_new"),
        F.ceil(F.count_if("old") / block).cast("int").alias("n_old")), "large-sizes")
    # blocks of new members come first; a pair of blocks needs a new one
    placed = (marked.join(sizes, "bucket").filter("n_new > 0")
              .withColumn("k", F.when(F.col("old"), F.col("n_new") + F.pmod(F.xxhash64("nid"), F.greatest("n_old", F.lit(1))))
                          .otherwise(F.pmod(F.xxhash64("nid"), F.col("n_new"))).cast("int")))
    mates = F.when(F.col("old"), F.sequence(F.lit(0), F.col("n_new") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("n_new") + F.col("n_old") - 1))
    return (placed.withColumn("o", F.explode(mates))
            .select(F.col("bucket").alias("g"), F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"),
                    (F.col("k") > F.col("o")).cast("int").alias("side"), "nid"))


def _classes(docs: DataFrame, key: str, text: str, shingle: int, threshold: float, recall: float, depth: int,
             limit: int, block: int):
    """``(members, found)``: each row's set, and each set's class and links."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__th"), F.coalesce(text, F.lit("")).alias("__text"))
    kind = src.schema["__key"].dataType
    schema = T.StructType([T.StructField("__key", kind), T.StructField("__th", T.LongType()), T.StructField("a", T.LongType()),
                           T.StructField("b", T.LongType()), T.StructField("picks", T.ArrayType(T.LongType()))])
    nodes = _roots(runs_for(recall, depth))

    def first(frames):
        for batch in batches(frames, FINE):
            ids, picks = [], []
            for raw, tokens in _sets(batch, shingle):
                body = tokens.tobytes() if len(tokens) else b"no words" + raw.tobytes()
                ids.append(hashlib.blake2b(body, digest_size=16).digest())
                picks.append(paths(tokens, nodes, threshold))
            ab = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            offs = np.cumsum([0] + [len(p) for p in picks])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(picks), pa.int64()))],
                names=schema.names)

    forget_shuffles(spark)
    members = stage_table(src.mapInArrow(first, schema), "members")
    reps = stage_table(members.groupBy("a", "b").agg(F.min(F.struct("__key", "__th")).alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                     F.first("picks").alias("picks"))
                       .withColumn("nid", F.monotonically_increasing_id()), "sets")
    members = members.drop("picks")

    def sets(of: DataFrame) -> DataFrame:
        """``nid, tokens`` of some sets, from the texts of their representatives."""
        if not made:
            want = (reps.join(of.distinct(), "nid").select("nid", F.col("rep.__key").alias("r_key"), F.col("rep.__th").alias("r_th")))
            rows = src.join(want, F.col("__key").eqNullSafe(F.col("r_key")) & F.col("__th").eqNullSafe(F.col("r_th")))

            def tokens(frames):
                for batch in batches(frames, FINE):
                    got = [t for _, t in _sets(batch, shingle)]
                    offs = np.cumsum([0] + [len(t) for t in got])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()),
                                                                   pa.array(np.concatenate(got).view(np.int64)))], names=["nid", "tokens"])

            made.append(stage_table(rows.select("nid", "__text").mapInArrow(tokens, "nid long, tokens array<long>")
                                    .dropDuplicates(["nid"]), "tokens"))
        return made[0]

    made: list[DataFrame] = []
    small, large = _leaves(reps.select("nid", F.explode("picks").alias("bucket")), sets, threshold, limit, depth)
    tokens = sets(small.select("nid").union(large.select("nid")))
    large = _merged(large)
    one = stage_table(_small_tasks(small, large), "small")
    many = large
    in_groups = (one.union(many.select("bucket", "nid")).groupBy("nid").agg(F.array_sort(F.collect_set("g")).alias("groups")))
    info = tokens.join(in_groups, "nid").join(reps.select("nid", "copies"), "nid")
    tasks = (one.select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "nid")
             .unionByName(_large_tasks(many, block)))
    rows = tasks.join(info, "nid").select("g", "i", "j", "side", "nid", "tokens", "groups", "copies")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n_parts, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    forget_shuffles(spark)
    found = stage_table(_verify(rows, threshold), "links")
    comps = components(found.select(F.col("nid").alias("hi"), F.col("root").alias("lo")))
    total = found.groupBy("nid").agg(F.sum("links").alias("links"))
    out = (reps.drop("picks").join(total, "nid", "left").join(comps.withColumnRenamed("node", "nid"), "nid", "left")
           .withColumn("root", F.coalesce("root", "nid")))
    out = stage_table(out, "linked")
    heads = out.groupBy("root").agg(F.min("rep").alias("head"))
    return members, stage_table(out.join(heads, "root").select("a", "b", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head"),
                                "classes")


def jaccard_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, limit: int = LIMIT,
                    block: int = BLOCK) -> DataFrame:
    """``key, class_id, n_links, n_copies, first`` for every row of ``docs``.

    A link joins two rows whose shingle sets have Jaccard similarity of at least
    ``threshold``; a class is what links connect.  ``class_id`` is the least key
    of the class, ``n_links`` the number of other rows that the row links to
    (copies counted), ``n_copies`` the number of other rows with the same set,
    and ``first`` marks the row whose key (then text hash) is least.  Texts of
    fewer than ``shingle`` words have one shingle of them all; texts without
    words (null counts as empty) are alike only when equal; repeated rows and
    null keys are rows like others (a null key is the least); other columns are
    ignored; an empty table gives an empty result.
    """
    members, classes = _classes(docs, key, text, shingle, threshold, recall, depth, limit, block)
    return (members.join(classes, ["a", "b"])
            .select(F.col("__key").alias(key), F.col("head.__key").alias("class_id"),
                    (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"),
                    (F.col("__key").eqNullSafe(F.col("head.__key")) & F.col("__th").eqNullSafe(F.col("head.__th"))).alias("first")))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the first stays,
    once; all columns."""
    o = {"shingle": SHINGLE, "threshold": THRESHOLD, "recall": RECALL, "depth": DEPTH, "limit": LIMIT, "block": BLOCK} | options
    _, classes = _classes(docs, key, text, **o)
    heads = classes.select(F.col("head.__key").alias("__k"), F.col("head.__th").alias("__h")).distinct()
    cols = docs.columns
    kept = (docs.withColumn("__h2", F.xxhash64(text))
            .join(heads, F.col(key).eqNullSafe(F.col("__k")) & F.col("__h2").eqNullSafe(F.col("__h")), "left_semi"))
    return kept.dropDuplicates([key, "__h2"]).select(*cols)
