"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids plus an end id; only those longer than a sequence
are cut.  Pieces that fill a sequence take one each.  The rest are dealt by hash
into groups of about ``group_size`` pieces; each group is solved by ``islands``
populations that differ in their random seed:

* a solution is a set of bins; the first comes from best fit by falling length,
  the others from best fit in a disturbed order;
* crossover injects whole well-filled bins of one parent into the other, removes
  the bins that hold a duplicate, and puts the displaced pieces back by best fit;
* mutation dissolves some bins with room, and some with many pieces to fill them with,
  and puts their pieces together anew: exact fills first, the rest by best fit;
* fitness is the number of bins, then the sum of squared fills, which is highest when
  all room is in one bin.  Best fit alone has few bins too, but room in many of
  them, which is lost for the groups' other pieces;
* between epochs each island hands its elite to the next island of its group.

A group is one row, so an epoch is a map over rows and migration a join on
``(group, island)``; tables between epochs are written to the shared folder.
After each round the pieces of bins that are not well filled are dealt anew, in
fewer groups, so that groups leave no more than a few open sequences in all.
A group stops as soon as it has the least number of bins there can be and all room
in one of them.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import batches, fill_exactly
from lexlab.llm.tokens import encoder
from lexlab.session import stage_table

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """``uid, key, piece, start, length, ids_crc32`` for every piece; ``uid`` is
    unique.  Null text is empty and gives the end id alone."""
    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField("uid", T.LongType()), src.schema["__key"], T.StructField("piece", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(frames):
        uid, enc = TaskContext.get().partitionId() << 40, encoder(tokenizer)
        for batch in batches(frames, 4 << 20):
            rows, of = [], []
            for i, ids in enumerate(enc.encode_all(batch.column(1))):
                ids = ids.as_py() + end
                for k in range(0, len(ids), step):
                    part = ids[k:k + step]
                    rows.append((uid, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
                    of.append(i)
                    uid += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), batch.column(0).take(pa.array(of)), pa.array(cols[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[2:])], names=schema.names)

    return src.mapInArrow(run, schema)


# ---- one population ---------------------------------------------------------------
class Bins:
    """Open bins by free space, with the best fit found by one bit operation."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]

    def add(self, bin_id: int, room: int) -> None:
        if room > 0:
            self.by_room[room].append(bin_id)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room for ``size``."""
        fitting = self.mask >> size
        if not fitting:
            return None
        room = (fitting & -fitting).bit_length() - 1 + size
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        return found, room


def best_fit(order, lengths, assign, bins: Bins, n_bins: int) -> int:
    """Place the pieces in this order; returns the number of bins."""
    for i in order:
        size = lengths[i]
        got = bins.take(size)
        if got is None:
            got, n_bins = (n_bins, bins.capacity), n_bins + 1
        assign[i] = got[0]
        bins.add(got[0], got[1] - size)
    return n_bins


def fitness(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better."""
    fill = np.bincount(assign, weights=lengths) / capacity
    return len(fill), -float((fill * fill).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Whole well-filled bins of ``b`` injected into ``a``."""
    fill = np.bincount(b, weights=lengths)
    well = np.flatnonzero(fill >= capacity - capacity // 256)
    if len(well) == 0:
        well = np.argsort(-fill, kind="stable")[:max(1, len(fill) // 4)]
    chosen = np.zeros(len(fill), bool)
    chosen[[x for x in well.tolist() if rng.random() < 0.5] or well[:1]] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True  # bins of a that hold a duplicate
    stays = ~hit[a]
    displaced = np.flatnonzero(hit[a] & ~injected)
    child = np.full(len(a), -1, np.int64)
    _, child[stays] = np.unique(a[stays], return_inverse=True)
    n_bins = int(child.max()) + 1 if stays.any() else 0
    _, inverse = np.unique(b[injected], return_inverse=True)
    child[injected] = n_bins + inverse
    n_bins = int(child.max()) + 1
    room = capacity - np.bincount(child[child >= 0], weights=lengths[child >= 0], minlength=n_bins).astype(np.int64)
    bins = Bins(capacity)
    for k in np.flatnonzero(room > 0).tolist():
        bins.add(k, int(room[k]))
    order = displaced[np.argsort(-lengths[displaced], kind="stable")].tolist()
    best_fit(order, lengths.tolist(), child, bins, n_bins)
    return child


def first_population(lengths: np.ndarray, capacity: int, size: int, rng: random.Random) -> list[np.ndarray]:
    out, plain = [], lengths.tolist()
    for k in range(size):
        noise = np.ones(len(lengths)) if k == 0 else np.array([rng.uniform(0.8, 1.25) for _ in plain])
        assign = np.zeros(len(lengths), np.int64)
        best_fit(np.argsort(-lengths * noise, kind="stable").tolist(), plain, assign, Bins(capacity), 0)
        out.append(assign)
    return out


def mutation(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random, n_bins: int) -> np.ndarray:
    """``n_bins`` bins with room, and a third as many of those with the most pieces, put
    together anew."""
    fill, held = np.bincount(a, weights=lengths).astype(np.int64), np.bincount(a)
    with_room = np.flatnonzero(fill < capacity).tolist()
    if not with_room:
        return a
    rich = np.argsort(-held, kind="stable")[:max(8, len(fill) // 8)].tolist()
    hit = np.zeros(len(fill), bool)
    hit[rng.sample(with_room, min(n_bins, len(with_room))) + rng.sample(rich, min(n_bins // 3, len(rich)))] = True
    stays = ~hit[a]
    of_length: dict[int, list[int]] = {}
    for i in np.flatnonzero(hit[a]).tolist():
        of_length.setdefault(int(lengths[i]), []).append(i)
    child = np.full(len(a), -1, np.int64)
    _, child[stays] = np.unique(a[stays], return_inverse=True)
    n = int(child.max()) + 1 if stays.any() else 0
    room = capacity - np.bincount(child[stays], weights=lengths[stays], minlength=n).astype(np.int64)
    counts = {size: len(v) for size, v in of_length.items()}
    for size in sorted(counts, reverse=True):
        while counts.get(size) and (got := fill_exactly(counts, capacity, size)):
            for x in got:
                child[of_length[x].pop()] = n
                counts[x] -= 1
                if not counts[x]:
                    del counts[x]
            n += 1
    bins = Bins(capacity)
    for k in np.flatnonzero(room > 0).tolist():
        bins.add(k, int(room[k]))
    best_fit(sorted((i for v in of_length.values() for i in v), key=lambda i: -lengths[i]), lengths.tolist(), child, bins, n)
    return child


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: random.Random, *,
           crossing: bool = True, mutating: bool = True, n_bins: int = 24) -> list[np.ndarray]:
    """The population after some generations, the best first.  Solutions of equal
    fitness are kept once."""
    tokens = int(lengths.sum())
    least = -(-tokens // capacity)
    ideal = least, -(least - 1 + (1 - (least * capacity - tokens) / capacity) ** 2) + 1e-9
    scored = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    count = len(scored)
    for _ in range(generations):
        if scored[0][0] <= ideal:
            break
        children = []
        if crossing and len(scored) > 1:
            i, j = rng.sample(range(len(scored)), 2)
            children += [crossover(scored[x][2], scored[y][2], lengths, capacity, rng) for x, y in ((i, j), (j, i))]
        if mutating:
            children += [mutation(scored[rng.randrange(len(scored))][2], lengths, capacity, rng, n_bins) for _ in range(2)]
        for child in children:
            score = fitness(lengths, child, capacity)
            if all(score != x[0] for x in scored):
                count += 1
                scored.append((score, count, child))
        scored = sorted(scored, key=lambda x: x[:2])[:len(population)]
    return [p for _, _, p in scored]


# ---- islands --------------------------------------------------------------------
_STATE = "grp long, island int, uids array<long>, lengths array<int>, pop array<array<int>>"


def _epoch(state: DataFrame, capacity: int, population: int, generations: int, epoch: int, seed: int) -> DataFrame:
    """One epoch on every island; ``pop`` null: the first one."""
    def run(frames):
        for batch in frames:
            out = []
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                rng = random.Random(f"{seed}/{r['grp']}/{r['island']}/{epoch}")
                pop = [np.array(p, np.int64) for p in r["pop"] or []]
                pop = pop or first_population(lengths, capacity, population, rng)
                r["pop"] = [p.tolist() for p in evolve(lengths, pop, capacity, generations, rng)]
                out.append({c: r[c] for c in ("grp", "island", "uids", "lengths", "pop")})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("grp", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int32())), ("pop", pa.list_(pa.list_(pa.int32())))]))

    return state.mapInArrow(run, _STATE)


def _migrated(state: DataFrame, islands: int) -> DataFrame:
    """Each island's elite goes to the next one of its group, in place of its last."""
    elite = state.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("pop")[0].alias("elite"))
    return (state.join(elite, ["grp", "island"])
            .select("grp", "island", "uids", "lengths", F.concat(
                F.slice("pop", 1, F.greatest(F.size("pop") - 1, F.lit(1))), F.array("elite")).alias("pop")))


def _solve(parts: DataFrame, n: int, round_no: int, capacity: int, group_size: int, islands: int,
           population: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """``uid, grp, bin, fill, offset`` of ``n`` pieces ``(uid, length)``."""
    groups = max(1, -(-n // group_size))
    state = (parts.groupBy(F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)).alias("grp"))
             .agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("n"), "uid"))).alias("p"))
             .select("grp", F.col("p.uid").alias("uids"), F.transform("p", lambda x: (-x["n"]).cast("int")).alias("lengths"))
             .select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uids", "lengths",
                     F.lit(None).cast("array<array<int>>").alias("pop")))
    width = max(1, min(groups * islands, 2000))
    for epoch in range(epochs):
        if epoch:
            state = _migrated(state, islands)
        state = stage_table(_epoch(state.repartition(width, "grp", "island"), capacity, population, generations, epoch, seed),
                            "islands")
    # the best island of each group, by number of bins, then by island
    best = (state.groupBy("grp").agg(F.min(F.struct(F.array_max(F.col("pop")[0]).alias("n"), "island")).alias("b"))
            .select("grp", F.col("b.island").alias("island")))
    chosen = (state.join(best, ["grp", "island"])
              .select("grp", F.explode(F.arrays_zip("uids", "lengths", F.col("pop")[0].alias("bin"))).alias("x"))
              .select("grp", F.col("x.uids").alias("uid"), F.col("x.lengths").alias("length"), F.col("x.bin").alias("bin")))
    own = Window.partitionBy("grp", "bin")  # a bin has at most ``capacity`` pieces
    before = own.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return chosen.select("uid", "length", "grp", "bin", F.sum("length").over(own).alias("fill"),
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack(parts: DataFrame, *, capacity: int = CAPACITY, group_size: int = 4096, islands: int = 2, population: int = 6,
         epochs: int = 2, generations: int = 15, rounds: int = 3, well_filled: float = 0.98, seed: int = 0) -> DataFrame:
    """``parts`` (``uid, ..., length``) with ``sequence_id`` and ``offset``.

    Every piece is placed once, no sequence holds more than ``capacity``, and
    the pieces of a sequence follow each other from offset 0 without gaps.
    Lengths must be 1 to ``capacity``.  An empty table gives an empty result.
    """
    parts = stage_table(parts, "pieces")
    full = parts.filter(F.col("length") >= capacity).select(
        "uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    todo = parts.filter(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"))
    for r in range(rounds):
        n = todo.count()
        if n == 0:
            break
        solved = stage_table(_solve(todo, n, r, capacity, group_size, islands, population, epochs, generations, seed + r), "packed")
        last = r == rounds - 1 or n <= group_size
        kept = solved if last else solved.filter(F.col("fill") >= int(well_filled * capacity))
        # ids of other rounds and of full pieces never meet: theirs are not negative
        done.append(kept.select("uid", (-1 - (F.lit(r) * (1 << 58) + F.col("grp") * (1 << 24) + F.col("bin"))).alias("sequence_id"),
                                "offset"))
        if last:
            break
        todo = solved.filter(F.col("fill") < int(well_filled * capacity)).select("uid", "length")
    places = done[0]
    for d in done[1:]:
        places = places.unionByName(d)
    return parts.join(places, "uid")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text",
                   **options) -> DataFrame:
    """Pack whole documents: ``key, piece, start, length, ids_crc32,
    sequence_id, offset`` per piece.  Null and empty texts are one end id;
    repeated rows and null keys are packed row by row; other columns are
    ignored; an empty table gives an empty result."""
    packed = pack(pieces(docs, tokenizer, capacity=capacity, key=key, text=text), capacity=capacity, **options)
    return packed.select(F.col("__key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
