"""Packing as a cutting-stock problem solved by column generation.

Documents become token ids plus an end id.  Whole sequences of long documents are cut
off; what is left of each document, and short ones, are items of a length below
the capacity.  Only the histogram of lengths, at most ``capacity - 1`` numbers, reaches
the driver:

* a pattern is a multiset of lengths that fills a sequence exactly.  A linear
  program over patterns says how often each is used, so that as few tokens as can be
  are in items that patterns leave over or lack.  Left-over items are the *run*:
  they are laid end to end and cut;
* the program starts with every item in the run, and its first columns are the patterns
  of a greedy exact fill.  Then a knapsack dynamic program over totals prices columns
  with the dual values; the best pattern and others drawn near it, which start with
  lengths that are left over, go in by pivots of the revised simplex method, until no
  pattern is worth it or what is left is small;
* the solution is rounded down, as it is and by a share of each pattern that leaves
  more to choose from; a bounded knapsack fills further sequences exactly from what
  rounding left.  Of these and the greedy fill the one with the fewest tokens left is
  used, and the rest is the run.

Items get ranks within their length: every task numbers its own, and running sums
over the counts of (task, length) make the numbers global, so that a frequent length is
never in one task.  A pattern's copies own ranges of ranks, and the place of an
item follows from its length and rank by arithmetic.  The run's last sequence is cut
into powers of two, so nothing is padded at all; what the program saves is cuts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import batches, fill_exactly
from lexlab.llm.tokens import byte_level
from lexlab.session import stage_table

CAPACITY = 1024
MAX_PIVOTS = 4_000  # bounds the driver's work; every basis on the way is a valid solution
SHARES = (1.0, 0.8, 0.6)  # of the program's solution that are rounded down
GAP = 0.005  # share of the tokens that patterns leave over or lack, below which the program ends


# ---- the linear program --------------------------------------------------------------
def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``best[t]``: the highest value of a multiset of lengths with total ``t``
    (-inf if there is none); ``last[t]``: the index of a length in it."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1, np.int64)
    best[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for t in range(1, capacity + 1):
        k = upto[t]
        if k:
            got = values[:k] + best[t - lengths[:k]]
            i = int(got.argmax())
            best[t], last[t] = got[i], i if got[i] > -np.inf else -1
    return best, last


def _pattern(t: int, lengths: np.ndarray, last: np.ndarray) -> tuple[int, ...]:
    """The indices of the lengths of the best multiset of total ``t``, sorted."""
    out = []
    while t > 0:
        out.append(int(last[t]))
        t -= int(lengths[last[t]])
    return tuple(sorted(out))


@dataclass
class Solution:
    """Patterns (tuples of indices of lengths) and how often each is used; ``duals``,
    and as ``cost`` the tokens that patterns leave over or lack."""
    patterns: list[tuple[int, ...]]
    times: np.ndarray
    duals: np.ndarray
    cost: float
    pivots: int


def _draw(rng, lengths, duals, best, first: int, weight: np.ndarray, near: float, capacity: int) -> tuple[int, ...] | None:
    """A full pattern that holds the length ``first`` and whose value is at most
    ``near`` a token below the best one's; lengths are drawn by weight."""
    out, t = [first], capacity - int(lengths[first])
    while t > 0:
        if best[t] == -np.inf:
            return None
        k = np.searchsorted(lengths, t, side="right")
        good = np.flatnonzero(duals[:k] + best[t - lengths[:k]] >= best[t] - near * t - 1e-9)
        run = np.cumsum(weight[good])
        out.append(int(good[min(np.searchsorted(run, rng.random() * run[-1]), len(good) - 1)]))
        t -= int(lengths[out[-1]])
    return tuple(sorted(out))


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, *, max_pivots: int = MAX_PIVOTS, gap: float = GAP,
          pool: int = 60, near: float = 0.2, seed: int = 0, first: Sequence[tuple[int, ...]] = ()) -> Solution:
    """Column generation for sorted distinct ``lengths`` below the capacity;
    ``first`` are patterns to begin with.

    Minimises ``sum length * (over + lack)`` where ``pattern uses + over - lack =
    demand``, all non-negative; so the dual of a length is between plus and minus
    itself, and a pattern is worth its pivot if the duals of its items add up to
    more than 0."""
    m, tokens, eps = len(lengths), float(lengths @ demand), 1e-6
    inverse, x, cost, duals = np.eye(m), demand.astype(float), lengths.astype(float), lengths.astype(float)
    basis: list[tuple[str, object]] = [("over", i) for i in range(m)]
    rng, pivots = np.random.default_rng(seed), 0
    given = set(first)
    while pivots < max_pivots and float(cost @ x) > gap * tokens:
        best, last = knapsack(lengths, duals, capacity)
        over = np.zeros(m)
        for b, n in zip(basis, x):
            if b[0] == "over":
                over[b[1]] = n
        weight = over + 1e-6 * demand
        found = {_pattern(capacity, lengths, last)} if best[capacity] > eps else set()
        if given:
            found = given
        elif found:
            share = weight * lengths
            found |= {_draw(rng, lengths, duals, best, int(i), weight, near, capacity)
                      for i in rng.choice(m, size=pool, p=share / share.sum())} - {None}
        patterns = sorted(found)
        columns = np.zeros((len(patterns), m))
        for j, p in enumerate(patterns):
            np.add.at(columns[j], list(p), 1.0)
        reduced, worth, before = -(columns @ duals), eps if given else max(eps, float(best[capacity]) / 2), pivots
        while pivots < max_pivots:
            i, k = int((duals - lengths).argmax()), int((-lengths - duals).argmax())
            change, name = min([(float(lengths[i] - duals[i]), ("over", i)), (float(lengths[k] + duals[k]), ("lack", k)),
                                *((float(reduced[j]), ("pattern", j)) for j in ([int(reduced.argmin())] if patterns else []))])
            if change > -eps or name[0] == "pattern" and change > -worth:
                break
            if name[0] == "pattern":
                held = np.array(sorted(set(patterns[name[1]])))
                step, price, name = inverse[:, held] @ columns[name[1], held], 0.0, ("pattern", patterns[name[1]])
            else:
                step, price = inverse[:, name[1]] * (1 if name[0] == "over" else -1), float(lengths[name[1]])
            up = np.flatnonzero(step > 1e-9)
            ratio = x[up] / step[up]
            least = up[ratio <= ratio.min() + 1e-12]
            r = int(least[step[least].argmax()])
            theta = x[r] / step[r]
            x -= theta * step
            x[r] = theta
            np.maximum(x, 0, out=x)
            row = inverse[r] / step[r]
            step[r] = 0.0
            rows, filled = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
            if 2 * len(filled) < m:
                inverse[np.ix_(rows, filled)] -= step[rows, None] * row[filled]
            else:
                inverse[rows] -= step[rows, None] * row
            inverse[r] = row
            duals = duals + change * row
            reduced = reduced - change * (columns @ row)
            basis[r], cost[r] = name, price
            pivots += 1
        duals = cost @ inverse  # afresh, against rounding
        if pivots == before and not given:
            break
        given = set()
    used = [i for i in range(m) if basis[i][0] == "pattern" and x[i] > 1e-9]
    return Solution([basis[i][1] for i in used], x[used], duals, float(cost @ x), pivots)


# ---- whole numbers -----------------------------------------------------------------------
def round_down(lengths: np.ndarray, demand: np.ndarray, solution: Solution, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a pattern, times)``, in whole numbers that the demand covers."""
    left, out = demand.astype(np.int64).copy(), {}
    for k in np.argsort(-solution.times, kind="stable").tolist():
        p = solution.patterns[k]
        n = min(int(solution.times[k] + 1e-6), *(int(left[i]) // p.count(i) for i in set(p)))
        if n:
            out[tuple(int(lengths[i]) for i in p)] = n
            np.subtract.at(left, list(p), n)
    counts = {int(s): int(n) for s, n in zip(lengths, left) if n}
    for must in sorted(counts, reverse=True):
        while counts.get(must) and (got := fill_exactly(counts, capacity, must)):
            n = min(counts[s] // got.count(s) for s in set(got))
            key = tuple(sorted(got))
            out[key] = out.get(key, 0) + n
            for s in set(got):
                counts[s] -= n * got.count(s)
                if not counts[s]:
                    del counts[s]
    return sorted(out.items())


def whole_solution(lengths: np.ndarray, demand: np.ndarray, capacity: int, max_pivots: int = MAX_PIVOTS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and times that leave few tokens: the greedy fill, the program that
    begins with its patterns, and the best of what they give in whole numbers."""
    none = Solution([], np.zeros(0), np.zeros(len(lengths)), 0.0, 0)
    greedy = round_down(lengths, demand, none, capacity)
    index = {int(n): i for i, n in enumerate(lengths)}
    solved = solve(lengths, demand, capacity, max_pivots=max_pivots, first=[tuple(sorted(index[n] for n in p)) for p, _ in greedy])
    tries = [round_down(lengths, demand, replace(solved, times=solved.times * share), capacity) for share in SHARES]
    return max([*tries, greedy], key=lambda patterns: sum(times for _, times in patterns))


# ---- places ---------------------------------------------------------------------------------
@dataclass
class Places:
    """Where an item of a length and a rank goes; sized by the patterns, not the table."""
    capacity: int
    keys: np.ndarray  # length << 40 | first rank of the range, sorted
    size: np.ndarray  # ranks in the range
    each: np.ndarray  # items of the length in a copy of the pattern
    sequence: np.ndarray  # of the first copy
    offset: np.ndarray  # of the first item of the length in a copy
    taken: np.ndarray  # by length: ranks that patterns own
    run_start: np.ndarray  # by length: where its items begin in the run
    n_patterns: int  # sequences made by patterns
    run_total: int

    def ends(self) -> np.ndarray:
        """Ends of the sequences of the run's last, incomplete stretch."""
        tail = self.run_total % self.capacity
        return np.cumsum([1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1])


def places(demand: dict[int, int], patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> Places:
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in patterns:
        at = 0
        for s in sorted(set(lengths)):
            k = lengths.count(s)
            rows.append((s << 40 | int(taken[s]), k * times, k, sequence, at))
            taken[s] += k * times
            at += k * s
        sequence += times
    left = np.zeros(capacity + 1, np.int64)
    for s, n in demand.items():
        left[s] = n - taken[s]
    tokens = left * np.arange(capacity + 1)
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Places(capacity, *columns, taken, np.cumsum(tokens) - tokens, sequence, int(tokens.sum()))


def place(at: Places, length: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each item its parts ``(first id, length, sequence, offset)``; only items of
    the run may have several."""
    out: list = [None] * len(length)
    found = np.searchsorted(at.keys, length << 40 | rank, side="right") - 1
    owned = rank < at.taken[length]
    within = rank[owned] - (at.keys[found[owned]] & (1 << 40) - 1)
    each = at.each[found[owned]]
    seq, off = at.sequence[found[owned]] + within // each, at.offset[found[owned]] + within % each * length[owned]
    for i, s, o in zip(np.flatnonzero(owned).tolist(), seq.tolist(), off.tolist()):
        out[i] = [(0, int(length[i]), s, o)]
    whole, c = at.run_total // at.capacity, at.capacity
    tail = [0, *at.ends().tolist()]
    for i in np.flatnonzero(~owned).tolist():
        n = int(length[i])
        p = int(at.run_start[n] + (rank[i] - at.taken[n]) * n)
        parts, done = [], 0
        while done < n:
            if p < whole * c:
                s, o, end = p // c, p % c, (p // c + 1) * c
            else:
                k = int(np.searchsorted(tail, p - whole * c, side="right")) - 1
                s, o, end = whole + k, p - whole * c - tail[k], whole * c + tail[k + 1]
            size = min(n - done, end - p)
            parts.append((done, size, at.n_patterns + s, o))
            done, p = done + size, p + size
        out[i] = parts
    return out


# ---- documents ---------------------------------------------------------------------------------
def items(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``key, start, length, doc_tokens, part, rank, ids``: every document cut
    at multiples of the capacity; ``rank`` counts a task's items of a length."""
    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([src.schema["__key"]] + [T.StructField(c, T.LongType()) for c in
                          ("start", "length", "doc_tokens", "part", "rank")] + [T.StructField("ids", T.BinaryType())])

    def run(frames):
        enc, part, seen = byte_level(tokenizer, False), TaskContext.get().partitionId(), [0] * (capacity + 1)
        kind = np.uint16 if max(enc.bytes_of) < 1 << 16 and end_id < 1 << 16 else np.uint32
        for batch in batches(frames):
            rows, of = [], []
            for i, body in enumerate(batch.column(1)):
                ids = np.append(enc.ids(body.as_py() or ""), np.uint32(end_id)).astype(kind)
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    n = len(piece)
                    rows.append((start, n, len(ids), part, seen[n], piece.tobytes()))
                    seen[n] += 1
                    of.append(i)
            *numbers, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in numbers), pa.array(ids, pa.binary())],
                names=schema.names)

    return src.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id",
                   text: str = "text", max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``key, start, length, doc_tokens, sequence_id, offset, ids`` per piece;
    ``ids`` are little-endian unsigned 32-bit numbers.

    Each id lies in one piece; the pieces of a sequence follow each other from
    offset 0; every sequence holds ``capacity`` ids or a power of two of them, so none is
    padded.  Null and empty texts are one end id; repeated rows and null keys are
    packed row by row; other columns are ignored; an empty table gives an empty
    result."""
    table = stage_table(items(docs, tokenizer, capacity=capacity, end_id=end_id, key=key, text=text), "items")
    short = table.filter(F.col("length") < capacity)
    counts = stage_table(short.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "item-counts")
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below the capacity
    lengths = np.array(sorted(demand), np.int64)
    numbers = np.array([demand[n] for n in lengths.tolist()], np.int64)
    patterns = whole_solution(lengths, numbers, capacity, max_pivots)
    at = places(demand, patterns, capacity)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = (short.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
              .select(table.columns))
    schema = T.StructType([table.schema["__key"]] + [T.StructField(c, T.LongType()) for c in
                          ("start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])

    def run(frames):
        for batch in batches(frames):
            start, length, doc_tokens, part, rank = (c.to_numpy() for c in batch.columns[1:6])
            width = len(batch.column(6)[0].as_py()) // int(length[0])
            parts = [[(0, capacity, -1 - (p << 34 | r), 0)] for p, r in zip(part.tolist(), rank.tolist())]
            items = np.flatnonzero(length < capacity)
            for i, got in zip(items.tolist(), place(at, length[items], rank[items])):
                parts[i] = got
            rows, of = [], []
            for i, (body, got) in enumerate(zip(batch.column(6), parts)):
                ids = np.frombuffer(body.as_py(), f"<u{width}").astype("<u4").tobytes()
                for first, n, sequence, offset in got:
                    rows.append((int(start[i]) + first, n, int(doc_tokens[i]), sequence, offset, ids[4 * first:4 * (first + n)]))
                    of.append(i)
            *numbers, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in numbers), pa.array(ids, pa.binary())],
                names=schema.names)

    packed = table.filter(F.col("length") == capacity).unionByName(ranked).mapInArrow(run, schema)
    return packed.withColumnRenamed("__key", key)
