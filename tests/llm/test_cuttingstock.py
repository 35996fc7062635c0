"""Cutting-stock packing: the program against all patterns, placement, ids."""

import itertools
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexlab.llm import cuttingstock as C
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


def all_patterns(lengths, capacity):
    """Index tuples of every multiset that fills the capacity."""
    out = []
    def grow(first, picked, total):
        if total == capacity:
            out.append(tuple(picked))
        for i in range(first, len(lengths)):
            if total + lengths[i] <= capacity:
                grow(i, [*picked, i], total + lengths[i])
    grow(0, [], 0)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_program_is_solved_to_its_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 24, 32])
    lengths = np.array(sorted(rng.sample(range(2, capacity), 7)), np.int64)
    demand = np.array([rng.randint(1, 60) for _ in lengths], np.int64)
    got = C.solve(lengths, demand, capacity, gap=-1)
    # the duals are feasible, so they bound the cost of every solution from below; this one reaches it
    for p in all_patterns(lengths.tolist(), capacity):
        assert got.duals[list(p)].sum() <= 1e-5
    assert (np.abs(got.duals) <= lengths + 1e-5).all()
    assert abs(got.cost - float(got.duals @ demand)) < 1e-4
    used = np.zeros(len(lengths))
    for p, n in zip(got.patterns, got.times):
        np.add.at(used, list(p), n)
    assert abs(float(lengths @ np.abs(demand - used)) - got.cost) < 1e-4


def test_knapsack_against_all_multisets():
    lengths, values = np.array([2, 3, 7, 8]), np.array([0.3, 0.5, -0.2, 1.4])
    best, last = C.knapsack(lengths, values, 16)
    want = defaultdict(lambda: -np.inf)
    for counts in itertools.product(range(9), range(6), range(3), range(3)):
        t = int(np.dot(counts, lengths))
        want[t] = max(want[t], float(np.dot(counts, values)))
    assert all(abs(best[t] - want[t]) < 1e-9 if want[t] > -np.inf else best[t] == -np.inf for t in range(17))
    assert sum(lengths[i] for i in C._pattern(16, lengths, last)) == 16


def test_exact_fill_against_all_subsets():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 14) for _ in range(rng.randint(1, 8))]
        must = max(sizes)
        rest = list(sizes)
        rest.remove(must)
        can = any(sum(x) + must == 20 for k in range(len(rest) + 1) for x in itertools.combinations(rest, k))
        got = C.fill_exactly(dict(Counter(sizes)), 20, must)
        assert (got is not None) == can
        if got:
            assert sum(got) == 20 and must in got and not Counter(got) - Counter(sizes)


def cuts(patterns, demand):
    """Items that patterns leave to the run."""
    taken = Counter()
    for lengths, times in patterns:
        for s in lengths:
            taken[s] += times
    assert all(taken[s] <= n for s, n in demand.items()) and set(taken) <= set(demand)
    return sum(demand.values()) - sum(taken.values())


def test_columns_are_what_keeps_documents_whole():
    """The program's patterns alone, rounded down, take nearly all items; without
    its pivots there is none."""
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.lognormal(4.4, 0.7, 60_000).astype(int) % 200 + 1, return_counts=True)
    demand = dict(zip(lengths.tolist(), counts.tolist()))
    solution = C.solve(lengths, counts, 256)
    assert solution.cost <= C.GAP * float(lengths @ counts) and solution.pivots < C.MAX_PIVOTS
    whole = [(tuple(int(lengths[i]) for i in p), int(n)) for p, n in zip(solution.patterns, solution.times) if n >= 1]
    assert all(sum(p) == 256 for p, _ in whole)
    assert sum(len(p) * n for p, n in whole) > 0.95 * sum(demand.values())
    assert cuts(C.round_down(lengths, counts, solution, 256), demand) < 0.002 * sum(demand.values())
    none = C.solve(lengths, counts, 256, max_pivots=0)
    assert not none.patterns and none.cost == float(lengths @ counts)


def run_tokens(patterns, demand):
    left = dict(demand)
    for lengths, times in patterns:
        for s in lengths:
            left[s] -= times
    assert min(left.values()) >= 0
    return sum(s * n for s, n in left.items())


def test_the_program_leaves_less_than_the_greedy_fill_it_begins_with():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.concatenate([rng.integers(75, 105, 6000), rng.integers(30, 65, 4000)]), return_counts=True)
    demand = dict(zip(lengths.tolist(), counts.tolist()))
    greedy = C.round_down(lengths, counts, C.Solution([], np.zeros(0), np.zeros(len(lengths)), 0.0, 0), 256)
    best = C.whole_solution(lengths, counts, 256)
    assert run_tokens(best, demand) < 0.8 * run_tokens(greedy, demand)
    assert run_tokens(C.whole_solution(lengths, counts, 256, max_pivots=0), demand) == run_tokens(greedy, demand)


def check(rows, capacity=1024):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == capacity or at < capacity and at & (at - 1) == 0  # never padded
    return sequences


def same_ids(rows, texts, key="doc_id"):
    tok, by_doc = Tokenizer.from_file(PATH), defaultdict(list)
    for r in rows:
        by_doc[r[key]].append(r)
    for d, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[d], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in got) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r["start"] for r in got] == np.cumsum([0, *(r["length"] for r in got)])[:-1].tolist()
        assert {r["doc_tokens"] for r in got} == {len(ids)} and all(len(r["ids"]) == 4 * r["length"] for r in got)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = C.pack_documents(docs, PATH).collect()
    check(rows)
    same_ids(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    cut = sum(r["length"] < 1024 and r["start"] % 1024 > 0 for r in rows)  # parts after the first of an item
    shared = {r["sequence_id"] for r in rows if r["length"] < 1024}
    assert cut < 0.6 * len(shared)  # items laid end to end are cut once a sequence; 200 documents leave a tail of some ten parts


@pytest.mark.parametrize("capacity", [8, 13, 64])
def test_small_capacities_and_edges(spark, capacity):
    rng = random.Random(capacity)
    texts = {i: " ".join(rng.choices(["a", "bb", "ccc <|endoftext|>", "é中"], k=rng.randint(0, 40))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "word " * 3000, 303: " " * 30_000, 304: "x" * 5000}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, length int, part int").repartition(7)
    rows = C.pack_documents(df, PATH, capacity=capacity).collect()
    check(rows, capacity)
    same_ids(rows, texts)
    assert C.pack_documents(df.limit(0), PATH).count() == 0


def test_repeated_rows_and_one_length(spark):
    df = spark.createDataFrame([(1, "same text here")] * 500 + [(None, "a b")] * 3, "doc_id long, text string")
    rows = C.pack_documents(df, PATH, capacity=32).collect()
    check(rows, 32)
    assert sum(r["length"] for r in rows) == 500 * 4 + 3 * 3
