"""Packing: whole and gapless, against the tokenizer and the least number of sequences."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexlab.llm import packing as K
from lexlab.llm import tokens
from lexlab.llm.tokens import Encoder
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers_own(tok):
    enc = Encoder(PATH)
    assert enc.by_chunk
    rng = random.Random(3)
    alphabet = list("abcXYZ 0129'’.,;-\n\t\r ÀéßÿªºµſKİΣςσ中文😀́̈\x1c\x1f\x85<|>") + ["'s", "<|endoftext|>", "  ", "don't"]
    texts = ["", " ", "Hello <|endoftext|> x<|startoftext|>", "ΟΔΟΣ ΣΑΣ", "é ́a", "it's DON'T"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def own_ids(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("ranked", [True, False])
def test_columns_are_encoded_row_by_row(tok, ranked):
    enc = Encoder(PATH)
    assert enc.ranked is not None
    if not ranked:
        enc.ranked = None
    texts = ["left out", None, "", "It's 2024, don't\n\nPANIC!", " ", "ÀÉ ß 中文 中文", "x" * 500 + " <|endoftext|>", "\n", "it's"]
    for kind in (pa.string(), pa.large_string()):
        got = enc.encode_all(pa.array(texts, kind).slice(1)).to_pylist()
        assert got == [own_ids(tok, t) for t in texts[1:]]
        for some in ([], [None], ["", ""], ["中"], ["y" * 100]):
            assert enc.encode_all(pa.array(some, kind)).to_pylist() == [own_ids(tok, t) for t in some]


def test_words_encoded_together_are_the_tokenizers_own(tok):
    rng, enc = random.Random(9), Encoder(PATH)
    known = [w.removesuffix("</w>") for w in tok.get_vocab()]
    known = sorted(w for w in known if w.isascii() and w.isalpha())
    words = known + ["".join(rng.choices(known, k=rng.randint(2, 4))) for _ in range(20000)]
    words += ["".join(rng.choices("aeioußäöüéèçñthrsn", k=rng.randint(1, 20))) for _ in range(20000)]
    words = list(dict.fromkeys(w.lower() for w in words if len(w) < tokens.LONG))
    got = enc.encode_all(pa.array(words)).to_pylist()
    assert [w for w, g in zip(words, got) if g != own_ids(tok, w)] == []


class Counted:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, w):
        self.calls += 1
        return self.model.tokenize(w)


def test_new_words_are_not_encoded_one_by_one():
    rng, enc = random.Random(10), Encoder(PATH)
    enc.model = Counted(enc.model)
    words = ["".join(rng.choices("abcdefgh", k=12)) for _ in range(5000)]
    assert all(enc.encode_all(pa.array([" ".join(words), "z" * 100 + ", " + words[0]])).to_pylist())
    assert enc.model.calls == 1  # the long word


def test_kept_words_in_use_stay_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 20)
    enc = Encoder(PATH)
    enc.ranked, enc.model = None, Counted(enc.model)
    for i in range(300):
        enc.encode_all(pa.array(["used again", "a" * (i % 60 + 1) + "b" * (i // 60)]))
    assert enc.model.calls <= 302
    assert len(enc.words) + len(enc.words.older) <= 20


def check(rows, capacity=2048):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= capacity
    return len(seqs), sum(r["length"] for r in rows)


def test_whole_table(spark, tok):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = K.pack_documents(docs, PATH).collect()
    n, total = check(rows)
    least = -(-total // 2048)
    assert n <= least * 1.02 + 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = tok.encode(d["text"], add_special_tokens=False).ids + [0]
        got = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // 2048)))
        for r in got:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert sum(r["length"] for r in got) == len(ids)


def test_edges(spark):
    schema = "doc_id long, text string, uid string, length int"
    data = [(1, None), (2, ""), (3, "word " * 9000), (None, "a b"), (4, "same"), (4, "same"), (5, "x " * 2047), (6, "x " * 2048)]
    df = spark.createDataFrame([(a, b, "u", 0) for a, b in data], schema)
    rows = K.pack_documents(df, PATH, group_size=3).collect()
    check(rows)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1]
    assert [r["length"] for r in rows if r["doc_id"] == 5] == [2048]
    assert sorted(r["length"] for r in rows if r["doc_id"] == 6) == [1, 2048]
    assert len([r for r in rows if r["doc_id"] == 4]) == 2
    assert K.pack_documents(df.limit(0), PATH).count() == 0


def test_many_groups_and_rounds(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(1, 1500)) for i in range(3000)], "uid long, length long")
    rows = K.pack(df, group_size=300).collect()
    assert sorted(r["uid"] for r in rows) == list(range(3000))
    n, total = check(rows)
    assert n <= -(-total // 2048) * 1.01 + 2


def test_crossover_keeps_a_solution_and_never_loses():
    rng = random.Random(7)
    lengths = np.array([rng.randint(200, 1100) for _ in range(400)], np.int64)
    pop = K.first_population(lengths, 2048, 4, rng)
    for _ in range(20):
        child = K.crossover(pop[0], pop[1 + rng.randrange(3)], lengths, 2048, rng)
        fill = np.bincount(child, weights=lengths)
        assert child.min() >= 0 and fill.max() <= 2048 and fill.min() > 0
    before = K.fitness(lengths, pop[0], 2048)
    assert K.fitness(lengths, K.evolve(lengths, pop, 2048, 20, rng)[0], 2048) <= before


def least_bins(lengths, capacity):
    """The exact least number of bins, over all subsets."""
    n = len(lengths)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)  # bins closed, fill of the open one
    for mask in range(1 << n):
        closed, fill = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                nxt = (closed, fill + lengths[i]) if fill + lengths[i] <= capacity else (closed + 1, lengths[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], nxt)
    return best[-1][0] + (best[-1][1] > 0)


def hard_cases(count):
    """Small cases for which best fit by falling length needs too many bins."""
    rng, out = random.Random(11), []
    while len(out) < count:
        lengths = np.array([rng.randint(6, 30) for _ in range(rng.randint(9, 12))], np.int64)
        plain = K.first_population(lengths, 60, 1, rng)[0]
        least = least_bins(lengths.tolist(), 60)
        if plain.max() + 1 > least:
            out.append((lengths, least))
    return out


def test_search_reaches_the_exact_least_where_best_fit_does_not():
    cases = hard_cases(25)
    solved = {}
    for name, options in (("none", {"crossing": False, "mutating": False}), ("crossover", {"mutating": False}),
                          ("mutation", {"crossing": False}), ("both", {})):
        solved[name] = 0
        for seed, (lengths, least) in enumerate(cases):
            rng = random.Random(seed)
            first = [K.first_population(lengths, 60, 1, rng)[0]] * 3 if name == "none" else K.first_population(lengths, 60, 6, rng)
            best = K.evolve(lengths, first, 60, 30, rng, n_bins=3, **options)[0]
            assert np.bincount(best, weights=lengths).max() <= 60
            solved[name] += int(best.max()) + 1 == least
    assert solved["none"] == 0 and solved["crossover"] > 0 and solved["mutation"] > 0
    assert solved["both"] == len(cases)


def test_each_part_gathers_room_in_fewer_bins():
    rng = random.Random(8)
    lengths = np.array([rng.randint(60, 1500) for _ in range(600)], np.int64)
    value = {}
    for name, options in (("none", {"crossing": False, "mutating": False}), ("crossover", {"mutating": False}), ("both", {})):
        pop = K.first_population(lengths, 2048, 6, random.Random(1))
        value[name] = K.fitness(lengths, K.evolve(lengths, pop, 2048, 40, random.Random(2), **options)[0], 2048)
    assert value["both"] < value["crossover"] < value["none"]


def test_elites_migrate(spark):
    lengths = [random.Random(4).randint(100, 1400) for _ in range(200)]
    good = K.evolve(np.array(lengths, np.int64), K.first_population(np.array(lengths, np.int64), 2048, 6, random.Random(0)), 2048, 60, random.Random(0))[0]
    poor = K.first_population(np.array(lengths, np.int64), 2048, 2, random.Random(3))[1]
    rows = [(0, i, list(range(200)), lengths, [p.tolist()] * 2) for i, p in enumerate((good, poor))]
    state = spark.createDataFrame(rows, K._STATE)
    moved = {r["island"]: r["pop"] for r in K._migrated(state, 2).collect()}
    assert moved[1] == [poor.tolist(), good.tolist()] and moved[0] == [good.tolist(), poor.tolist()]
    out = {r["island"]: r["pop"][0] for r in K._epoch(K._migrated(state, 2), 2048, 2, 0, 1, 0).collect()}
    assert K.fitness(np.array(lengths), np.array(out[1]), 2048) == K.fitness(np.array(lengths), good, 2048)


def test_whole_table_needs_no_more_than_best_fit_over_all_pieces(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    parts = K.pieces(docs, PATH).select("uid", "length")
    from lexlab.session import stage_table
    parts = stage_table(parts, "lengths")
    lengths = np.array([r["length"] for r in parts.collect()], np.int64)
    assign = np.zeros(len(lengths), np.int64)
    plain = K.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), assign, K.Bins(2048), 0)
    n, total = check(K.pack(parts).collect())
    assert n <= plain and n == -(-total // 2048)
