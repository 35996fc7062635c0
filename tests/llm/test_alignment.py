"""Cross-tokenizer alignment against a plain version over all documents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexlab.llm import alignment as A
from lexlab.llm import tokens as K
from tests.conftest import SF_SMALL

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTES = dict(zip([*map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])],
                 [*range(33, 127), *range(161, 173), *range(174, 256)]))
BYTES |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(BYTES.values())))}


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATH_B)


def plain(both, texts):
    """Measures of each text, by the contract's own words."""
    a, b = both
    name_a, rows, counts = {i: s for s, i in a.get_vocab().items()}, [], Counter()
    for text in texts:
        text = text or ""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(BYTES[c] for c in name_a[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                   for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append(None)
            continue
        ends = [{int(e): i for i, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (bytes_a, bytes_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids_a[ends[0][c]], ids_b[ends[1][c]]) for c in cuts]
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = ends[0][c] + 1, ends[1][c] + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b_id), n in counts.items():
        top[b_id] = max(top[b_id], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (*r[:3], len(r[3]), sum(counts[x] == top[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


def test_whole_table_against_the_plain_version(spark, both):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain(both, [r["text"] for r in rows])))
    got = A.align_documents(docs, PATH_A, PATH_B, block=50_000).collect()
    assert {r["doc_id"]: tuple(r[c] for c in A.MEASURES) for r in got} == want
    assert len(got) == len(rows)


def test_edges(spark, both):
    texts = [None, "", " ", "  two", "a  b \n c\n\n d", "▁ is a blank", "<|endoftext|> <s> </s> <0x41> <unk>", "same", "same",
             "same", "x" * 3000, "中文 \U0001f600\x00 tab\t", "\xa0 　 wide", "word " * 20_000, " " * 30_000 + "a",
             "caf\xe9 na\xefve don't DON'T 's", "\r\n \r\n", "́ mark"]
    data = [(i if i else None, t, 7, "sha") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, copies int, sha string")
    got = {r["doc_id"] or 0: tuple(r[c] for c in A.MEASURES) for r in A.align_documents(df, PATH_A, PATH_B).collect()}
    assert got == dict(enumerate(plain(both, texts)))
    assert A.align_documents(df.limit(0), PATH_A, PATH_B).count() == 0


def test_hot_and_rare_texts_count_all_their_copies(spark, both):
    texts = ["the hot text"] * 700 + [f"rare text {i % 1500}" for i in range(2100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in A.MEASURES) for r in A.align_documents(df, PATH_A, PATH_B, block=2000).collect()}
    assert got == dict(enumerate(plain(both, texts)))


def test_ids_are_the_tokenizers_own(both):
    a, b = both
    fast, pieces = K.ByteLevel(PATH_A, True), K.Pieces(PATH_B)
    assert fast.fast and pieces.by_slice
    special = K.ByteLevel(PATH_A, False)
    own = Tokenizer.from_file(PATH_A)
    rng = random.Random(1)
    alphabet = list("abXY 0129'.,;-\n\t\r ’\xc0\xe9\xdf中文\U0001f600́\x85\x1c 　<|>") + ["'s", "<|endoftext|>", "  "]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert fast.ids(t).tolist() == a.encode(t, add_special_tokens=False).ids
        assert special.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids
    long = "".join(rng.choices(alphabet, k=K.SLICE * 3))
    assert len(K.slices(long)) > 1 and " ".join(K.slices(long)) == long
    assert fast.ids(long).tolist() == a.encode(long, add_special_tokens=False).ids
    assert np.concatenate([pieces.ids(s) for s in K.slices(long)]).tolist() == b.encode(long)
    # a piece of the vocabulary is what its own merges give, so looking it up whole is the same
    level = {i: s for s, i in a.get_vocab(with_added_tokens=False).items()}
    assert all([t.id for t in a.model.tokenize(s)] == [i] for i, s in level.items())
