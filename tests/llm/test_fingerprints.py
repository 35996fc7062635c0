"""Piecewise fingerprints: against a plain reading of the contract, and what edits do to them."""

import hashlib
import random

from pyspark.sql import functions as F

from lexlab.llm import fingerprints as P
from tests.conftest import SF_SMALL


def brute(rows):
    """(doc_id, n_chars, edited hash, fingerprints) by descending id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), P.fingerprint(t), P.fingerprint(e), P.fingerprint(nxt)))
    return sorted(out)


def cols(df):
    return sorted(tuple(r[c] for c in ("doc_id", *P._RESULT)) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = P.against_next(docs.repartition(3))
    assert cols(got) == brute(rows)
    stats = got.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"),
                    F.min("near_edited").alias("lo"), F.max("near_next").alias("hi")).collect()[0]
    assert stats["e"] > 0.5 and stats["n"] < 0.1 and 0 <= stats["lo"] and stats["hi"] <= 1


def test_edges(spark):
    schema = "doc_id long, text string, fingerprint string, edge int"
    rows = [(1, None), (2, ""), (3, "a"), (4, "\U0001f600é" * 5), (5, "ab " * 100_000), (6, "same text here"), (7, "same text here")]
    df = spark.createDataFrame([(a, b, "x", 9) for a, b in rows], schema)
    assert cols(P.against_next(df)) == brute(rows)
    assert cols(P.against_next(df.repartition(7))) == brute(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(df).collect()}
    assert prints[6] == prints[7] and prints[1] == prints[2] == "3::"
    assert P.against_next(df.limit(0)).count() == 0
    one = P.against_next(df.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    twice = spark.createDataFrame([(1, "x y z", "", 0)] * 3 + [(None, "n", "", 0)], schema)
    assert P.against_next(twice).count() == 4


def test_edits_touch_few_characters(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    base = " ".join(words)
    near = " ".join(words[:1500] + ["inserted"] + words[1500:])
    other = " ".join(rng.sample(words, len(words)))
    a, b, c = P.fingerprint(base), P.fingerprint(near), P.fingerprint(other)
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    r = df.select(P.likeness(F.col("a"), F.col("b")).alias("near"), P.likeness(F.col("a"), F.col("c")).alias("far"),
                  P.likeness(F.col("a"), F.col("a")).alias("same")).collect()[0]
    assert r["near"] > 0.85 and r["far"] < 0.4 and r["same"] == 1.0
