"""Chosen-path join: against all pairs, classes, copies and edge cases."""

import random
import re
import time

from pyspark.sql import functions as F

from lexlab.llm import jaccard as J
from lexlab.llm.decontaminate import WORD
from lexlab.session import forget_shuffles
from tests.conftest import SF_SMALL


def shingles(t, k=5):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset([("no words", t or "")])
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n, up, link = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                link[i] += 1
                link[j] += 1
                a, b = root(i), root(j)
                up[max(a, b, key=lambda x: (rows[x][0], x))] = min(a, b, key=lambda x: (rows[x][0], x))
    least = {}
    for i in range(n):
        r = root(i)
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return {(rows[i][0], least[root(i)], link[i]) for i in range(n)}


def near_copies(rng, n_words, n, edits):
    base = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n_words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n_words)] = "".join(rng.choices("qrstuvwxyz", k=5))
        yield " ".join(w)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, nid int, bucket string")


def got(df):
    return {(r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()}


def test_runs_reach_the_recall():
    for depth in (1, 2, 3):
        p = (1 - 2.718281828 ** -1) ** depth
        n = J.runs_for(0.99, depth)
        assert 1 - (1 - p) ** n >= 0.99 > 1 - (1 - p) ** (n - 1)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    res = J.jaccard_classes(docs.repartition(3), recall=0.9999)
    assert got(res) == brute(rows)
    stay = J.one_of_each(docs, recall=0.9999)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.collect()} == {c for _, c, _ in brute(rows)}


def test_large_groups_in_blocks(spark):
    rng = random.Random(4)
    texts = list(near_copies(rng, 120, 70, 5)) + list(near_copies(rng, 60, 30, 2)) + list(near_copies(rng, 300, 12, 12))
    texts += texts[:10] + [f"alone {i} " + " ".join("".join(rng.choices("abcxyz", k=6)) for _ in range(30)) for i in range(20)]
    passage = " ".join("".join(rng.choices("klmn", k=6)) for _ in range(60))
    texts += [passage + " " + " ".join("".join(rng.choices("opqr", k=6)) for _ in range(40)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = frame(spark, rows)
    want = brute(rows)
    assert got(J.jaccard_classes(df, recall=0.99999, limit=8, block=8)) == want
    assert got(J.jaccard_classes(df, recall=0.99999, limit=6, block=16, depth=3)) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, ""), (4, "..."), (5, "one"), (6, "One!"), (7, "one two"), (8, "one two three four five six"),
            (9, "ONE two, three four five six"), (10, "w " * 150_000), (11, "w w w w w w"), (12, "é 中文 x y z"), (13, "é 中文 x y z")]
    assert got(J.jaccard_classes(frame(spark, rows))) == brute(rows)
    twice = frame(spark, [(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (2, "x y z")])
    res = J.jaccard_classes(twice).collect()
    assert len(res) == 5 and sorted(r["n_links"] for r in res) == [0, 3, 3, 3, 3]
    assert [r["class_id"] for r in res if r["doc_id"] == 1] == [None] * 3
    assert J.one_of_each(twice).count() == 2
    assert J.one_of_each(frame(spark, [(1, "a b c d e f")] * 3)).count() == 1
    assert J.jaccard_classes(twice.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    res = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            if up[a] != m or up[b] != m:
                up[a] = up[b] = m
                changed = True
    assert res == {n: r for n, r in up.items() if n != r}
    assert J.components(spark.range(0).select(F.col("id").alias("hi"), F.col("id").alias("lo"))).count() == 0


def test_recall_as_shipped(spark):
    """Pairs about the threshold, with the default parameters, against all pairs."""
    rng = random.Random(11)
    rows = [(d, t) for d, t in enumerate(t for _ in range(400) for t in near_copies(rng, 150, 3, 4))]
    want = brute(rows)
    found = got(J.jaccard_classes(frame(spark, rows)))
    links = {d: n for d, _, n in want}
    assert all(n <= links[d] for d, _, n in found)
    total, hit = sum(links.values()), sum(n for _, _, n in found)
    assert total > 1_000 and hit >= J.RECALL * total, (hit, total)


def test_shuffles_of_finished_jobs_go(spark, monkeypatch):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    assert spark.range(1000).repartition(50, "id").groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    before = blocks.getAllFiles().size()
    forget_shuffles(spark)
    for _ in range(40):
        if blocks.getAllFiles().size() < before:
            break
        time.sleep(0.5)
    assert blocks.getAllFiles().size() < before
    calls = []
    monkeypatch.setattr(J, "forget_shuffles", calls.append)
    J.one_of_each(spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")).count()
    assert len(calls) == 2  # before the texts are read, and before the sets are dealt to their tasks
