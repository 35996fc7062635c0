"""Positive-unlabelled classifier: held-out accuracy, the risk, and edge cases."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexlab.llm import common as C
from lexlab.llm import jaccard as J
from lexlab.llm import quality as Q
from tests.conftest import SF_MID, SF_SMALL


def tables(spark, sf):
    return (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    rows = Q.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.97
    assert sum(1 - r["predicted"] for r in bad) / len(bad) > 0.9


def test_rows_fold_and_scores(spark):
    docs, labels = tables(spark, SF_MID)
    out = Q.classify(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_and_bad_marks_are_not_learned_from(spark):
    docs, labels = tables(spark, SF_SMALL)
    base, table = Q.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = Q.fit(Q.training_rows(table, flipped))
    assert np.allclose(base.weights, other.weights) and base.prior == other.prior
    assert Q.training_rows(table, labels).count() == sum(
        1 for r in docs.join(labels, "doc_id", "left").collect()
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] in (1, None))


def test_prior_and_risk_on_a_mixture(spark):
    rng = np.random.default_rng(0)
    d = Q.DIMENSIONS
    x = rng.normal(0, 1, (9000, d))
    good = np.r_[np.ones(3000, bool), rng.random(6000) < 0.7]
    x[good, 0] += 3
    x[~good, 0] -= 3
    rows = [(v.tolist(), bool(i < 3000)) for i, v in enumerate(x)]
    model = Q.fit(spark.createDataFrame(rows, "x array<float>, positive boolean"))
    assert 0.64 <= model.prior <= 0.78
    s = model.scores(x[3000:])
    assert ((s >= 0.5) == good[3000:]).mean() > 0.97
    fixed = Q.fit(spark.createDataFrame(rows, "x array<float>, positive boolean"), prior=0.95, steps=12)
    assert np.isfinite(fixed.weights).all()  # the bound is in force


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 300_000, "c"), (3, "same", "d"), (3, "same", "d"),
                                  (None, "words here", "e"), (6, "é 中文 \U0001f600", "f")], "doc_id long, text string, score string")
    out = Q.classify(docs, labels).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    assert Q.classify(docs, labels.limit(0)).filter("score != 0.5").count() == 0
    assert Q.classify(docs.limit(0), labels).count() == 0
    kept = Q.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 7
    x = Q.features(pa.array(["", None, "a b"]))
    assert not x[:2].any() and x[2].any()


def test_sums_of_a_pass_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, Q.DIMENSIONS)).astype(np.float32)
    pos = rng.random(500) < 0.3
    df = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, pos)], "x array<float>, positive boolean").repartition(23)
    got = Q._sums(df, 2 * Q.DIMENSIONS, lambda a, p: np.concatenate([a[p].sum(0), (a[~p] ** 2).sum(0)]))
    assert np.allclose(got, np.concatenate([x[pos].sum(0), (x[~pos].astype(float) ** 2).sum(0)]), rtol=1e-4)


def test_fit_stands_at_the_least_risk(spark):
    """A plain gradient check: no small step in any direction lowers the
    non-negative risk, written out here in NumPy, while its second part is above the bound."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (3000, Q.DIMENSIONS)).astype(np.float32).astype(float)
    good = np.r_[np.ones(1000, bool), rng.random(2000) < 0.6]
    x[good, 0] += 1
    x[~good, 0] -= 1
    pos = np.arange(3000) < 1000
    df = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, pos)], "x array<float>, positive boolean")
    model = Q.fit(df, ridge=1e-2, prior=0.6, steps=25)

    def risk(theta):
        z = np.hstack([np.clip((x - model.mean) / model.scale, -20, 20), np.ones((len(x), 1))]) @ theta
        s = 1 / (1 + np.exp(-z))
        rest = s[~pos].mean() - 0.6 * s[pos].mean()
        return 0.6 * (1 - s[pos].mean()) + max(rest, 0) + 0.5e-2 * (theta[:-1] ** 2).sum()

    theta = np.append(model.weights, model.bias)
    here, lower = risk(theta), 0.0
    for _ in range(200):
        way = rng.normal(0, 1, len(theta))
        lower = max(lower, here - risk(theta + 0.01 * way / np.linalg.norm(way)))
    assert lower < 2e-4 and here < risk(np.zeros(len(theta)))


class Task(Exception):
    """Holds the function that a query gives to ``mapInArrow``."""


@pytest.mark.parametrize("query", ["feature_table", "keep_good", "classes"])
def test_what_a_task_holds(spark, monkeypatch, query):
    def caught(self, run, schema):
        raise Task(run)

    docs = spark.createDataFrame([], "doc_id long, hash long, text string")
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "hash": [0] * 2000,
                                       "text": [" ".join(f"w{i * j % 977}" for j in range(600)) for i in range(2000)]})
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    monkeypatch.setattr(Q, "train", lambda *a, **k: (Q._unlearned(), None))
    with pytest.raises(Task) as made:
        {"feature_table": lambda: Q.feature_table(docs, "doc_id", "text"), "keep_good": lambda: Q.keep_good(docs, None),
         "classes": lambda: J.one_of_each(docs)}[query]()
    of = rows.select(["doc_id", "text"]) if query == "feature_table" else rows
    tracemalloc.start()
    try:
        for _ in made.value.args[0](iter([of])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 50e6  # 2 MB of text at once took more than 100 MB
    finally:
        tracemalloc.stop()


def test_freed_memory_goes_back_after_each_batch(monkeypatch):
    class Pool:
        calls = 0

        def release_unused(self):
            Pool.calls += 1

    rows = pa.RecordBatch.from_pydict({"text": ["a" * 100] * 50})
    monkeypatch.setattr(C.pa, "default_memory_pool", Pool)
    after = [Pool.calls for _ in C.batches([rows, rows.slice(0, 0), rows], 1000)]
    assert after == sorted(after) and after[0] == 0 and after[-1] == 1 and Pool.calls == 2


def test_slices_do_not_change_features():
    rows = pa.RecordBatch.from_pydict({"text": ["", None, "x" * 70_000, "A b\nc, d é 中", "w " * 40_000, "end"] * 3})
    whole = Q.features(rows.column(0))
    for n in (1, 1000, C.FINE):
        assert np.array_equal(np.vstack([Q.features(b.column(0)) for b in C.batches([rows], n)]), whole)
