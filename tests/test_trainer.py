"""Trainer with a metric log, user metrics, sparse confusion."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlab.functions.exprs import py_unit
from lexlab.operators import metrics as M
from lexlab.operators import user_metric as U
from lexlab.plans import trainer as TR
from lexlab.session import scratch_path


def data(spark, n=300, d=6):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    split = np.where(np.arange(n) % 5 == 0, "validation", np.where(np.arange(n) % 5 == 1, "test", "train"))
    rows = [(i, str(s), int(c), [(k, float(v)) for k, v in enumerate(r)]) for i, (s, c, r) in enumerate(zip(split, y, x))]
    return x, y, split, spark.createDataFrame(rows, "doc_id long, split string, label int, feats array<struct<i:int,x:double>>").repartition(5)


def heads(**seeds):
    return {run: TR.LinearHead(seed, 3, 6) for run, seed in seeds.items()}


def refit(x, y, split, seed, epochs, classes=3):
    """The same optimiser in NumPy; weights after each pass."""
    train = split == "train"
    bucket = np.array([int(hashlib.md5(f"step:{i}".encode()).hexdigest()[:8], 16) % TR.STEPS for i in range(len(y))])
    counts = np.bincount(y[train], minlength=classes)
    share = train.sum() / (classes * counts)
    w = np.zeros((classes, x.shape[1] + 1))
    w[:, :-1] = [[TR.FIRST_SCALE * (py_unit(f"w:{seed}:{c}:{j}") - 0.5) for j in range(x.shape[1])] for c in range(classes)]
    v, full, out = np.zeros_like(w), np.c_[x, np.ones(len(x))], []
    for _ in range(epochs):
        for b in range(TR.STEPS):
            at = train & (bucket == b)
            z = full[at] @ w.T
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - np.eye(classes)[y[at]]) * share[y[at]][:, None]
            v = TR.MOMENTUM * v + err.T @ full[at] / share[y[at]].sum() + TR.DECAY * w
            w = w - TR.RATE * v
        out.append(w)
    return out, full


def f1(y, pred):
    out = []
    for c in sorted(set(y) | set(pred)):
        tp, p, s = ((y == c) & (pred == c)).sum(), (pred == c).sum(), (y == c).sum()
        out.append(2 * tp / (p + s))
    return float(np.mean(out))


def test_weights_equal_a_numpy_refit_and_the_best_pass_is_restored(spark):
    x, y, split, df = data(spark)
    got = TR.train(df, heads(a=1, b=2), scratch_path(spark, "trained"), epochs=4)
    log = {(r["run"], r["epoch"]): r for r in got.log.collect()}
    assert len(log) == 8
    for run, seed in (("a", 1), ("b", 2)):
        passes, full = refit(x, y, split, seed, 4)
        values = [f1(y[split == "validation"], (full @ w.T).argmax(1)[split == "validation"]) for w in passes]
        for e, (w, value) in enumerate(zip(passes, values), 1):
            stored = TR.restore(got.weights, {run: e}, heads(a=1, b=2))[run]
            assert np.allclose(stored, w, atol=1e-9)
            assert abs(log[run, e]["f1_macro"] - value) < 1e-6
        assert np.allclose(got.best[run], passes[int(np.argmax(np.round(values, 6)))], atol=1e-9)
        assert log[run, 4]["train_loss"] < log[run, 1]["train_loss"] and log[run, 1]["n_train"] == (split == "train").sum()


def test_rows_without_a_usable_label_and_empty_tables(spark):
    _, _, _, df = data(spark)
    odd = df.withColumn("label", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, -1)
                        .when(F.col("doc_id") % 13 == 0, 9).otherwise(F.col("label")))
    usable = df.filter("doc_id % 7 > 0 and doc_id % 11 > 0 and doc_id % 13 > 0")
    a, b = (TR.train(t, heads(r=1), scratch_path(spark, "odd"), epochs=1) for t in (odd, usable))
    assert np.allclose(a.best["r"], b.best["r"])
    none = TR.train(df.limit(0), heads(r=1), scratch_path(spark, "none"), epochs=1)
    assert none.best == {} and none.log.count() == 0


def own_metric():
    class Kept:
        """A metric of the test's own: the share of rows with label 0 that are not predicted 2."""

        def zero(self):
            return [0, 0]

        def update(self, state, label, pred, n):
            return [state[0] + (n if label == 0 and pred != 2 else 0), state[1] + (n if label == 0 else 0)]

        def merge(self, a, b):
            return [a[0] + b[0], a[1] + b[1]]

        def finish(self, state):
            return state[0] / state[1] if state[1] else None

    return Kept()  # a local class travels to the workers with the task


def test_a_users_metric_equals_sql_and_drives_the_trainer(spark):
    rows = [("g" if i % 2 else None, i % 4 if i % 9 else None, (i * 7) % 5 % 4) for i in range(500)] + [("only", None, 1)]
    preds = spark.createDataFrame(rows, "g string, label int, pred int").repartition(9)
    got = {r["g"]: r["kept"] for r in U.evaluate(preds, own_metric(), ["g"], "kept").collect()}
    preds.createOrReplaceTempView("own_metric_rows")
    want = {r["g"]: r["v"] for r in spark.sql(
        "SELECT g, sum(CASE WHEN label = 0 AND pred <> 2 THEN 1 END) / sum(CASE WHEN label = 0 THEN 1 END) AS v "
        "FROM own_metric_rows GROUP BY g").collect()}
    assert got == pytest.approx(want) and got["only"] is None
    macro = {r["g"]: r["m"] for r in U.evaluate(preds, U.MacroF1(), ["g"], "m").collect()}
    for r in M.macro_f1(M.confusion_cells(preds, ["g"]), ["g"]).collect():
        assert macro[r["g"]] == pytest.approx(r["macro_f1"], abs=1e-6)
    assert U.evaluate(preds.limit(0), own_metric()).count() == 0
    x, y, split, df = data(spark)
    trained = TR.train(df, heads(a=1), scratch_path(spark, "own"), epochs=2, metric=own_metric())
    passes, full = refit(x, y, split, 1, 2)
    held = (split == "validation") & (y == 0)
    for r in trained.log.collect():
        assert r["f1_macro"] == pytest.approx(((full @ passes[r["epoch"] - 1].T).argmax(1)[held] != 2).mean())


def test_sparse_confusion_with_many_classes(spark):
    n = 100_000
    preds = spark.range(n).select((F.col("id") % n).cast("int").alias("label"), ((F.col("id") * 3) % n).cast("int").alias("pred"))
    cells = M.confusion_cells(preds)
    assert cells.count() <= n
    per = M.per_class(M.with_domain(cells, n + 5))
    assert per.count() == n + 5 and per.filter("observed").count() == n
    hits = sum(1 for i in range(n) if (3 * i) % n == i)
    row = M.macro_f1(cells).first()
    assert row["n"] == n and row["accuracy"] == pytest.approx(hits / n, abs=1e-6)


def test_cells_and_grid_give_the_same_metrics(spark):
    preds = spark.createDataFrame([(i % 3, (i * i) % 3) for i in range(50)] + [(None, 1), (7, 2), (1, None)], "label int, pred int")
    a = M.classification_report(M.confusion_long(preds, 4), list("abcd")).collect()
    b = M.classification_report(M.with_domain(M.confusion_cells(preds), 4), list("abcd")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_text_counts_against_a_plain_count(spark):
    texts = {1: "red red blue", 2: "", 3: None, 4: "Été été 12 red", 5: "a b c d e f g h i j k l m n o p" * 3}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, sentence string, split string")
    for r in TR.text_counts(df, 16).collect():
        words = [w for w in __import__("re").split(r"[\W]+", (texts[r["doc_id"]] or "").lower()) if w]
        want = {}
        for w in words:
            i = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16
            want[i] = want.get(i, 0) + 1
        assert [(p["i"], p["x"]) for p in r["feats"]] == [(i, pytest.approx(n / len(words) ** 0.5)) for i, n in sorted(want.items())]
        assert r["split"] == "x"


def test_low_rank_head_against_numpy(spark):
    x, y, split, df = data(spark)
    head = TR.LowRankHead(5, 3, 6, 2)
    frozen = head.frozen.copy()
    got = TR.train(df, {"r": head}, scratch_path(spark, "low"), epochs=2)
    assert np.array_equal(head.frozen, frozen)
    assert (head.trainable, head.total) == (6 * 2 + 3 * 2 + 3, 6 * 2 + 3 * 2 + 3 + 18)
    # the same by the derivatives of each factor, row by row
    train = split == "train"
    bucket = np.array([int(hashlib.md5(f"step:{i}".encode()).hexdigest()[:8], 16) % TR.STEPS for i in range(len(y))])
    share = train.sum() / (3 * np.bincount(y[train], minlength=3))
    a, b, c = TR._hashed("a", 5, 6, 2), np.zeros((3, 2)), np.zeros(3)
    va, vb, vc = np.zeros_like(a), np.zeros_like(b), np.zeros_like(c)
    for _ in range(2):
        for k in range(TR.STEPS):
            at = train & (bucket == k)
            h = x[at] @ a
            z = x[at] @ frozen[:, :-1].T + h @ b.T + c
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - np.eye(3)[y[at]]) * share[y[at]][:, None] / share[y[at]].sum()
            ga, gb, gc = x[at].T @ (err @ b), err.T @ h, err.sum(0)
            va, vb, vc = (TR.MOMENTUM * v + g + TR.DECAY * w for v, g, w in ((va, ga, a), (vb, gb, b), (vc, gc, c)))
            a, b, c = a - TR.RATE * va, b - TR.RATE * vb, c - TR.RATE * vc
    want = np.c_[frozen[:, :-1] + b @ a.T, c]
    assert np.allclose(head.effective(), want, atol=1e-9)
    assert np.allclose(TR.restore(got.weights, {"r": 2}, {"r": TR.LowRankHead(5, 3, 6, 2)})["r"], want, atol=1e-9)
    stored = {r["name"] for r in got.weights.select("name").distinct().collect()}
    assert stored == {"down", "up", "bias"}  # the frozen part is not stored


def test_grid_of_trained_heads_writes_what_it_returns(spark):
    from lexlab.plans import scoring as S
    from lexlab.plans import trained_ladder as L
    from tests.conftest import SF_SMALL
    split, out = S.text_split(spark, SF_SMALL), scratch_path(spark, "grid")
    got = L.run(spark, split, out, seeds=[42, 43], backbones=["word_tf"], epochs=1)
    rows = {(r["experiment_id"], r["seed"]): r for r in got.collect()}
    assert sorted(rows) == [(f"word_tf_{m}", s) for m in ("eval_only", "head_only", "rank_r") for s in (42, 43)]
    assert {k: r["trainable_params"] for k, r in rows.items() if k[1] == 42} == {
        ("word_tf_eval_only", 42): 0, ("word_tf_head_only", 42): 3075, ("word_tf_rank_r", 42): 2057}
    assert sorted(map(str, L.read_results(spark, out).collect())) == sorted(map(str, got.collect()))
    table = {r["experiment_id"]: r for r in L.comparison(L.read_results(spark, out), L.read_summary(spark, out), L.read_config(spark, out)).collect()}
    assert table["word_tf_rank_r"]["trainable_text"] == "2,057" and table["word_tf_eval_only"]["lift_text"] == "+0.0%"
    assert table["word_tf_head_only"]["epochs"] == 1
    with pytest.raises(ValueError):
        L.run(spark, split, out, methods=["nope"])


def test_labels_outside_the_classes_are_left_out_of_fits(spark):
    from lexlab.operators import heads as H
    rows = [(0, [1, 2]), (1, [2, 3]), (2, [3])]
    odd = rows + [(None, [1]), (-1, [1, 1]), (5, [2])]
    a, b = (H.fit_naive_bayes(spark.createDataFrame(r, "label int, idx array<int>"), n_classes=3, num_features=4) for r in (rows, odd))
    assert a.log_theta == b.log_theta and a.log_prior == b.log_prior
    vec = [(y, [float(len(i)), 1.0]) for y, i in odd]
    mu, _ = H.fit_centroids(spark.createDataFrame(vec, "label int, v array<float>"), "v", "label", 3, 2)
    assert mu == [[2.0, 1.0], [2.0, 1.0], [1.0, 1.0]]


def test_lines_outside_the_encoding_are_returned(spark):
    from lexlab.sources import corpus as C
    lines = ["plain@neutral", "caf\xe9 \xff@positive", "snow ☃@neutral", "\U0001f600@negative", "", None, "a\x00b@neutral"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, line string")
    root = scratch_path(spark, "latin")
    refused = C.write_corpus_lines(df, C.corpus_path(root)).collect()
    assert sorted((r["n"], r["reason"]) for r in refused) == [(2, "not_encodable"), (3, "not_encodable")]
    back = sorted(r["line"] for r in C.read_corpus(spark, root).collect())
    assert back == sorted(["plain@neutral", "caf\xe9 \xff@positive", "", "", "a\x00b@neutral"])


def test_tokens_are_counted_without_a_row_per_token(spark):
    rows = [(1, "a b a", "x"), (1, "b", "x"), (2, None, "y"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, sentence string, split string").repartition(3)
    got = TR.text_counts(df, 1024)
    at = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1024 for w in "ab"}
    feats = {r["doc_id"]: {p["i"]: p["x"] for p in r["feats"]} for r in got.collect()}
    assert feats == {1: {at["a"]: 1.0, at["b"]: 1.0}, 2: {}, None: {at["a"]: 1.0}}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_blocks_in_tasks_and_rows_without_features_stay(spark):
    schema = "label int, w double, feats array<struct<i:int,x:double>>"
    rows = [(0, 1.0, [(0, 2.0), (1, -1.0)]), (2, 0.5, [(1, 3.0)]), (1, 2.0, []), (1, 2.0, None), (1, 2.0, [(0, None), (1, 1.0)])]
    df = spark.createDataFrame(rows, schema).repartition(2)
    w = {"a": np.array([[0.1, -0.2, 0.3], [0.0, 0.4, -0.1], [0.2, 0.2, 0.0]]), "b": np.zeros((3, 3))}
    full = np.array([[2.0, -1.0, 1.0], [0.0, 3.0, 1.0], [0.0, 0.0, 1.0]])
    got = TR._gradients(df, w)
    for run, v in w.items():
        e = np.exp(full @ v.T)
        e = (e / e.sum(1, keepdims=True) - np.eye(3)[[0, 2, 1]]) * np.array([[1.0], [0.5], [2.0]])
        assert np.allclose(got[run], e.T @ full)
    P = TR.predictions(df, w, ["label", "w"])
    assert "Generate" in P._jdf.queryExecution().optimizedPlan().toString() and P.count() == 10
    none = P.filter("pred is null and p_label is null and confidence is null")
    assert none.count() == 4
    one = P.filter("run = 'a' and label = 0").first()
    z = np.exp(full[0] @ w["a"].T)
    assert one["pred"] == int(z.argmax()) and one["p_label"] == pytest.approx(z[0] / z.sum())
