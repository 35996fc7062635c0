import math

import pytest
from pyspark.sql import functions as F

from lexlab.functions.exprs import argmax, half_up_pct2, softmax
from lexlab.operators import budget as B
from lexlab.operators import metrics as M
from lexlab.operators import summary as SU


def _P(spark, labels, preds):
    return spark.createDataFrame(list(zip(range(len(labels)), labels, preds)),
                                 "doc_id long, label int, pred int")


@pytest.mark.parametrize("labels,preds,expected", [
    ([0, 0, 1, 1, 1, 2], [0, 1, 1, 1, 1, 1], 0.472222),
    ([0, 1, 2], [0, 1, 2], 1.0),
    ([0, 1, 2, 2], [2, 2, 2, 2], 0.222222),
    ([0, 0, 1], [0, 1, 1], 0.666667),
    ([0, 0], [0, 1], 0.333333),
])
def test_macro_f1_cases(spark, labels, preds, expected):
    long = M.confusion_long(_P(spark, labels, preds), 3)
    got = M.macro_f1(long).first().macro_f1
    assert got == pytest.approx(expected, abs=1e-6)


def test_report_lists_absent_class_with_zero_support(spark):
    long = M.confusion_long(_P(spark, [0, 0, 1], [0, 1, 1]), 3)
    rows = {r.row_name: r for r in M.classification_report(long, ["negative", "neutral", "positive"]).collect()}
    assert rows["positive"].support == 0 and rows["positive"].f1 == 0.0
    assert rows["accuracy"].f1 == pytest.approx(2 / 3, abs=1e-6)
    assert rows["macro avg"].f1 == pytest.approx(0.666667, abs=1e-6)


def test_confusion_total_equals_rows(spark):
    P = _P(spark, [0, 0, 1, 1, 1, 2], [0, 1, 1, 1, 1, 1])
    long = M.confusion_long(P, 3)
    assert long.count() == 9
    assert long.agg(F.sum("n")).first()[0] == 6
    wide = M.confusion_wide(long, 3).orderBy("label").collect()
    assert [(r.pred_0, r.pred_1, r.pred_2, r.pred_other) for r in wide] == [(1, 1, 0, 0), (0, 3, 0, 0), (0, 1, 0, 0)]


def test_no_row_is_lost(spark):
    P = spark.createDataFrame([(0, 0, "x"), (1, 1, "x"), (2, 2, None), (7, 0, "x"), (None, 1, None), (1, None, None), (2, 9, "x")],
                              "label int, pred int, g string")
    long = M.confusion_long(P, 3)
    assert long.agg(F.sum("n")).first()[0] == 7
    got = M.macro_f1(long).first()
    assert got.n == 7 and got.accuracy == pytest.approx(3 / 7, abs=1e-6)
    f1 = {0: 2 * 0.5 * 1 / 1.5, 1: 0.5, 2: 2 * 1 * 0.5 / 1.5, 7: 0, 9: 0}
    assert got.macro_f1 == pytest.approx(sum(f1.values()) / 5, abs=1e-6)
    by = {r.g: r for r in M.macro_f1(M.confusion_long(P, 3, ["g"]), ["g"]).collect()}
    assert by[None].n == 3 and by["x"].n == 4 and by[None].macro_f1 is not None
    wide = {r.label: r for r in M.confusion_wide(long, 3).collect()}
    assert wide[2].pred_other == 1 and wide[1].pred_other == 1 and wide[None].pred_1 == 1 and wide[7].pred_0 == 1
    names = {r.row_name for r in M.classification_report(long, ["a", "b", "c"]).collect()}
    assert {"a", "b", "c", "id 7", "id 9", "no class", "accuracy"} <= names


def test_argmax_ties_nan_and_softmax(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([1.0, float("nan"), 3.0],), ([1.0, 2.0, 3.0],)],
                               "s array<double>")
    got = df.select(argmax("s").alias("a"), softmax("s").alias("p")).collect()
    assert [r.a for r in got] == [1, 1, 2]
    p = got[2].p
    assert [round(x, 6) for x in p] == [0.090031, 0.244728, 0.665241]
    assert math.isclose(sum(p), 1.0)


def test_lift_zero_baseline_is_null(spark):
    f1 = spark.createDataFrame([("a", 0.0), ("b", 0.5)], "model_id string, macro_f1 double")
    r = M.lift(f1, "a", "b").first()
    assert r.abs_lift == 0.5 and r.rel_lift_pct is None


def test_paired_counts(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 1)],
                               "label int, pred_a int, pred_b int")
    r = M.paired_counts(df).first()
    assert (r.n, r.both_right, r.only_a, r.only_b, r.both_wrong) == (4, 1, 1, 1, 1)


def test_seed_summary_cases(spark):
    res = spark.createDataFrame(
        [("a", 42, 0.5), ("a", 43, 0.7), ("a", 44, 0.6), ("b", 42, 0.6)],
        "experiment_id string, seed int, test_f1_macro double")
    s = {r.experiment_id: r for r in SU.seed_summary(res).collect()}
    assert s["a"].mean == pytest.approx(0.6) and s["a"].std == pytest.approx(0.1)
    assert s["b"].std is None
    assert SU.fill_std(SU.seed_summary(res)).filter("experiment_id = 'b'").first().std == 0.0
    order = [r.experiment_id for r in SU.order_summary(SU.seed_summary(res)).collect()]
    assert order == ["a", "b"]   # equal means: tie broken by id
    empty = SU.seed_summary(SU.empty_results(spark))
    assert empty.count() == 0


def test_best_epoch_tie_takes_earliest(spark):
    log = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.8), ("r", 3, 0.8)],
                                "run string, epoch int, f1_macro double")
    assert SU.best_epoch(log).first().best_epoch == 2


def test_check_ids():
    assert SU.check_ids([], ["x", "y"]) == ["x", "y"]
    assert SU.check_ids(["y", "y"], ["x", "y"]) == ["y"]
    with pytest.raises(ValueError):
        SU.check_ids(["z"], ["x"])


def test_param_budget_and_rounding(spark):
    params = spark.createDataFrame(
        [("m1", "encoder.layer.0.weight", 1000), ("m1", "pre_classifier.weight", 10),
         ("m1", "classifier.bias", 3), ("m2", "score.weight", 0), ("m2", "x", 0)],
        "model_id string, name string, numel long")
    b = {r.model_id: r for r in B.param_budget(B.mark_trainable(params)).collect()}
    assert (b["m1"].trainable_params, b["m1"].total_params, b["m1"].frozen_params) == (13, 1013, 1000)
    assert b["m1"].trainable_pct == 1.28
    assert b["m2"].trainable_pct == 0.0
    df = spark.createDataFrame([(2675, 100000), (125, 100000), (5 * 10 ** 14, 10 ** 18), (0, 0)], "t long, n long")
    got = [r[0] for r in df.select(half_up_pct2(F.col("t"), F.col("n"))).collect()]
    assert got == [2.68, 0.13, 0.05, 0.0]
    docs = spark.createDataFrame([("en", ["score", "classifier", "x"])], "lang string, tokens array<string>")
    assert B.vocab_param_catalogue(docs).filter("trainable").count() == 4  # the head's own tensors only
