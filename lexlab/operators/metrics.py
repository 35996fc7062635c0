"""Classification metrics from prediction tables.

Everything aggregates first: one shuffle of at most groups x classes^2
partial rows (the confusion cells); all ratios are computed afterwards on
that bounded table.

Definitions (macro-F1 contract):
* precision = tp / predicted, recall = tp / support, F1 = 2PR / (P + R),
  each 0 when its denominator is 0;
* the macro mean runs over classes present in labels UNION predictions, ids
  outside the given domain included; a class absent from both is still listed
  (support 0, ``observed`` false) but left out of the mean;
* weighted average weights by support;
* no row is lost: a NULL prediction is a wrong one, a row with a NULL label
  counts in ``n`` (and as a prediction of its class) but its class is no class,
  so it is not averaged; NULL group values form a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlab.functions.exprs import safe_div


def _g(group_cols: Sequence[str]) -> list[str]:
    return list(group_cols)


def confusion_long(preds: DataFrame, n_classes: int, group_cols: Sequence[str] = (),
                   label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """(groups..., label, pred, n): every cell of the classes x classes grid, and
    every other cell that occurs (ids outside the domain, NULL).

    The grid's zero cells and the counted cells are summed by group, label and
    prediction; grouping, unlike a join, keeps NULLs.  Both are bounded tables.
    """
    g = _g(group_cols)
    cells = (preds.groupBy(*g, F.col(label_col).cast("int").alias("label"), F.col(pred_col).cast("int").alias("pred"))
             .agg(F.count(F.lit(1)).alias("n")))
    groups = cells.select(*g).distinct() if g else cells.sparkSession.range(1).select()
    grid = (groups.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
                  .withColumn("pred", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
                  .withColumn("n", F.lit(0).cast("bigint")))
    return grid.unionByName(cells).groupBy(*g, "label", "pred").agg(F.sum("n").cast("bigint").alias("n"))


def confusion_cells(preds: DataFrame, group_cols: Sequence[str] = (), label_col: str = "label",
                    pred_col: str = "pred") -> DataFrame:
    """(groups..., label, pred, n): the cells that occur, at most one per row of
    ``preds`` whatever the number of classes.  All metrics here take this form
    too; only :func:`confusion_long` lists the cells that do not occur."""
    return (preds.groupBy(*_g(group_cols), F.col(label_col).cast("int").alias("label"), F.col(pred_col).cast("int").alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def with_domain(cells: DataFrame, n_classes: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Cells with an empty one on the diagonal for each class of the domain: per
    group ``n_classes`` rows more, so that a class absent from both sides is
    listed (support 0)."""
    g = _g(group_cols)
    groups = cells.select(*g).distinct() if g else cells.sparkSession.range(1).select()
    empty = (groups.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
             .withColumn("pred", F.col("label")).withColumn("n", F.lit(0).cast("bigint")))
    return cells.select(*g, "label", "pred", "n").unionByName(empty)


def confusion_wide(long: DataFrame, n_classes: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups..., label, pred_0 .. pred_{C-1}, pred_other) from the long form;
    ``pred_other`` holds predictions outside the domain and NULL ones."""
    g = _g(group_cols)
    inside = F.coalesce(F.col("pred").between(0, n_classes - 1), F.lit(False))

    def cell(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint").alias(name)

    return long.groupBy(*g, "label").agg(*[cell(F.col("pred") == i, f"pred_{i}") for i in range(n_classes)],
                                         cell(~inside, "pred_other"))


def per_class(long: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups..., class, tp, support, predicted, precision, recall, f1, observed).

    Each confusion cell is counted once as its true class and once as its
    predicted class (explode), then summed: one linear plan, no self-join.
    """
    g = _g(group_cols)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted")))
    t = (long.select(*g, F.explode(roles).alias("r")).select(*g, "r.*")
         .groupBy(*g, "class").agg(F.sum("support").cast("bigint").alias("support"),
                                   F.sum("tp").cast("bigint").alias("tp"),
                                   F.sum("predicted").cast("bigint").alias("predicted")))
    p = safe_div(F.col("tp"), F.col("predicted"))
    r = safe_div(F.col("tp"), F.col("support"))
    return (t.withColumn("precision", p).withColumn("recall", r)
             .withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))
             .withColumn("observed", F.col("class").isNotNull() & ((F.col("support") > 0) | (F.col("predicted") > 0))))


def _summary_exprs():
    obs = F.col("observed")
    n = F.sum("support")
    return [
        n.cast("bigint").alias("n"),
        safe_div(F.sum("tp"), n).alias("accuracy"),
        F.avg(F.when(obs, F.col("precision"))).alias("macro_precision"),
        F.avg(F.when(obs, F.col("recall"))).alias("macro_recall"),
        F.avg(F.when(obs, F.col("f1"))).alias("macro_f1"),
        safe_div(F.sum(F.col("precision") * F.col("support")), n).alias("weighted_precision"),
        safe_div(F.sum(F.col("recall") * F.col("support")), n).alias("weighted_recall"),
        safe_div(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
    ]


def summary(pc: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups..., n, accuracy, macro_*, weighted_*)."""
    return pc.groupBy(*_g(group_cols)).agg(*_summary_exprs())


def classification_report(long: DataFrame, class_names: Sequence[str],
                          group_cols: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows:
    (groups..., row_name, precision, recall, f1, support).

    The group totals ride along each class row as window aggregates over the
    (bounded) per-class table; the first class row of each group also emits
    the three summary rows, so the whole report is one linear plan.
    """
    from pyspark.sql import Window
    g = _g(group_cols)
    pc = per_class(long, g)
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    obs = F.col("observed")
    n = F.sum("support").over(w)
    pcw = (pc.withColumn("_n", n.cast("bigint"))
             .withColumn("_acc", safe_div(F.sum("tp").over(w), n))
             .withColumn("_mp", F.avg(F.when(obs, F.col("precision"))).over(w))
             .withColumn("_mr", F.avg(F.when(obs, F.col("recall"))).over(w))
             .withColumn("_mf", F.avg(F.when(obs, F.col("f1"))).over(w))
             .withColumn("_wp", safe_div(F.sum(F.col("precision") * F.col("support")).over(w), n))
             .withColumn("_wr", safe_div(F.sum(F.col("recall") * F.col("support")).over(w), n))
             .withColumn("_wf", safe_div(F.sum(F.col("f1") * F.col("support")).over(w), n))
             .withColumn("_first", F.col("class") == F.min("class").over(w)))
    inside = F.col("class").between(0, len(class_names) - 1)
    names = (F.when(inside, F.try_element_at(F.array(*[F.lit(x) for x in class_names]), F.col("class") + 1))
             .otherwise(F.coalesce(F.concat(F.lit("id "), F.col("class").cast("string")), F.lit("no class"))))

    def row(name, p, r, f, s):
        return F.struct(name.alias("row_name"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("bigint").alias("support"))

    null = F.lit(None).cast("double")
    own = F.array(row(names, F.col("precision"), F.col("recall"), F.col("f1"), F.col("support")))
    extra = F.array(row(F.lit("accuracy"), null, null, F.col("_acc"), F.col("_n")),
                    row(F.lit("macro avg"), F.col("_mp"), F.col("_mr"), F.col("_mf"), F.col("_n")),
                    row(F.lit("weighted avg"), F.col("_wp"), F.col("_wr"), F.col("_wf"), F.col("_n")))
    rows = F.when(F.col("_first"), F.concat(own, extra)).otherwise(own)
    out = pcw.select(*g, F.explode(rows).alias("r")).select(*g, "r.*")
    return out.select(*g, "row_name", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def macro_f1(long: DataFrame, group_cols: Sequence[str] = (), digits: int = 6) -> DataFrame:
    g = _g(group_cols)
    s = summary(per_class(long, g), g)
    return s.select(*g, F.round("macro_f1", digits).alias("macro_f1"),
                    F.round("accuracy", digits).alias("accuracy"), "n")


# ---------------------------------------------------------------------------
# two models on the same rows
# ---------------------------------------------------------------------------
def pair_predictions(a: DataFrame, b: DataFrame, key_cols: Sequence[str],
                     label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Join two stored prediction tables on the row key (equi join; Spark
    picks broadcast or sort-merge by measured size)."""
    a2 = a.select(*key_cols, label_col, F.col(pred_col).alias("pred_a"))
    b2 = b.select(*key_cols, F.col(pred_col).alias("pred_b"))
    return a2.join(b2, list(key_cols))


def paired_counts(df: DataFrame, group_cols: Sequence[str] = (), label_col: str = "label",
                  a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """both right / only A right / only B right / both wrong per group."""
    ra, rb = F.col(a) == F.col(label_col), F.col(b) == F.col(label_col)

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        cnt(ra & rb).alias("both_right"), cnt(ra & ~rb).alias("only_a"),
        cnt(~ra & rb).alias("only_b"), cnt(~ra & ~rb).alias("both_wrong"),
        cnt(F.col(a) == F.col(b)).alias("agree"))


def lift(f1: DataFrame, base_model: str, adapted_model: str, group_cols: Sequence[str] = (),
         model_col: str = "model_id", digits: int = 6) -> DataFrame:
    """Absolute and relative macro-F1 lift of one model over a baseline
    (relative lift NULL when the baseline is 0)."""
    g = _g(group_cols)
    w = f1.groupBy(*g).agg(
        F.max(F.when(F.col(model_col) == base_model, F.col("macro_f1"))).alias("base_f1"),
        F.max(F.when(F.col(model_col) == adapted_model, F.col("macro_f1"))).alias("adapted_f1"))
    return w.select(*g, "base_f1", "adapted_f1",
                    F.round(F.col("adapted_f1") - F.col("base_f1"), digits).alias("abs_lift"),
                    F.round(F.try_divide(F.col("adapted_f1") - F.col("base_f1"), F.col("base_f1")) * 100,
                            digits).alias("rel_lift_pct"))


# ---------------------------------------------------------------------------
# calibration
# ---------------------------------------------------------------------------
def reliability(preds: DataFrame, group_cols: Sequence[str] = (), n_bins: int = 10,
                label_col: str = "label", pred_col: str = "pred", conf_col: str = "confidence",
                digits: int = 6) -> DataFrame:
    """Reliability table and expected calibration error:
    (groups..., bin, n, accuracy, avg_confidence, gap, ece)."""
    g = _g(group_cols)
    b = F.least(F.floor(F.col(conf_col) * n_bins), F.lit(n_bins - 1)).cast("int")
    t = (preds.withColumn("bin", b).groupBy(*g, "bin").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"),
        F.avg(conf_col).alias("avg_confidence")))
    t = t.withColumn("gap", F.abs(F.col("accuracy") - F.col("avg_confidence")))
    from pyspark.sql import Window
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    t = t.withColumn("ece", F.sum(F.col("n") * F.col("gap")).over(w) / F.sum("n").over(w))
    return t.select(*g, "bin", "n", *[F.round(c, digits).alias(c)
                                      for c in ("accuracy", "avg_confidence", "gap", "ece")])
