"""Experiment grid ("ladder"): feature sets x methods x seeds on one split.

The grid is a relation (experiments x seeds); its rows, a few dozen at most,
are what the driver walks.  Every fit and every evaluation is a distributed
Spark job, and only metric rows and the results table reach the driver.

* prepared rows are persisted once per feature set and released at the end,
  whatever happens in between; texts are split and hashed there, once, and not in each fit;
* the split is computed once (seed 42) and shared by every run;
* ``char3_tfidf`` trains in the finance family's label order (labels are
  recoded with one projection);
* every run is a fit of its own: the seed draws the resample of the train rows
  that the head is fitted on (:func:`heads.in_fit`), and the weights of the
  untrained head;
* run times and rows/s go to a log of their own, so two runs of the grid give
  the same results table.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.constants import LADDER_SEEDS
from lexlab.functions.exprs import half_up_pct2
from lexlab.functions.text import char_ngrams, token_indices, word_tokens
from lexlab.operators import heads as H
from lexlab.operators import metrics as M
from lexlab.operators.labels import remap_labels
from lexlab.operators.summary import RESULT_SCHEMA, check_ids, order_runs, order_summary, seed_summary
from lexlab.plans import training as TR
from lexlab.sinks import writers as W
from lexlab.sources.corpus import known_subset, select_agreement

# experiment id -> (feature set, family, method)
EXPERIMENTS = {
    "word_tfidf_eval_only": ("word_tfidf", "general", "eval_only"),
    "word_tfidf_head_only": ("word_tfidf", "general", "head_only"),
    "word_tfidf_rank_r": ("word_tfidf", "general", "rank_r"),
    "char3_tfidf_eval_only": ("char3_tfidf", "finance", "eval_only"),
    "char3_tfidf_head_only": ("char3_tfidf", "finance", "head_only"),
    "char3_tfidf_rank_r": ("char3_tfidf", "finance", "rank_r"),
}
LOG_SCHEMA = "experiment_id string, seed int, fit_sec double, train_rows bigint, train_rows_per_sec double"
MAX_ITER = 50


def experiment_table(spark: SparkSession) -> DataFrame:
    """The configuration relation (experiment_id, backbone, family, method)."""
    return spark.createDataFrame([(k, *v) for k, v in EXPERIMENTS.items()],
                                 "experiment_id string, backbone string, family string, method string")


def select_experiments(backbone: str | None = None, methods: Sequence[str] | None = None) -> list[str]:
    """Experiment ids matching a feature set and a method set (compound predicate)."""
    return [k for k, (fs, _, m) in EXPERIMENTS.items()
            if (backbone is None or fs == backbone) and (methods is None or m in methods)]


def grid(spark: SparkSession, seeds: Sequence[int] = LADDER_SEEDS, experiments: Sequence[str] = ()) -> DataFrame:
    """Seeds x experiments (a relation of a few rows), in run order."""
    ids = check_ids(list(experiments), list(EXPERIMENTS))
    return (experiment_table(spark).filter(F.col("experiment_id").isin(ids))
            .withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
            .orderBy("seed", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("experiment_id"))))


def prepare(labelled_split: DataFrame, feature_set: str, family: str) -> DataFrame:
    """Rows of one feature set: labels in the family's order, hashed counts ``_tf`` for the
    fits, and hashed ids of the test rows for the fixed head, which scores only those."""
    df = remap_labels(labelled_split.select("doc_id", "sentence", "label", "split"), "general", family)
    toks = word_tokens("sentence") if feature_set == "word_tfidf" else char_ngrams("sentence", 3)
    ids = F.when(F.col("split") == "test", token_indices(toks, TR.NUM_FEATURES))
    return TR.counting(feature_set).transform(df.withColumn("idx", ids)).select("doc_id", "label", "split", "_tf", "idx")


def _eval_f1(pred: DataFrame, n_classes: int = 3) -> dict[str, float]:
    rows = M.macro_f1(M.confusion_long(pred, n_classes, ["split"]), ["split"]).collect()
    return {r["split"]: r["macro_f1"] for r in rows}


def _run(prepared: DataFrame, experiment_id: str, seed: int, max_iter: int, out_dir: str | None) -> tuple[tuple, tuple | None]:
    """Result row and log row of one run."""
    fs, _, method = EXPERIMENTS[experiment_id]
    if method == "eval_only":
        scored = H.with_prediction(prepared.filter(F.col("split") == "test"),
                                   H.fixed_text_logits("idx", seed, 3, TR.NUM_FEATURES))
        return (experiment_id, fs, method, seed, _eval_f1(scored).get("test"), None, 0, 3 * TR.NUM_FEATURES, 0.0, None), None
    train = prepared.filter((F.col("split") == "train") & H.in_fit(seed))
    counts = TR.class_counts(train)
    started = time.perf_counter()
    model, whole = TR.fit_counted(TR.with_weights(train, TR.class_weights(train, counts=counts)), fs, method, max_iter)
    sec, n_train = time.perf_counter() - started, sum(counts.values())
    f1 = _eval_f1(TR.predict(model, prepared.filter(F.col("split") != "train")))
    trainable, total = TR.trained_params(model, TR.NUM_FEATURES)
    name = W.output_dir_name(experiment_id, seed)
    if out_dir:
        TR.save_model(whole, f"{out_dir}/models/{name}")
    row = (experiment_id, fs, method, seed, f1.get("test"), f1.get("validation"), trainable, total, None, name)
    return row, (experiment_id, seed, round(sec, 3), n_train, round(n_train / sec, 1) if sec > 0 else None)


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    pct = F.when(F.col("method") == "eval_only", F.lit(0.0)).otherwise(half_up_pct2(F.col("trainable_params"), F.col("total_params")))
    return spark.createDataFrame(rows, RESULT_SCHEMA).withColumn("trainable_pct", pct)


def run_experiment(spark: SparkSession, labelled_split: DataFrame, experiment_id: str, seed: int = LADDER_SEEDS[0],
                   max_iter: int = MAX_ITER, out_dir: str | None = None) -> DataFrame:
    """One experiment with one seed on a labelled split (doc_id, sentence,
    label, split): its result row."""
    check_ids([experiment_id], list(EXPERIMENTS))
    fs, family, _ = EXPERIMENTS[experiment_id]
    return _table(spark, [_run(prepare(labelled_split, fs, family), experiment_id, seed, max_iter, out_dir)[0]])


def run_ladder_with_log(spark: SparkSession, labelled_split: DataFrame, seeds: Sequence[int] = LADDER_SEEDS,
                        experiments: Sequence[str] = (), out_dir: str | None = None,
                        max_iter: int = MAX_ITER) -> tuple[DataFrame, DataFrame]:
    """``(results, log)``: one result row per run, and the fits' run times."""
    ready: dict[tuple[str, str], DataFrame] = {}
    rows, log = [], []
    try:
        for run in grid(spark, seeds, experiments).collect():
            key = (run["backbone"], run["family"])
            if key not in ready:
                ready[key] = prepare(labelled_split, *key).persist(StorageLevel.MEMORY_AND_DISK)
            row, timing = _run(ready[key], run["experiment_id"], run["seed"], max_iter, out_dir)
            rows.append(row)
            log += [timing] if timing else []
    finally:
        for df in ready.values():
            df.unpersist()
    return _table(spark, rows), spark.createDataFrame(log, LOG_SCHEMA)


def run_ladder(spark: SparkSession, labelled_split: DataFrame, seeds: Sequence[int] = LADDER_SEEDS,
               experiments: Sequence[str] = (), out_dir: str | None = None, max_iter: int = MAX_ITER) -> DataFrame:
    """Run the grid; the results table, one row per experiment and seed."""
    return run_ladder_with_log(spark, labelled_split, seeds, experiments, out_dir, max_iter)[0]


def ladder_with_sinks(spark: SparkSession, labelled_split: DataFrame, out_dir: str,
                      seeds: Sequence[int] = LADDER_SEEDS, experiments: Sequence[str] = (),
                      agreement: str = "50", max_iter: int = MAX_ITER) -> DataFrame:
    """Run on one agreement subset (of rows that carry ``agreement_pct``), then
    write results, summary (id first) and run log as CSV and the run's
    configuration as JSON; returns the summary."""
    known_subset(agreement)
    if "agreement_pct" in labelled_split.columns:
        labelled_split = select_agreement(labelled_split, agreement)
    results, log = run_ladder_with_log(spark, labelled_split, seeds, experiments, out_dir, max_iter)
    summary = seed_summary(results)
    W.write_csv(order_runs(results), f"{out_dir}/ladder_results", single_file=True)
    W.write_csv(log, f"{out_dir}/ladder_log", single_file=True)
    W.write_csv(order_summary(summary), f"{out_dir}/ladder_summary",
                ["experiment_id", "mean", "std", "min", "max", "n_runs"], single_file=True)
    W.write_run_config(spark, {"seeds": list(seeds), "split_seed": 42, "agreement": agreement, "epochs": max_iter,
                               "experiments": check_ids(list(experiments), list(EXPERIMENTS)),
                               "feature_dim": TR.NUM_FEATURES}, f"{out_dir}/run_config")
    return summary
