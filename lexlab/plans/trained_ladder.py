"""Experiment grid by the fixed-step trainer: every number in its files can be worked
out again by another engine.

Two feature sets x three methods x seeds on one split:

* ``eval_only``  the untrained head, weights by a hash of the seed;
* ``head_only``  all weights of a head, trained (:class:`trainer.LinearHead`);
* ``rank_r``     two thin factors beside a frozen head (:class:`trainer.LowRankHead`).

The features of a set are prepared once, in the store of prepared tables, and all heads
of a set, of both methods and all seeds, are trained side by side in the same passes.  ``char3_tf`` has
the finance family's label order.  Results, summary and logs go to CSV, the
configuration to JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.constants import LADDER_SEEDS, SPLIT_SEED
from lexlab.functions.exprs import half_up_pct2
from lexlab.functions.text import char_ngrams, word_tokens
from lexlab.operators import metrics as M
from lexlab.operators.labels import remap_labels
from lexlab.operators.summary import best_epoch, order_runs, order_summary, seed_summary
from lexlab.plans import trainer as T
from lexlab.sinks import writers as W
from lexlab.store import store

N_CLASSES, N_FEATURES, HEAD_RANK = 3, 1024, 2
SETS = {"word_tf": ("general", word_tokens), "char3_tf": ("finance", char_ngrams)}
METHODS = ("eval_only", "head_only", "rank_r")
RESULTS = ("experiment_id string, backbone string, method string, seed int, best_epoch int, test_f1_macro double, "
           "val_f1_macro double, trainable_params bigint, total_params bigint, trainable_pct double, output_dir string")
SUMMARY = "experiment_id string, mean double, std double, min double, max double, n_runs bigint"


def features(split: DataFrame, backbone: str) -> DataFrame:
    """``doc_id, split, label, feats`` of one feature set, prepared once."""
    family, tokens = SETS[backbone]
    rows = remap_labels(split.select("doc_id", "sentence", "label", "split"), "general", family)
    return store(split.sparkSession).acquire(T.text_counts(rows.select("doc_id", "sentence", "label", "split"), N_FEATURES, tokens=tokens),
                                             f"features-{backbone}")


def _test_f1(rows: DataFrame, weights) -> dict[str, float]:
    P = T.predictions(rows.filter("split = 'test'"), weights, ["label"])
    return {r["run"]: r["macro_f1"] for r in M.macro_f1(M.confusion_cells(P, ["run"]), ["run"]).collect()}


def _head(method: str, seed: int) -> T.LinearHead:
    if method == "rank_r":
        return T.LowRankHead(seed, N_CLASSES, N_FEATURES, HEAD_RANK)
    return T.LinearHead(seed, N_CLASSES, N_FEATURES)


def run(spark: SparkSession, split: DataFrame, out_dir: str, seeds: Sequence[int] = LADDER_SEEDS,
        backbones: Sequence[str] = tuple(SETS), methods: Sequence[str] = METHODS, epochs: int = T.EPOCHS) -> DataFrame:
    """Run the grid on a labelled split (doc_id, sentence, label, split) and write its
    files; the results.  Unknown feature sets or methods raise."""
    unknown = sorted(set(backbones) - set(SETS)) + sorted(set(methods) - set(METHODS))
    if unknown:
        raise ValueError(f"unknown: {unknown}")
    rows = []
    for backbone in backbones:
        feats = features(split, backbone)
        heads = {f"{m}_{s}": _head(m, s) for m in methods if m != "eval_only" for s in seeds}
        weights, best = {}, {}
        if "eval_only" in methods:
            weights = {f"eval_only_{s}": T.first_weights(s, N_CLASSES, N_FEATURES, scale=1.0) for s in seeds}
        if heads:
            got = T.train(feats, heads, f"{out_dir}/models/{backbone}", epochs=epochs)
            weights |= got.best
            best = {r["run"]: r for r in best_epoch(got.log).collect()}
        f1 = _test_f1(feats, weights) if weights else {}
        for m in methods:
            for s in seeds:
                name, key = f"{backbone}_{m}", f"{m}_{s}"
                size = (heads[key].trainable, heads[key].total) if key in heads else (0, N_CLASSES * N_FEATURES)
                b = best.get(key)
                rows.append((name, backbone, m, s, b and b["best_epoch"], f1.get(key), b and b["best_f1"], *size, None,
                             W.output_dir_name(name, s) if key in heads else None))
    pct = half_up_pct2(F.col("trainable_params"), F.col("total_params"))
    results = spark.createDataFrame(rows, RESULTS).withColumn("trainable_pct", pct)
    W.write_csv(order_runs(results), f"{out_dir}/results", single_file=True)
    W.write_csv(order_summary(seed_summary(results)), f"{out_dir}/summary", ["experiment_id", "mean", "std", "min", "max", "n_runs"],
                single_file=True)
    W.write_run_config(spark, {"seeds": list(seeds), "split_seed": SPLIT_SEED, "epochs": epochs, "steps": T.STEPS, "rate": T.RATE,
                               "rank": HEAD_RANK, "features": N_FEATURES}, f"{out_dir}/run_config")
    return results


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.option("header", True).schema(RESULTS).csv(f"{out_dir}/results")


def read_summary(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.option("header", True).schema(SUMMARY).csv(f"{out_dir}/summary")


def read_config(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("split_seed int, epochs int").json(f"{out_dir}/run_config")


def comparison(results: DataFrame, summary: DataFrame, config: DataFrame) -> DataFrame:
    """A row per experiment: the summary, lift over the untrained head of the same feature
    set, the configuration's split seed and passes, and numbers as they are printed."""
    sizes = results.groupBy("experiment_id", "backbone").agg(F.max("trainable_params").alias("t"), F.max("total_params").alias("n"),
                                                             F.max("trainable_pct").alias("pct"))
    every = summary.join(sizes, "experiment_id")
    base = every.filter(F.col("experiment_id").endswith("eval_only")).select("backbone", F.col("mean").alias("base"))
    one = config.first()  # one row
    lift = F.col("mean") - F.col("base")
    return every.join(base, "backbone").select(
        "experiment_id", "n_runs", "mean", "std", "min", "max", F.round(lift, 6).alias("lift"),
        F.lit(one["split_seed"]).alias("split_seed"), F.lit(one["epochs"]).alias("epochs"),
        F.format_string("%,d", "t").alias("trainable_text"), F.format_string("%,d", "n").alias("total_text"),
        F.format_string("%.2f%%", "pct").alias("pct_text"), F.format_string("%.4f", "mean").alias("mean_text"),
        F.when(F.col("base") == 0, "n/a").otherwise(F.format_string("%+.1f%%", F.try_divide(lift, F.col("base")) * 100)).alias("lift_text"))
