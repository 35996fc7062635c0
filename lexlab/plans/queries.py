"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query reads the given parquet tables (or data Spark derives from
them) in full; nothing is subset to make a check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.operators import labels as lab
from lexlab.operators import split as spl
from lexlab.session import scratch_path, stage_table
from lexlab.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def split_L(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl.stratified_split(fx.labelled(spark, sf_dir), label_col="label", key_col="doc_id")


# ---- stage 1: label domain ------------------------------------------------
@query("class_distribution")
def q_class_distribution(spark, sf_dir):
    return lab.class_distribution(fx.labelled(spark, sf_dir))


@query("label_decode")
def q_label_decode(spark, sf_dir):
    L = fx.labelled(spark, sf_dir).select("doc_id", "label")
    return lab.decode_by_join(L, lab.label_map_table(spark), "general")


@query("label_remap")
def q_label_remap(spark, sf_dir):
    L = fx.labelled(spark, sf_dir).select("doc_id", "label", "label_name")
    return lab.remap_labels(L, "general", "finance")


# ---- stage 3: split ---------------------------------------------------------
@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return split_L(spark, sf_dir).select("doc_id", "label", "label_name", "split")


@query("split_counts")
def q_split_counts(spark, sf_dir):
    return spl.split_counts(split_L(spark, sf_dir).select("label_name", "split"))


@query("split_disjoint")
def q_split_disjoint(spark, sf_dir):
    L = fx.labelled(spark, sf_dir).select("doc_id", "label")
    return spl.split_disjoint(L, spl.stratified_split(L))


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    s = spl.sample_rows(fx.labelled(spark, sf_dir), n=5, key_col="doc_id", seed=42)
    return s.select("doc_id", "label_name", "sentence")


# ---- stage 2: corpus lines ------------------------------------------------
from lexlab.functions.exprs import one_line, seeded_md5  # noqa: E402
from lexlab.sources import corpus as cor  # noqa: E402


@query("parse_labelled_lines")
def q_parse_labelled_lines(spark, sf_dir):
    lines = fx.corpus_lines(fx.labelled(spark, sf_dir))
    return cor.good_rows(cor.parse_lines(lines)).select("doc_id", "sentence", "label")


def damaged_lines(spark, sf_dir):
    """Corpus lines with deterministic damage: ~1/16 lose every delimiter,
    ~1/16 carry an unknown label."""
    L = fx.labelled(spark, sf_dir)
    k = F.substring(seeded_md5("dmg", "doc_id"), 1, 1)
    text = one_line("sentence")
    line = (F.when(k == "0", F.regexp_replace(text, "@", ""))
            .when(k == "1", F.concat(text, F.lit("@mixed")))
            .otherwise(F.concat(text, F.lit("@"), F.col("label_name"))))
    return L.select("doc_id", line.alias("line"))


@query("parse_quarantine")
def q_parse_quarantine(spark, sf_dir):
    parsed = cor.parse_lines(damaged_lines(spark, sf_dir))
    return cor.quarantine_rows(parsed).select("doc_id", "reason", "line")


@query("select_agreement")
def q_select_agreement(spark, sf_dir):
    L = cor.with_agreement_level(fx.labelled(spark, sf_dir), "doc_id")
    return cor.select_agreement(L, "66").select("doc_id", "label_name", "agreement_pct")


# ---- stage 5: text, padding, scoring ------------------------------------------
from lexlab.operators import heads as H  # noqa: E402
from lexlab.operators import metrics as M  # noqa: E402
from lexlab.operators import term_scoring as TS  # noqa: E402
from lexlab.operators import text as T  # noqa: E402
from lexlab.plans import scoring as S  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402
from lexlab.functions.exprs import argmax, format_scores, scores_map, softmax, unit_interval  # noqa: E402
from lexlab.operators.labels import names_in_id_order  # noqa: E402


@query("tokenize_truncate")
def q_tokenize_truncate(spark, sf_dir):
    docs = fx.read_documents(spark, sf_dir, "text")
    t = T.tokenize(docs, "text", "tokens", max_length=128)
    return t.select("doc_id", "n_tokens", F.size("tokens").cast("bigint").alias("n_kept"),
                    F.array_join("tokens", " ").alias("tokens_text"))


@query("vocab_counts")
def q_vocab_counts(spark, sf_dir):
    docs = fx.read_documents(spark, sf_dir, "text")
    return T.vocab_counts(T.tokenize(docs, "text", "tokens", max_length=None))


@query("pad_batches")
def q_pad_batches(spark, sf_dir):
    docs = fx.read_documents(spark, sf_dir, "text")
    ids = T.tokenize(docs, "text", "tokens", None).withColumn("ids", T.token_ids("tokens"))
    b = T.pad_batches(ids.select("doc_id", "ids"), "ids", "doc_id", batch_size=32)
    return b.select("doc_id", "bucket", "batch_no", "seq_len", "padded_len",
                    F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("input_ids_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("mask_sum"))


@query("score_fixed_head")
def q_score_fixed_head(spark, sf_dir):
    emb = fx.embeddings(spark, sf_dir)
    c = S.emb_classes(spark, sf_dir)
    out = H.with_prediction(emb, H.fixed_vector_logits("embedding", 42, c, S.EMB_DIM))
    return out.select("vec_id", "label", "pred", F.round("confidence", 6).alias("confidence"))


@query("score_new_text")
def q_score_new_text(spark, sf_dir):
    names = names_in_id_order("general")
    base = H.text_features(S.text_split(spark, sf_dir), "sentence")
    table = H.fit_naive_bayes(base.filter(F.col("split") == "train"), "idx", "label", 3)
    new = H.text_features(fx.unlabelled_documents(spark, sf_dir), "text")
    lg = table.logits("idx")
    out = new.withColumn("_lg", lg).withColumn("_p", softmax("_lg")).withColumn("_pred", argmax("_lg"))
    out = out.withColumn("scores", scores_map(names, "_p"))
    pred_name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_pred") + 1)
    return out.select(
        "doc_id", pred_name.alias("prediction"), F.upper(pred_name).alias("prediction_upper"),
        F.round(F.element_at("_p", F.col("_pred") + 1), 6).alias("confidence"),
        format_scores("scores", 3).alias("scores_text"),
        *[F.round(F.col("scores")[n], 6).alias(f"score_{n}") for n in names],
        "text", F.substring("text", 1, 80).alias("preview"))


@query("score_term_table")
def q_score_term_table(spark, sf_dir):
    """M6, K4: naive Bayes over the whole vocabulary, stored as a table, read back and joined to new text."""
    split = S.text_split(spark, sf_dir).filter(F.col("split") == "train").select("doc_id", "sentence", "label")
    path = scratch_path(spark, "term-model")
    TS.fit_term_bayes(TS.term_counts(split, keep=["label"]), split, S.TEXT_CLASSES).save(path)
    new = fx.unlabelled_documents(spark, sf_dir).select("doc_id", "text")
    out = TS.score_terms(new.select("doc_id"), TS.term_counts(new, "text"), TS.TermModel.load(spark, path))
    names = names_in_id_order("general")
    return out.select("doc_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pred") + 1).alias("prediction"),
                      F.round("confidence", 6).alias("confidence"),
                      *[F.round(F.col("probs")[c], 6).alias(f"score_{n}") for c, n in enumerate(names)])


# ---- stage 4: metrics ---------------------------------------------------------
G_MS = ["model_id", "split"]


def text_P(spark, sf_dir):
    return S.text_predictions(spark, sf_dir, seeds=(42,), nb=True)


@query("confusion_long")
def q_confusion_long(spark, sf_dir):
    return M.confusion_long(text_P(spark, sf_dir), 3, G_MS)


@query("confusion_wide")
def q_confusion_wide(spark, sf_dir):
    return M.confusion_wide(M.confusion_long(text_P(spark, sf_dir), 3, G_MS), 3, G_MS)


@query("classification_report")
def q_classification_report(spark, sf_dir):
    long = M.confusion_long(text_P(spark, sf_dir), 3, G_MS)
    return M.classification_report(long, names_in_id_order("general"), G_MS)


@query("macro_f1")
def q_macro_f1(spark, sf_dir):
    return M.macro_f1(M.confusion_long(text_P(spark, sf_dir), 3, G_MS), G_MS)


def _damaged_predictions(spark, sf_dir):
    """Predictions with ids outside the domain and NULLs, by a hash of the key."""
    P = S.text_predictions(spark, sf_dir, seeds=(42,), nb=False)
    k = F.substring(seeded_md5("ood", "doc_id"), 1, 1)
    return (P.withColumn("label", F.when(k == "0", F.lit(5)).when(k != "1", F.col("label")))
             .withColumn("pred", F.when(k.isin("0", "2"), F.lit(7)).when(k != "3", F.col("pred")))
             .withColumn("lang", F.when(k != "4", F.col("lang"))))


@query("confusion_out_of_domain")
def q_confusion_out_of_domain(spark, sf_dir):
    return M.confusion_long(_damaged_predictions(spark, sf_dir), 3, G_MS).filter("n > 0")


@query("macro_f1_null_group")
def q_macro_f1_null_group(spark, sf_dir):
    return M.macro_f1(M.confusion_long(_damaged_predictions(spark, sf_dir), 3, ["lang"]), ["lang"])


@query("paired_compare")
def q_paired_compare(spark, sf_dir):
    wide = S.text_scored(spark, sf_dir, seeds=(42,), nb=True)
    return M.paired_counts(wide, ["split"], "label", a="fixed_s42_pred", b="nb_pred")


@query("lift")
def q_lift(spark, sf_dir):
    f1 = M.macro_f1(M.confusion_long(text_P(spark, sf_dir), 3, G_MS), G_MS)
    return M.lift(f1, "fixed_s42", "nb", ["split"])


@query("calibration_ece")
def q_calibration_ece(spark, sf_dir):
    return M.reliability(text_P(spark, sf_dir), G_MS)


# ---- stage 7: budget, results, summaries -----------------------------------------
from lexlab.operators import budget as B  # noqa: E402
from lexlab.operators import summary as SU  # noqa: E402
from lexlab.operators import gates as GT  # noqa: E402
from lexlab.constants import LADDER_SEEDS  # noqa: E402
from lexlab.operators import user_metric as UM  # noqa: E402
from lexlab.plans import experiments as EX  # noqa: E402
from lexlab.plans import trainer as TN  # noqa: E402


def param_catalogue(spark, sf_dir):
    docs = fx.read_documents(spark, sf_dir, "text", "lang")
    return B.vocab_param_catalogue(T.tokenize(docs, "text", "tokens", None), "tokens", "lang")


@query("param_budget")
def q_param_budget(spark, sf_dir):
    return B.param_budget(param_catalogue(spark, sf_dir))


@query("seed_summary")
def q_seed_summary(spark, sf_dir):
    return SU.seed_summary(EX.fixed_results(spark, sf_dir))


@query("rank_methods")
def q_rank_methods(spark, sf_dir):
    return SU.rank_methods(SU.seed_summary(EX.fixed_results(spark, sf_dir)))


def _trained_text(spark, sf_dir):
    """W3, M4: a head per seed trained on word counts, with a log of all passes."""
    feats = TN.text_counts(S.text_split(spark, sf_dir).select("doc_id", "sentence", "label", "split"), H.NUM_FEATURES)
    heads = {f"word_head_only_seed{s}": TN.LinearHead(s, S.TEXT_CLASSES, H.NUM_FEATURES) for s in LADDER_SEEDS}
    return TN.train(feats, heads, scratch_path(spark, "trained-text"))


@query("best_epoch")
def q_best_epoch(spark, sf_dir):
    return SU.best_epoch(_trained_text(spark, sf_dir).log)


@query("epoch_log")
def q_epoch_log(spark, sf_dir):
    return _trained_text(spark, sf_dir).log.withColumn("train_loss", F.round("train_loss", 6))


@query("learning_curve")
def q_learning_curve(spark, sf_dir):
    """Naive Bayes fitted on a growing share of the train rows: the best share per seed."""
    return SU.best_epoch(EX.nb_epoch_log(spark, sf_dir))


@query("user_metric")
def q_user_metric(spark, sf_dir):
    """X2: a metric that the library does not have, as an aggregate over confusion cells."""
    return UM.evaluate(text_P(spark, sf_dir), UM.Matthews(), G_MS, "mcc").withColumn("mcc", F.round("mcc", 6))


@query("marginal_value")
def q_marginal_value(spark, sf_dir):
    res = EX.fixed_results(spark, sf_dir)
    by_method = res.groupBy("backbone", "method").agg(F.round(F.avg("test_f1_macro"), 6).alias("mean"))
    return SU.marginal_value(by_method)


# ---- stage 8: charter extensions ---------------------------------------------------
@query("slice_report")
def q_slice_report(spark, sf_dir):
    P = S.text_predictions(spark, sf_dir, (42,), True, keep=("doc_id", "split", "label", "slices"))
    t = P.filter(F.col("split") == "test").select("model_id", "label", "pred",
                                                  F.explode("slices").alias("slice"))
    return M.macro_f1(M.confusion_long(t, 3, ["model_id", "slice"]), ["model_id", "slice"])


SHIFT_FROM = "en"


@query("domain_shift")
def q_domain_shift(spark, sf_dir):
    """Forgetting proxy: naive Bayes fitted on one language, evaluated on every
    language's test rows beside the untrained head."""
    P = S.text_predictions(spark, sf_dir, (42,), True, nb_lang=SHIFT_FROM)
    f1 = M.macro_f1(M.confusion_long(P, 3, ["model_id", "lang"]), ["model_id", "lang"])
    return M.lift(f1, "fixed_s42", "nb", ["lang"]).select(
        "lang", (F.col("lang") == SHIFT_FROM).alias("in_domain"), "base_f1", "adapted_f1", F.col("abs_lift").alias("delta"))


def golden(P):
    """The golden rows: a quarter of the test split, frozen by a hash of the key
    and never looked at by any fit."""
    return P.filter((F.col("split") == "test") & (unit_interval(seeded_md5("golden", "doc_id")) < 0.25))


@query("gate_report")
def q_gate_report(spark, sf_dir):
    P = S.text_predictions(spark, sf_dir, (42,), True)
    f1 = M.macro_f1(M.confusion_long(P, 3, G_MS), G_MS)
    g1 = GT.gate_rows(M.lift(f1, "fixed_s42", "nb", ["split"]), {"abs_lift": ("abs_lift", 0.15, ">=")})
    gold = M.macro_f1(M.confusion_long(golden(P).filter(F.col("model_id") == "nb"), 3))
    g2 = GT.gate_rows(gold, {"golden_f1": ("macro_f1", 0.5, ">=")})
    # the budget of the gated model itself: naive Bayes, all of it fitted
    n = 3 * H.NUM_FEATURES + 3
    own = spark.createDataFrame([("nb", "log_prior", 3, True), ("nb", "log_theta", n - 3, True)],
                                "model_id string, name string, numel bigint, trainable boolean")
    g3 = GT.gate_rows(B.param_budget(own), {"trainable_pct": ("trainable_pct", 5.0, "<")})
    return g1.unionByName(g2).unionByName(g3)


@query("latency_p95")
def q_latency_p95(spark, sf_dir):
    """A10, G8: the documents of each language scored three times; rows counted by
    ``Observation`` inside the runs, percentiles over the run log."""
    docs = fx.read_documents(spark, sf_dir, "text", "lang")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"] is not None)
    rows = []
    for lang in langs:
        scored = ST.score_projection(docs.filter(F.col("lang") == lang), 42)
        rows += [MS.measured(scored, lang, run) for run in range(3)]
    log = MS.append_log(spark, rows, scratch_path(spark, "run-log"))
    got = GT.latency_report(log, "sec", ("step",))
    counted = log.groupBy("step").agg(F.sum("rows").cast("bigint").alias("rows"), F.min("rows").cast("bigint").alias("rows_per_run"))
    return got.join(counted, "step").select(
        F.col("step").alias("lang"), F.col("n").alias("runs"), "rows_per_run", "rows",
        ((F.col("p50") > 0) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("max"))).alias("ordered"))


@query("registry_row")
def q_registry_row(spark, sf_dir):
    df = S.text_split(spark, sf_dir)
    cfg = {"split_seed": 42, "train_pct": 70, "test_of_holdout_pct": 50, "features": "word_hash_1024",
           "head": "naive_bayes"}
    root = scratch_path(spark, "registry")
    for r in GT.registry_rows(df, cfg, "split").orderBy("split").collect():  # a row per split
        RG.register(spark, root, r["split"], r.asDict())
    rows = RG.records(spark, root).filter(F.col("kind") == "model")
    fields = F.from_json("payload", "n_rows bigint, data_hash string, config_hash string, version string, approver string")
    return rows.select(F.col("model").alias("split"), fields.alias("f")).select("split", "f.*")


@query("registry_approved")
def q_registry_approved(spark, sf_dir):
    """G6: one model per language and a second version of each; the first versions are
    approved, then the second ones of the languages with more train rows than others."""
    train = S.text_split(spark, sf_dir).filter(F.col("split") == "train")
    langs = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label")).alias("s")).orderBy("lang").collect()
    root, first, second = scratch_path(spark, "registry"), {}, {}
    for kept, extra in ((first, 0), (second, 1)):
        for r in langs:
            kept[r["lang"]] = RG.register(spark, root, r["lang"], {"n_rows": r["n"], "labels": r["s"], "round": extra})
    mean = sum(r["n"] for r in langs) / max(1, len(langs))
    for r in langs:
        RG.promote(spark, root, r["lang"], first[r["lang"]], "first")
        if r["n"] > mean:
            RG.promote(spark, root, r["lang"], second[r["lang"]], "second")
    fields = F.from_json("payload", "n_rows bigint, labels bigint, round int").alias("f")
    return RG.approved(spark, root).select(F.col("model").alias("lang"), "version", "approver", fields).select("lang", "version", "approver", "f.*")


# ---- stage 6/7: Spark ML training, ladder, artifacts ---------------------------------
from lexlab.plans import ladder as LD  # noqa: E402
from lexlab.plans import trained_ladder as LD2  # noqa: E402
from lexlab.plans import training as TR  # noqa: E402
from lexlab.sources import manifest as MF  # noqa: E402
from lexlab.sinks import writers as WR  # noqa: E402
from lexlab.operators import measure as MS  # noqa: E402
from lexlab.sinks import registry as RG  # noqa: E402
from lexlab.streaming import metrics as SM  # noqa: E402
from lexlab.streaming import scorer as ST  # noqa: E402


def _emb_train(spark, sf_dir, method):
    """The embeddings with their split, and a head trained on the train rows."""
    df = TR.emb_frame(S.emb_split(spark, sf_dir))
    train = df.filter(F.col("split") == "train")
    return TR.fit(TR.with_weights(train, TR.class_weights(train)), "emb", method), df


def _emb_heads(spark, sf_dir, make):
    """Heads trained on the embeddings, the best pass of each seed, on every split."""
    c, df = S.emb_classes(spark, sf_dir), TN.vector_features(S.emb_split(spark, sf_dir))
    heads = {f"seed{s}": make(s, c) for s in LADDER_SEEDS}
    got = TN.train(df, heads, scratch_path(spark, "trained-emb"), key_col="vec_id")
    P = TN.predictions(df, got.best, ["split", "label"])
    f1 = M.macro_f1(M.confusion_cells(P, ["run", "split"]), ["run", "split"])
    head = heads["seed42"]
    return (f1.join(SU.best_epoch(got.log).select("run", "best_epoch"), "run")
            .select("run", "split", "best_epoch", "n", "macro_f1", "accuracy", F.lit(head.trainable).cast("bigint").alias("trainable_params"),
                    F.lit(head.total).cast("bigint").alias("total_params")))


@query("head_only_train")
def q_head_only_train(spark, sf_dir):
    """M4: all weights of a linear head."""
    return _emb_heads(spark, sf_dir, lambda s, c: TN.LinearHead(s, c, S.EMB_DIM))


@query("rank_r_train")
def q_rank_r_train(spark, sf_dir):
    """M5: two thin factors beside a frozen head."""
    return _emb_heads(spark, sf_dir, lambda s, c: TN.LowRankHead(s, c, S.EMB_DIM, LD2.HEAD_RANK))


def _in_unit(c: str):
    return F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))


@query("ladder_results")
def q_ladder_results(spark, sf_dir):
    r = LD.run_ladder(spark, S.text_split(spark, sf_dir))
    return r.select("experiment_id", "backbone", "method", "seed", "trainable_params", "total_params", "trainable_pct",
                    "output_dir", _in_unit("test_f1_macro").alias("has_test_f1"), _in_unit("val_f1_macro").alias("has_val_f1"))


@query("ladder_summary")
def q_ladder_summary(spark, sf_dir):
    L = cor.with_agreement_level(fx.labelled(spark, sf_dir), "doc_id")
    out = scratch_path(spark, "ladder")
    split = spl.stratified_split(L, label_col="label", key_col="doc_id")
    LD.ladder_with_sinks(spark, split, out, agreement="50")
    summary = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/ladder_summary")
    return summary.select("experiment_id", F.col("n_runs").cast("bigint").alias("n_runs"),
                          (F.col("min").cast("double") <= F.col("mean").cast("double")).alias("min_ok"),
                          (F.col("mean").cast("double") <= F.col("max").cast("double")).alias("max_ok"),
                          F.col("std").isNotNull().alias("has_std"))


@query("trained_ladder")
def q_trained_ladder(spark, sf_dir):
    """M7, M8, K1: the grid by the fixed-step trainer; its results file, read back."""
    out = scratch_path(spark, "trained-ladder")
    LD2.run(spark, S.text_split(spark, sf_dir), out)
    return LD2.read_results(spark, out)


@query("trained_ladder_summary")
def q_trained_ladder_summary(spark, sf_dir):
    """K2, K3, A9, F12: summary file and run configuration read back, with the table of
    parameters and lift over the untrained head as it is printed."""
    out = scratch_path(spark, "trained-ladder")
    LD2.run(spark, S.text_split(spark, sf_dir), out)
    return LD2.comparison(LD2.read_results(spark, out), LD2.read_summary(spark, out), LD2.read_config(spark, out))


@query("reload_parity")
def q_reload_parity(spark, sf_dir):
    model, df = _emb_train(spark, sf_dir, "head_only")
    path = scratch_path(spark, "model-head_only")
    TR.save_model(model, path)
    again = TR.load_model(path)
    test = df.filter(F.col("split") == "test")
    a = TR.predict(model, test).select("vec_id", "label", "pred")
    b = TR.predict(again, test).select("vec_id", "pred")
    pairs = M.pair_predictions(a, b, ["vec_id"])
    return pairs.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                     F.coalesce(F.sum(F.when(F.col("pred_a") != F.col("pred_b"), 1).otherwise(0)), F.lit(0)).cast("bigint")
                     .alias("n_diff"))


@query("score_text_reloaded")
def q_score_text_reloaded(spark, sf_dir):
    """M6, K4: documents without a label scored by a head that was trained on
    text, saved and loaded again; what must hold of every row, by prediction domain."""
    df = S.text_split(spark, sf_dir).select("doc_id", "sentence", "label", "split")
    train = df.filter(F.col("split") == "train")
    path = scratch_path(spark, "model-text")
    TR.save_model(TR.fit(TR.with_weights(train, TR.class_weights(train)), "word_tfidf", "head_only"), path)
    new = fx.unlabelled_documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("sentence"))
    out = TR.load_model(path).transform(new).withColumn("p", vector_to_array("probability"))
    out = out.withColumn("pred", argmax("p"))
    off = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1.0) > 1e-9
    return out.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.countDistinct("doc_id").cast("bigint").alias("n_docs"),
                   F.sum(F.when(F.col("pred").between(0, 2), 0).otherwise(1)).cast("bigint").alias("n_outside"),
                   F.sum(F.when(off, 1).otherwise(0)).cast("bigint").alias("n_bad_sums"))


@query("artifact_manifest")
def q_artifact_manifest(spark, sf_dir):
    """Top folders of a model store with whether they hold bytes, and the rows
    of the split tables in it."""
    store = scratch_path(spark, "model-store")
    for method in ("head_only", "rank_r"):
        TR.save_model(_emb_train(spark, sf_dir, method)[0], f"{store}/{method}")
    WR.write_splits(S.emb_split(spark, sf_dir), f"{store}/splits")
    files = MF.manifest(MF.list_files(spark, store), store)
    top = F.when(F.col("parent").startswith("splits/"), F.col("parent")).otherwise(F.substring_index("parent", "/", 1))
    rows = (spark.read.parquet(f"{store}/splits").groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
            .select(F.concat(F.lit("splits/split="), F.col("split")).alias("folder"), "n_rows"))
    return (files.withColumn("folder", top).groupBy("folder").agg((F.sum("total_bytes") > 0).alias("has_bytes"))
            .filter("folder <> 'splits'").join(rows, "folder", "left"))


def _corpus_file_lines(spark, sf_dir, agreement):
    """Lines of one subset's file: a NUL or a blank line here and there."""
    L = cor.select_agreement(cor.with_agreement_level(fx.labelled(spark, sf_dir), "doc_id"), agreement)
    k = F.substring(seeded_md5("file", "doc_id"), 1, 1)
    body = F.when(k == "0", F.concat(F.lit("a\0b "), one_line("sentence"))).otherwise(one_line("sentence"))
    line = F.concat(body, F.lit("@"), F.col("label_name"))
    return L.select(F.explode(F.when(k == "1", F.array(F.lit(""), line)).when(k == "2", F.array(body, line))
                              .otherwise(F.array(line))).alias("line"))


@query("read_corpus_files")
def q_read_corpus_files(spark, sf_dir):
    """S1, S2, F1, F2: two subsets land as ISO-8859-1 files and are read back, good rows and quarantine."""
    root, parts = scratch_path(spark, "corpus"), []
    for agreement in ("all", "66"):
        cor.write_corpus_lines(_corpus_file_lines(spark, sf_dir, agreement), cor.corpus_path(root, agreement))
        parts.append(cor.tag_agreement(cor.read_corpus(spark, root, agreement)))
    every = parts[0].unionByName(parts[1])
    return every.select("agreement", F.md5("line").alias("line_md5"), F.length("line").cast("bigint").alias("n_chars"),
                        F.md5("sentence").alias("sentence_md5"), "label", "reason")


@query("stream_score")
def q_stream_score(spark, sf_dir):
    root = scratch_path(spark, "stream")
    out = ST.score_stream(spark, sf_dir, f"{root}/out", f"{root}/ckpt", seed=42)
    return out.select("doc_id", "pred", F.round("confidence", 6).alias("confidence"))


def _arrivals(spark, sf_dir):
    """Labelled rows with an event time (a minute per document id) and the landing
    that they come in: four by time, and a few rows one landing late."""
    L = fx.labelled(spark, sf_dir).select("doc_id", "sentence", "label")
    most = L.agg(F.max("doc_id")).first()[0] or 0
    late = (F.substring(seeded_md5("late", "doc_id"), 1, 1) == "0").cast("bigint")
    return L.select("*", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).alias("event_time"),
                    (F.floor(F.col("doc_id") * 4 / (most + 1)) + late).alias("landing"))


@query("stream_metrics")
def q_stream_metrics(spark, sf_dir):
    """ST1: files land one after the other; each time the stream goes on from its
    checkpoint, drops rows of closed windows, and updates the metrics of open ones."""
    root, rows = scratch_path(spark, "stream-metrics"), stage_table(_arrivals(spark, sf_dir), "arrivals")
    for k in range(5):
        rows.filter(F.col("landing") == k).drop("landing").coalesce(1).write.parquet(f"{root}/in/{k}")
        SM.run_available(SM.windowed_cells(SM.score_rows(SM.read_rows(spark, f"{root}/in"))), f"{root}/out", f"{root}/ckpt")
    out = SM.window_metrics(SM.current_cells(spark, f"{root}/out"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("split_test_partition")
def q_split_test_partition(spark, sf_dir):
    """K6: persist the split partitioned by split; a test-only read is
    partition-pruned (only the split=test folder is listed and scanned)."""
    path = scratch_path(spark, "splits")
    WR.write_splits(split_L(spark, sf_dir).select("doc_id", "label", "split"), path)
    return spark.read.parquet(path).filter(F.col("split") == "test").select("doc_id", "label", "split")
