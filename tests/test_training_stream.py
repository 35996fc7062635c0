import pytest
from pyspark.sql import functions as F

from lexlab.operators import gates as GT
from lexlab.operators import metrics as M
from lexlab.plans import ladder as LD
from lexlab.plans import scoring as S
from lexlab.plans import training as TR
from lexlab.session import scratch_path
from lexlab.streaming import scorer as ST

from conftest import SF_MID, SF_SMALL


def _majority_macro_f1(spark, df):
    top = df.filter("split = 'train'").groupBy("label").count().orderBy(F.desc("count")).first().label
    P = df.filter("split = 'test'").withColumn("pred", F.lit(top))
    return M.macro_f1(M.confusion_long(P, 3)).first().macro_f1


@pytest.fixture(scope="module")
def text_split(spark):
    return S.text_split(spark, SF_MID).select("doc_id", "sentence", "label", "split").cache()


def test_head_only_beats_majority_and_is_repeatable(spark, text_split):
    train = text_split.filter("split = 'train'")
    train = TR.with_weights(train, TR.class_weights(train))
    scores = []
    for _ in range(2):
        model = TR.fit(train, "char3_tfidf", "head_only")
        P = TR.predict(model, text_split.filter("split = 'test'"))
        scores.append(M.macro_f1(M.confusion_long(P, 3)).first().macro_f1)
    assert scores[0] == scores[1]
    assert scores[0] > _majority_macro_f1(spark, text_split)


def test_reload_parity(spark):
    df = TR.emb_frame(S.emb_split(spark, SF_SMALL))
    train = TR.with_weights(df.filter("split = 'train'"), TR.class_weights(df.filter("split = 'train'")))
    model = TR.fit(train, "emb", "rank_r")
    path = scratch_path(spark, "m")
    TR.save_model(model, path)
    a = TR.predict(model, df).select("vec_id", "label", "pred")
    b = TR.predict(TR.load_model(path), df).select("vec_id", "pred")
    pairs = M.pair_predictions(a, b, ["vec_id"])
    assert pairs.filter("pred_a <> pred_b").count() == 0
    assert pairs.count() == df.count()


def test_ladder_smoke_subset(spark):
    split = S.text_split(spark, SF_SMALL)
    ids = LD.select_experiments("word_tfidf", ["eval_only", "head_only"])
    res = LD.run_ladder(spark, split, seeds=[42], experiments=ids)
    rows = {r.experiment_id: r for r in res.collect()}
    assert set(rows) == set(ids)
    assert rows["word_tfidf_eval_only"].val_f1_macro is None
    assert rows["word_tfidf_head_only"].trainable_params > 0
    with pytest.raises(ValueError):
        LD.run_ladder(spark, split, seeds=[42], experiments=["nope"])


def test_stream_equals_batch(spark):
    root = scratch_path(spark, "st")
    out = ST.score_stream(spark, SF_SMALL, f"{root}/o", f"{root}/c")
    batch = ST.score_projection(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    a = sorted((r.doc_id, r.pred, round(r.confidence, 9)) for r in out.collect())
    b = sorted((r.doc_id, r.pred, round(r.confidence, 9)) for r in batch.collect())
    assert a == b


def test_latency_report(spark):
    log = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "method string, ms double")
    r = GT.latency_report(log, "ms", ("method",)).first()
    assert r.n == 100 and r.p95 == 95.0 and r.max == 100.0


def test_registry_hash_is_order_free(spark):
    df = S.text_split(spark, SF_SMALL)
    a = {r.split: r.data_hash for r in GT.registry_rows(df, {"k": 1}).collect()}
    b = {r.split: r.data_hash for r in GT.registry_rows(df.repartition(7), {"k": 1}).collect()}
    assert a == b


def test_runs_differ_by_seed_and_release_their_cache(spark, monkeypatch):
    split = S.text_split(spark, SF_MID)
    one = LD.run_experiment(spark, split, "word_tfidf_head_only", 42, max_iter=5).first()
    two = LD.run_experiment(spark, split, "word_tfidf_head_only", 43, max_iter=5).first()
    assert one.output_dir != two.output_dir and one.test_f1_macro != two.test_f1_macro
    again = LD.run_experiment(spark, split, "word_tfidf_head_only", 42, max_iter=5).first()
    assert again == one
    before = set(spark.sparkContext._jsc.getPersistentRDDs())

    def fails(prepared, *args):
        prepared.count()
        raise RuntimeError("a run failed")

    monkeypatch.setattr(LD, "_run", fails)
    with pytest.raises(RuntimeError):
        LD.run_ladder(spark, split, [42], ["word_tfidf_eval_only"])
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before
    g = LD.grid(spark, [1, 2], ["word_tfidf_rank_r"]).collect()
    assert [(r.seed, r.method) for r in g] == [(1, "rank_r"), (2, "rank_r")]


def test_storage_raises_without_a_shared_folder(spark):
    from lexlab import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
    assert session.scratch_path(Session(), "x", "/shared").startswith("/shared/x-")
    staged = session.stage_table(spark.range(3), "t")
    import os
    path = session.local_path(staged.inputFiles()[0])
    session.drop_staged(staged)
    assert not os.path.exists(path)


def test_manifest_cuts_by_the_qualified_root(spark):
    from lexlab.sources import manifest as MF
    root = scratch_path(spark, "store") + "/a.b(1)/store/y/store"
    spark.range(2).coalesce(1).write.parquet(f"{root}/m/store")
    parents = {r.parent for r in MF.manifest(MF.list_files(spark, root), root).collect()}
    assert parents == {"m/store"}


def test_registered_ladders_run_whole_and_agreement_selects(spark, monkeypatch):
    from lexlab.plans import queries as Q
    from lexlab.sources import corpus as cor
    from lexlab.sources import fixtures as fx
    seen, run = [], LD.run_ladder_with_log

    def small(spark, split, seeds, experiments, out_dir, max_iter):
        seen.append((split.count(), max_iter, list(seeds), list(experiments)))
        return run(spark, split, [42], ["word_tfidf_eval_only"])

    monkeypatch.setattr(LD, "run_ladder_with_log", small)
    labelled = fx.labelled(spark, SF_SMALL)
    for key in ("ladder_results", "ladder_summary"):
        Q.REGISTRY[key](spark, SF_SMALL).collect()
    assert seen == [(labelled.count(), LD.MAX_ITER, list(LD.LADDER_SEEDS), [])] * 2
    rows = cor.with_agreement_level(S.text_split(spark, SF_SMALL), "doc_id")
    out = scratch_path(spark, "agreement")
    LD.ladder_with_sinks(spark, rows, out, agreement="75")
    assert seen[-1][0] == rows.filter("agreement_pct >= 75").count() < rows.count()
    assert '"agreement":"75"' in "".join(r.value for r in spark.read.text(f"{out}/run_config").collect()).replace(" ", "")


def test_texts_are_hashed_once_for_all_fits_of_a_feature_set(spark):
    split = S.text_split(spark, SF_SMALL)
    ready = LD.prepare(split, "char3_tfidf", "finance")
    assert "sentence" not in ready.columns and ready.filter("split <> 'test' and idx is not null").count() == 0
    train = TR.with_weights(ready.filter("split = 'train'"), {0: 1.0, 1: 2.0, 2: 0.5}).persist()
    model, whole = TR.fit_counted(train, "char3_tfidf", "head_only", 5)
    assert len(whole.stages) == len(model.stages) + len(TR.counting("char3_tfidf").stages)
    a = {r["doc_id"]: r["pred"] for r in TR.predict(model, ready).select("doc_id", "pred").collect()}
    b = {r["doc_id"]: r["pred"] for r in TR.predict(whole, split).select("doc_id", "pred").collect()}
    assert a == b
    train.unpersist()
