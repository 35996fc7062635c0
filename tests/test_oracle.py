"""Each SQL-keyed query against its DuckDB oracle, plus plan checks."""

import pytest

from lexlab.plans.compare import compare, duck_connect

from conftest import SF_SMALL

FAST_KEYS = ["class_distribution", "label_decode", "label_remap", "stratified_split", "split_counts",
             "split_disjoint", "sample_rows", "parse_labelled_lines", "parse_quarantine",
             "select_agreement", "tokenize_truncate", "pad_batches", "score_fixed_head",
             "confusion_long", "classification_report", "macro_f1", "lift", "param_budget",
             "stream_score", "split_test_partition", "vocab_counts", "calibration_ece",
             "confusion_out_of_domain", "macro_f1_null_group", "gate_report", "domain_shift", "slice_report",
             "registry_row", "head_only_train", "rank_r_train", "reload_parity", "artifact_manifest",
             "read_corpus_files", "latency_p95", "score_text_reloaded", "epoch_log", "best_epoch", "user_metric",
             "score_term_table", "registry_approved", "stream_metrics",
             "trained_ladder", "trained_ladder_summary"]


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", FAST_KEYS)
def test_query_matches_oracle(spark, duck, key):
    from __spark_entry__ import oracle_sql, queries
    res = compare(queries()[key](spark, SF_SMALL), duck, oracle_sql()[key])
    assert res["match"], res


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["model_id", "split", "row_name", "precision", "recall", "f1", "support"]


def test_every_key_has_an_oracle():
    from lexlab.plans.oracle import ORACLE
    from lexlab.plans.queries import REGISTRY
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("key", ["stratified_split", "score_new_text", "classification_report",
                                 "vocab_counts", "pad_batches"])
def test_no_python_udf_in_plan(spark, key):
    from __spark_entry__ import queries
    plan = queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert node not in plan


def test_scan_prunes_columns(spark):
    from __spark_entry__ import queries
    import re
    plan = queries()["class_distribution"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(read) == ["doc_id:bigint", "doc_id:bigint,quality:int,toxic:int"]


def test_vocab_counts_single_shuffle(spark):
    from __spark_entry__ import queries
    plan = queries()["vocab_counts"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1
    assert "partial_sum" in plan
