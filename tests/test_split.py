import pytest
from pyspark.sql import functions as F

from lexlab.operators import split as spl
from lexlab.sources import fixtures as fx

from conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("n,test,val,train", [(87, 14, 13, 60), (100, 15, 15, 70),
                                              (399, 60, 60, 279), (3980, 597, 597, 2786)])
def test_split_sizes_exact(n, test, val, train):
    assert spl.split_sizes(n) == {"train": train, "validation": val, "test": test}


@pytest.mark.parametrize("sf,n", [(SF_SMALL, 87), (SF_MID, 399)])
def test_split_sizes_on_fixture(spark, sf, n):
    L = fx.labelled(spark, sf)
    s = spl.stratified_split(L)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == spl.split_sizes(n)
    assert s.select("doc_id").distinct().count() == n


def test_per_class_within_one_of_quota(spark):
    L = fx.labelled(spark, SF_MID)
    s = spl.stratified_split(L)
    per = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n_c = {r.label: r["count"] for r in L.groupBy("label").count().collect()}
    n = sum(n_c.values())
    for c, k in n_c.items():
        share = per.get((c, "train"), 0)
        assert abs(share - k * spl.split_sizes(n)["train"] / n) < 1.0


def test_repartition_invariant(spark):
    L = fx.labelled(spark, SF_MID)
    a = {(r.doc_id, r.split) for r in spl.stratified_split(L).select("doc_id", "split").collect()}
    b = {(r.doc_id, r.split) for r in
         spl.stratified_split(L.repartition(13, "sentence")).select("doc_id", "split").collect()}
    assert a == b


def test_exact_matches_full_rank(spark):
    """Histogram-cut assignment equals a plain rank-within-class assignment."""
    from pyspark.sql import Window
    from lexlab.functions.exprs import seeded_md5
    L = fx.labelled(spark, SF_MID).select("doc_id", "label")
    s = spl.stratified_split(L)
    q = spl.quotas_from_counts({r.label: r["count"] for r in L.groupBy("label").count().collect()})
    q = spark.createDataFrame([(c, v, t) for c, (_, v, t) in q.items()], "label int, val_c long, test_c long")
    r = (L.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(seeded_md5(42, "doc_id"))))
         .join(q, "label")
         .withColumn("split", F.when(F.col("_r") <= F.col("test_c"), "test")
                     .when(F.col("_r") <= F.col("test_c") + F.col("val_c"), "validation").otherwise("train")))
    assert {(x.doc_id, x.split) for x in s.collect()} == {(x.doc_id, x.split) for x in r.collect()}


def test_null_labels_null_keys_and_repeated_keys(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(100)]
    s = spl.stratified_split(spark.createDataFrame(rows, "doc_id long, label int"))
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == spl.split_sizes(100)
    assert s.filter("label IS NULL").count() == 20 and s.columns == ["doc_id", "label", "split"]
    twice = spl.stratified_split(spark.createDataFrame(rows * 2, "doc_id long, label int"))
    assert twice.groupBy("doc_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    assert twice.count() == 200
    nulls = spl.stratified_split(spark.createDataFrame([(None, 0)] * 4 + [(i, 0) for i in range(16)], "doc_id long, label int"))
    assert nulls.filter("doc_id IS NULL").select("split").distinct().count() == 1 and nulls.count() == 20
    assert spl.stratified_split(spark.createDataFrame([], "doc_id long, label int")).count() == 0


def test_split_does_not_depend_on_partitions_or_size_settings(spark):
    L = fx.labelled(spark, SF_SMALL).select("doc_id", "label", "sentence")
    base = sorted((r.doc_id, r.split) for r in spl.stratified_split(L).collect())
    spark.conf.set("spark.lexlab.text.partitions", "5")
    try:
        again = fx.labelled(spark, SF_SMALL)
        assert again.count() == len(base)
        assert sorted((r.doc_id, r.split) for r in spl.stratified_split(again).select("doc_id", "split").collect()) == base
    finally:
        spark.conf.unset("spark.lexlab.text.partitions")


def test_group_mode_keeps_copies_together(spark):
    # copies share their label (grouping holds within a class stratum)
    df = spark.createDataFrame([(i, (i % 40) % 3, f"text{i % 40}") for i in range(400)],
                               "doc_id long, label int, text string")
    s = spl.stratified_split(df, group_col="text")
    bad = s.groupBy("text").agg(F.countDistinct("split").alias("k")).filter("k > 1").count()
    assert bad == 0


def test_disjoint_report(spark):
    L = fx.labelled(spark, SF_SMALL).select("doc_id", "label")
    r = spl.split_disjoint(L, spl.stratified_split(L)).first()
    assert (r.n_source, r.n_assigned, r.n_multi_split, r.n_missing, r.n_extra) == (87, 87, 0, 0, 0)


def _exchanges(df) -> list[str]:
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)[^\n]*", plan)


def test_labelling_rows_adds_no_exchange(spark):
    """On a scan without joins the plan of either mode has no exchange and no window at all."""
    docs = fx.read_table(spark, SF_SMALL, "labels").select("doc_id", F.col("quality").alias("label"))
    for mode in ("hash", "exact"):
        df = spl.stratified_split(docs, mode=mode)
        assert _exchanges(df) == []
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(_exchanges(docs.groupBy("label").count())) == 1  # the check does see one


def test_disjoint_report_needs_one_keyed_exchange(spark):
    src = fx.read_table(spark, SF_SMALL, "labels").select("doc_id", F.col("quality").alias("label"))
    kinds = _exchanges(spl.split_disjoint(src, spl.stratified_split(src)))
    assert sorted(kinds) == ["SinglePartition", "hashpartitioning"]


def test_sample_is_top_k(spark):
    L = fx.labelled(spark, SF_SMALL)
    plan = spl.sample_rows(L, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert spl.sample_rows(L, 5).count() == 5


def test_hot_group_stays_whole_and_split_stays_exact_elsewhere(spark):
    # one group of copies holds a third of all rows
    rows = [(i, 0, "hot") for i in range(1000)] + [(1000 + i, i % 2, f"u{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    s = spl.stratified_split(df, group_col="text")
    hot = s.filter("text = 'hot'").select("split").distinct().count()
    assert hot == 1
    per = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert sum(per.values()) == 3000
    # class 1 has no copies: its shares are exact
    q = spl.quotas_from_counts({0: 2000, 1: 1000})
    assert (per.get((1, "train"), 0), per.get((1, "validation"), 0), per.get((1, "test"), 0)) == q[1]


def test_pad_batches_properties(spark):
    from lexlab.operators import text as T
    docs = fx.read_documents(spark, SF_SMALL, "text")
    ids = T.tokenize(docs, "text", "tokens", None).withColumn("ids", T.token_ids("tokens"))
    b = T.pad_batches(ids.select("doc_id", "ids", "n_tokens"), "ids", "doc_id", batch_size=32, n_buckets=3)
    some = T.pad_batches(ids.select("doc_id", "ids").repartition(5).filter("doc_id < 50"), "ids", "doc_id")
    every = T.pad_batches(ids.select("doc_id", "ids"), "ids", "doc_id")
    buckets = {r.doc_id: r.bucket for r in every.select("doc_id", "bucket").collect()}
    assert all(buckets[r.doc_id] == r.bucket for r in some.select("doc_id", "bucket").collect())  # at any table size
    rows = b.select("bucket", "batch_no", "seq_len", "padded_len", "input_ids", "attention_mask", "n_tokens").collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[(r.bucket, r.batch_no)] = sizes.get((r.bucket, r.batch_no), 0) + 1
        assert len(r.input_ids) == len(r.attention_mask) == r.padded_len
        assert sum(r.attention_mask) == r.seq_len == r.n_tokens
        assert all(i == 0 for i in r.input_ids[r.seq_len:])
    assert max(sizes.values()) <= 32
    per_batch = {}
    for r in rows:
        per_batch.setdefault((r.bucket, r.batch_no), set()).add(r.padded_len)
    assert all(len(v) == 1 for v in per_batch.values())


def test_hash_mode_shares(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("label", (F.col("doc_id") % 3).cast("int"))
    c = {r.split: r["count"] for r in spl.stratified_split(df, mode="hash").groupBy("split").count().collect()}
    assert abs(c["test"] / 20000 - 0.15) < 0.02 and abs(c["validation"] / 20000 - 0.15) < 0.02
