"""Prepared-table store, scoring by a stored parameter table, two-level batch numbers."""

import math
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlab.operators import term_scoring as TS
from lexlab.operators import text as T
from lexlab.session import local_path, scratch_path
from lexlab.store import PreparedStore, address, store
from tests.conftest import SF_SMALL


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_three_metric_keys_prepare_once(spark):
    from __spark_entry__ import queries
    st = store(spark)
    st.clear()
    before, reg = st.written, queries()
    counts = [jobs(spark, f"store-{k}", lambda k=k: reg[k](spark, SF_SMALL).collect()) for k in ("macro_f1", "lift", "confusion_long")]
    assert st.written == before + 1 and [e.hits for e in st.entries.values()] == [2]
    assert counts[1] < counts[0]
    table = next(iter(st.entries.values())).table
    path = local_path(table.inputFiles()[0]).rsplit("/", 1)[0]
    for _ in range(3):
        st.release(table)
    assert st.evict() == 1 and not __import__("os").path.exists(path)
    with pytest.raises(ValueError):
        st.release(table)


def test_address_follows_plan_schema_and_files(spark):
    folder = local_path(scratch_path(spark, "inputs"))
    spark.range(10).write.parquet(folder)
    read = lambda: spark.read.parquet(folder)
    a = read().select((F.col("id") + 1).alias("x"))
    assert address(a) == address(read().select((F.col("id") + 1).alias("x")))
    assert len({address(d) for d in (a, read().select((F.col("id") + 2).alias("x")), read().select((F.col("id") + 1).alias("y")))}) == 3
    old = address(a)
    spark.range(20).write.mode("append").parquet(folder)
    assert address(read().select((F.col("id") + 1).alias("x"))) != old
    st = PreparedStore()
    one = st.acquire(read(), "t")
    assert st.acquire(read(), "t") is one and st.written == 1
    shutil.rmtree(local_path(one.inputFiles()[0]).rsplit("/", 1)[0])  # a table whose files are gone is written again
    assert st.acquire(read(), "t").count() == 30 and st.written == 2
    st.clear()


def plain_bayes(train, docs, classes):
    words = lambda t: [w for w in re.split(r"\W+", (t or "").lower()) if w]
    counts = [Counter() for _ in range(classes)]
    for text, y in train:
        counts[y].update(words(text))
    vocab = set().union(*counts)
    prior = [sum(y == c for _, y in train) / len(train) for c in range(classes)]
    out = []
    for text in docs:
        z = [(math.log(p) if p else -1e300) + sum(math.log((counts[c][w] + 1) / (sum(counts[c].values()) + len(vocab)))
                                                 for w in words(text) if w in vocab) for c, p in enumerate(prior)]
        e = [math.exp(v - max(z)) for v in z]
        out.append([v / sum(e) for v in e])
    return out


def test_scoring_by_table_against_a_plain_bayes(spark):
    train = [("good fine good", 1), ("bad poor", 0), ("fine day", 1), ("", 0), ("meh the", 2), ("bad the the", 0)]
    docs = ["good the", "bad bad day", "unknown words only", "", None, "the " * 50, "fine poor meh"] + [f"the word{i} good" for i in range(300)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(train)], "doc_id long, sentence string, label int")
    odd = df.unionByName(spark.createDataFrame([(90, "skip me", None), (91, "and me", 7)], df.schema))
    path = scratch_path(spark, "model")
    TS.fit_term_bayes(TS.term_counts(odd, keep=["label"]), odd, 3).save(path)
    new = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in TS.score_terms(new, TS.term_counts(new, "text"), TS.TermModel.load(spark, path)).collect()}
    assert len(got) == len(docs)
    for i, p in enumerate(plain_bayes(train, docs, 3)):
        assert got[i]["probs"] == pytest.approx(p, abs=1e-9) and got[i]["confidence"] == pytest.approx(max(p), abs=1e-9)


def test_a_model_of_a_million_terms_scores(spark):
    n = 1_000_000
    params = spark.range(n).select(F.concat(F.lit("t"), F.col("id")).alias("term"),
                                   F.array((F.col("id") % 7 - 3) / 10.0, (F.col("id") % 11 - 5) / 10.0).alias("weights"))
    path = scratch_path(spark, "large")
    TS.TermModel(params, [0.1, -0.2]).save(path)
    docs = spark.range(500)
    picked = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: (F.col("id") * 99991 + k * k * 31337) % n)
    counts = docs.select(F.col("id").alias("doc_id"), F.explode(picked).alias("i")).unionAll(
        docs.select("id", F.lit(5).cast("long")))  # term t5 is in every document
    counts = counts.groupBy("doc_id", F.concat(F.lit("t"), F.col("i")).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    got = TS.score_terms(docs.select(F.col("id").alias("doc_id")), counts, TS.TermModel.load(spark, path))
    counts.createOrReplaceTempView("large_counts")
    want = spark.sql("""SELECT doc_id, sum(n * ((i % 7 - 3) / 10.0D)) + 0.1D AS a, sum(n * ((i % 11 - 5) / 10.0D)) - 0.2D AS b
                        FROM (SELECT doc_id, n, cast(substr(term, 2) AS bigint) AS i FROM large_counts) GROUP BY doc_id""")
    off = got.join(want, "doc_id").filter(F.abs(F.col("probs")[0] - 1 / (1 + F.exp(F.col("b") - F.col("a")))) > 1e-9)
    assert got.count() == 500 and off.count() == 0
    plan = got._jdf.queryExecution().toString()
    assert len(plan) < 200_000  # no model in the plan


@pytest.mark.parametrize("partitions", [4, 64])
def test_batches_do_not_depend_on_partitions(spark, partitions):
    rows = [(i * 37 % 1000, [1] * (i % 50)) for i in range(1000)] + [(5, [1] * 70), (5, [2] * 3), (None, [3])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(partitions)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = T.pad_batches(df, "ids", "doc_id", batch_size=7, n_buckets=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    import hashlib
    bucket = lambda k: None if k is None else int(hashlib.md5(f"batch:{k}".encode()).hexdigest()[:8], 16) % 3
    assert len(got) == len(rows)
    by = Counter((r["bucket"], r["batch_no"]) for r in got)
    for b in {bucket(k) for k, _ in rows}:
        keys = sorted((k for k, _ in rows if bucket(k) == b), key=lambda k: (k is not None, k))
        assert [by[b, j] for j in range(-(-len(keys) // 7))] == [len(keys[j:j + 7]) for j in range(0, len(keys), 7)]
        want = Counter((k, j // 7) for j, k in enumerate(keys))
        assert Counter((r["doc_id"], r["batch_no"]) for r in got if r["bucket"] == b) == want
    for r in got:
        mates = [len(x["ids"]) for x in got if (x["bucket"], x["batch_no"]) == (r["bucket"], r["batch_no"])]
        assert r["padded_len"] == max(mates) == len(r["input_ids"]) == len(r["attention_mask"])


def test_no_window_over_a_bucket(spark):
    df = spark.createDataFrame([(1, [1])], "doc_id long, ids array<int>")
    plan = T.pad_batches(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and not any(re.search(r", \[bucket#\d+\], ", line) for line in windows)


def test_words_are_counted_in_batches_without_a_table_of_pairs(spark):
    rows = [(1, "b a b", 0), (1, "b c", 0), (1, "c", 1), (None, "x X", 2), (None, None, 2), (3, None, None), (4, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, sentence string, label int").repartition(4)
    got = TS.term_counts(df, keep=["label"])
    assert Counter(tuple(r) for r in got.collect()) == Counter(
        [(1, 0, "a", 1), (1, 0, "b", 3), (1, 0, "c", 1), (1, 1, "c", 1), (None, 2, "x", 2)])
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "label:int", "term:string", "n:bigint"]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per word before they are counted
