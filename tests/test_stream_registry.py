"""Stream of metrics, append-only registry, measured runs."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlab.operators import gates as G
from lexlab.operators import measure as MS
from lexlab.plans import queries as Q
from lexlab.session import local_path, scratch_path
from lexlab.sinks import registry as R
from lexlab.streaming import metrics as SM
from tests.conftest import SF_MID

BASE = 1_704_067_200


def land(spark, root, k, rows):
    df = spark.createDataFrame([(i, t, y, BASE + 60 * m) for i, t, y, m in rows], "doc_id long, sentence string, label int, s long")
    df = df.select("doc_id", "sentence", "label", F.timestamp_seconds("s").alias("event_time"))
    df.coalesce(1).write.parquet(f"{root}/in/{k}")


def step(spark, root):
    cells = SM.windowed_cells(SM.score_rows(SM.read_rows(spark, f"{root}/in")))
    SM.run_available(cells, f"{root}/out", f"{root}/ckpt")


def test_late_rows_restart_and_repeated_batches(spark):
    root = scratch_path(spark, "stream")
    rows = [(i, f"word{i} text", i % 3, i) for i in range(200)]
    land(spark, root, "a", rows[:150])  # minutes 0 to 149: the mark is then at 119
    step(spark, root)
    late = [(900, "closed window", 1, 5), (901, "closed window", 1, 119), (902, "open window", 1, 121)]  # 119 is in the window that ends at 120
    land(spark, root, "b", rows[150:] + late)
    step(spark, root)  # another query, which goes on from the checkpoint
    step(spark, root)  # nothing new
    got = {r["window_start"].timestamp(): r["n"] for r in
           SM.current_cells(spark, f"{root}/out").groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    minutes = Counter(m // 60 for i, _, _, m in rows + late if i != 900)
    want = {}
    for hour, n in minutes.items():
        want[BASE + 3600 * hour] = n
    assert sorted(got.values()) == sorted(want.values())
    # a batch that is run again overwrites its own folder
    before = sorted(map(str, SM.current_cells(spark, f"{root}/out").collect()))
    again = spark.read.schema(SM.CELL_SCHEMA).parquet(f"{root}/out/cells-{0:010d}").drop("batch").collect()
    SM.write_batch(spark.createDataFrame(again, SM.current_cells(spark, f"{root}/out").schema), 0, f"{root}/out")
    assert sorted(map(str, SM.current_cells(spark, f"{root}/out").collect())) == before
    assert SM.window_metrics(SM.current_cells(spark, f"{root}/out")).count() == len(want)


def test_the_query_drops_rows_and_keeps_others_that_come_late(spark):
    rows = Q._arrivals(spark, SF_MID)
    total = Q.q_stream_metrics(spark, SF_MID).agg(F.sum("n")).first()[0]
    on_time = rows.filter("landing = floor(doc_id * 4 / (select max(doc_id) + 1 from parquet.`%s/labels.parquet`))" % SF_MID).count()
    assert on_time <= total < rows.count()


def test_two_writers_at_once_leave_all_versions(spark):
    root, got = scratch_path(spark, "registry"), []

    def write(name):
        for k in range(6):
            got.append(R.register(spark, root, name, {"k": k}))

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b", "c")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(1, 19))
    assert Counter((r["model"], r["payload"]) for r in R.records(spark, root).collect()) == Counter(
        (n, '{"k": %d}' % k) for n in "abc" for k in range(6))
    with pytest.raises(R.VersionTaken):
        R.write_version(spark, root, 3, "model", "late", {})


def test_promotion_reads_the_last_approved(spark):
    root = scratch_path(spark, "registry")
    first, second = R.register(spark, root, "m", {"f1": 0.5}), R.register(spark, root, "m", {"f1": 0.7})
    assert R.approved(spark, root).count() == 0
    R.promote(spark, root, "m", second, "x")
    R.promote(spark, root, "m", first, "y")  # back to the first one
    (row,) = R.approved(spark, root).collect()
    assert (row["version"], row["approver"], row["payload"]) == (first, "y", '{"f1": 0.5}')
    with pytest.raises(ValueError):
        R.promote(spark, root, "m", 99, "z")
    with open(f"{local_path(root)}/v{77:012d}.json", "w") as f:
        f.write('{"version": 77, "ki')  # a writer died here
    assert R.records(spark, root).count() == 4 and R.register(spark, root, "m", {}) == 78


def test_rows_are_counted_inside_the_run(spark):
    df = spark.range(1000).filter("id % 7 = 0")
    log = MS.append_log(spark, [MS.measured(df, "a", k) for k in range(3)] + [MS.measured(df.limit(0), "b")], scratch_path(spark, "log"))
    assert {(r["step"], r["rows"]) for r in log.collect()} == {("a", 143), ("b", 0)}
    assert all(r["sec"] > 0 for r in log.collect())
    got = {r["step"]: r for r in G.latency_report(log, "sec", ("step",)).collect()}
    assert got["a"]["n"] == 3 and got["a"]["p50"] <= got["a"]["p95"] <= got["a"]["max"]


def test_stream_scores_a_table_of_one_file_and_of_many(spark):
    from lexlab.streaming import scorer as ST
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"), F.lit("en").alias("lang"),
                                  F.lit("web").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    many, one = scratch_path(spark, "many"), scratch_path(spark, "one")
    docs.repartition(3).write.parquet(f"{many}/documents.parquet")
    docs.limit(1).write.parquet(f"{many}/other.parquet")
    docs.coalesce(1).write.parquet(f"{one}/parts")
    name = next(f for f in spark.read.parquet(f"{one}/parts").inputFiles()).rsplit("/", 1)[1]
    import os
    import shutil
    shutil.copy(f"{local_path(one)}/parts/{name}", f"{local_path(one)}/documents.parquet")
    assert os.path.isfile(f"{local_path(one)}/documents.parquet")
    want = sorted(map(str, ST.score_projection(docs).collect()))
    for root in (many, one):
        got = ST.score_stream(spark, root, f"{root}/out", f"{root}/ckpt")
        assert sorted(map(str, got.collect())) == want
