"""The pipeline: each stage against brute force on what the stage before kept."""

import corpus_pipeline as P
from lexlab.llm import linededup as L
from lexlab.llm import quality as Q
from tests.conftest import SF_SMALL
from tests.llm import test_decontaminate as TD
from tests.llm import test_jaccard as TJ
from tests.llm import test_linededup as TL
from tests.llm import test_packing as TP


def test_stages(spark):
    docs = P.table(spark, SF_SMALL, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.stage_table(stage(spark, out[-1], SF_SMALL), f"test-{name}"))
    for df in out[1:-1]:
        assert df.columns == list(P.COLUMNS)
        assert df.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = [[(r["doc_id"], r["text"]) for r in df.collect()] for df in out[:-1]]

    scored = {r["doc_id"]: r["predicted"] for r in Q.classify(docs, P.table(spark, SF_SMALL, "labels")).collect()}
    assert sorted(d for d, _ in rows[1]) == sorted(d for d, p in scored.items() if p)
    assert set(rows[1]) <= set(rows[0])

    want = TL.brute(rows[1])
    after = dict(rows[2])
    for d, t in rows[1]:
        n, gone = want[d]
        if gone == 0:
            assert after[d] == t
        elif d in after:
            assert len(after[d].split("\n")) == n - gone
        else:
            assert gone > 0
    assert {d for d, t in rows[1] if want[d][1] < len(t.split("\n"))} >= set(after)

    assert {d for d, _ in rows[3]} == {c for _, c, _ in TJ.brute(rows[2])}
    items = [(r["item_id"], r["text"]) for r in P.table(spark, SF_SMALL, "benchmark").collect()]
    assert sorted(d for d, _ in rows[4]) == sorted(d for d, _, hit, _ in TD.brute(rows[3], items, 10) if hit == 0)

    packed = out[-1].collect()
    TP.check(packed)
    assert {r["doc_id"] for r in packed} == {d for d, _ in rows[4]}
    assert L.MIN_WORDS == 5


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", None, 1), (2, "", "en", "s", 0, 1), (3, "a b c d e f g\nh", None, None, 15, 2),
         (4, "a b c d e f g\nh", "en", "s", 15, 3), (4, "a b c d e f g\nh", "en", "s", 15, 3), (None, "x y z", "en", "s", 5, 4),
         (5, "word " * 30_000, "en", "s", 150_000, 5)],
        "doc_id long, text string, lang string, source string, n_chars long, hash int")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for name, stage in P.STAGES:
            kept = P.stage_table(stage(spark, kept, SF_SMALL), f"test-{name}")
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids <= {1, 2, 3, 4, 5, None}
    assert 4 not in ids


def test_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is P.run and "pipeline" not in entry.oracle_sql()
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
