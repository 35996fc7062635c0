"""Decontamination: against brute force, the SQL, and edge cases."""

import re

from pyspark.sql import functions as F

from lexlab.llm import decontaminate as D
from tests.conftest import SF_SMALL

WORD = re.compile(D.WORD)


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - window + 1, 1) if w else 0):
            wins.setdefault(tuple(w[s:s + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s:s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[x]
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    df = D.decontaminate(spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, words string"),
                         spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, win string"), **kw)
    return df.collect()


DOCS = [(1, "the cat sat on The MAT, and a b c"), (2, ""), (3, None), (4, "a a a a a a a a"), (4, "a a a a a a a a"),
        (5, "b c d e"), (6, "été 2 ÉTÉ 2 the cat sat"), (7, "x" * 50_000 + " the cat sat on the mat " + "y " * 30_000),
        (None, "sat on the mat and"), (8, "mat the on sat cat the")]
ITEMS = [(10, "The cat sat on the mat"), (2, "a a"), (3, "b"), (4, ""), (5, None), (6, "été 2 ÉtÉ"), (10, "a b c d e f"),
         (7, "sat on the mat and")]


def test_brute_force_and_edges(spark):
    for window in (3, 10):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in run(spark, DOCS, ITEMS, window=window)), key=repr)
        assert got == brute(DOCS, ITEMS, window)
        blocks = run(spark, DOCS, ITEMS, window=window, max_broadcast_terms=4)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in blocks), key=repr) == got
        for r in blocks:
            assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"])


def test_empty_sides(spark):
    assert run(spark, [], ITEMS) == []
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in run(spark, DOCS, []))


def test_proximity(spark):
    rows = {r["doc_id"]: r for r in run(spark, [(8, "mat the on sat cat the"), (9, "nothing here at all")],
                                        [(1, "the cat sat on the mat")], slop=2)}
    assert rows[8]["near_items"] == ["1"] and rows[8]["n_hit"] == 0
    assert rows[9]["near_items"] == []


def test_oracle(spark):
    from lexlab.plans.compare import compare, duck_connect
    t = {n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("documents", "benchmark")}
    df = D.digest(D.decontaminate(t["documents"], t["benchmark"]))
    res = compare(df, duck_connect(SF_SMALL), D.oracle_sql())
    assert res["match"], res
    assert df.filter("contaminated").count() > 0
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    # giant words: few windows, but more bytes than are broadcast
    docs, items = DOCS + [(9, "w" * 3_000 + " a b c d e f")], ITEMS + [(11, "w" * 3_000 + " a")]
    want = brute(docs, items, 3)
    for limit in (D.MAX_BROADCAST_BYTES, 1_000):
        monkeypatch.setattr(D, "MAX_BROADCAST_BYTES", limit)
        got = run(spark, docs, items, window=3)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == want


def test_window_shared_by_many_items_and_documents(spark):
    docs = [(d, f"one two three four d{d}") for d in range(200)]
    items = [(i, "one two three four") for i in range(50)] + [(99, "three four d7")]
    got = {r["doc_id"]: r for r in run(spark, docs, items, window=4)}
    every = sorted(map(str, range(50)))
    assert all(r["n_hit"] == (5 if d == 7 else 4) and list(r["items"]) == (sorted(every + ["99"]) if d == 7 else every)
               for d, r in got.items())
    # a window's items do not travel with its hits
    plan = D.decontaminate(*(spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))))
    assert "salt" in plan._jdf.queryExecution().toString()


def test_words_are_the_matches(spark):
    texts = ["", " ", "A", " a  B ", "été x_y-9", "\U0001f600 ab\U0001f600", "\x00a\x7fb\x80c", "É,É", "a\n\nb\r"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", D.words_of(F.col("text")).alias("w")).collect()
    for r in rows:
        low = "".join(c.lower() if c.isascii() else c for c in r["text"] or "")
        assert list(r["w"]) == re.findall(D.WORD, low)


def test_needs_no_rows_of_the_driver(spark, monkeypatch):
    # rows made in Python go through Python workers, which then stay in the executors
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((DOCS, "doc_id"), (ITEMS, "item_id")))

    def refused(*a, **k):
        raise AssertionError("rows made on the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    got = D.decontaminate(docs, items, window=3).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == brute(DOCS, ITEMS, 3)
