"""Line dedup: against pairwise brute force, and edge cases."""

import random

from pyspark.sql import functions as F

from lexlab.llm import linededup as L
from tests.conftest import SF_SMALL


def lcs(a, b):
    """Positions of b on a longest common subsequence; keys are unique, so any
    longest one has this length."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def brute(rows):
    """For each document: for each earlier one that is first with some of its
    lines, how many of those align."""
    holder, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        keys = L.line_keys(t) if t else []
        total = 0
        for e in {holder[k][0] for k in keys if k in holder}:
            shared = [k for k in keys if k in holder and holder[k][0] == e]
            total += lcs(sorted(shared, key=lambda k: holder[k][1]), shared)
        out[d] = (len(keys), total)
        for i, k in enumerate(keys):
            holder.setdefault(k, (d, i))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in L.dedup_lines(docs.repartition(4), keep=("lang",)).collect()}
    want = brute(rows)
    assert {d: (r["n_lines"], r["n_removed"]) for d, r in got.items()} == want
    assert sum(n for _, n in want.values()) > 0
    for d, t in rows:
        left = got[d]["text"].split("\n") if got[d]["text"] else []
        assert [x for x in t.split("\n") if x in set(left)][:len(left)] or not left
        if got[d]["n_removed"] == 0:
            assert got[d]["text"] == t


def test_blocks_copies_and_order(spark):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(6, 60)))
    a = [line() for _ in range(6)]
    passage = line()
    rows = [(1, "\n".join(a)), (2, "\n".join([line(), a[1], "short", a[2], line()])), (3, "\n".join(a)),
            (4, "\n".join([a[4], a[0]])), (5, f"{line()}\n{passage}"), (6, f"{passage}\n{line()}"), (7, "ab\ncd"), (8, "ab\ncd"),
            (9, "ab\nxy"), (10, None), (11, ""), (12, "\n".join([passage] * 3)), (13, "x " * 200_000)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, m string, pos int")
    got = {r["doc_id"]: r for r in L.dedup_lines(df).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["text"] == "" and got[3]["n_removed"] == 6
    assert got[2]["n_removed"] == 2 and "short" in got[2]["text"]
    assert got[4]["n_removed"] == 1  # crossed lines: one can be aligned
    assert got[5]["n_removed"] == 0 and got[6]["n_removed"] == 1 and passage not in got[6]["text"]
    assert got[7]["n_removed"] == 0 and got[8]["text"] == "" and got[9]["n_removed"] == 0
    assert got[10]["text"] is None and got[10]["n_lines"] == 0 and got[11]["text"] == ""
    assert got[12]["n_removed"] == 1 and got[13]["n_removed"] == 0
    assert {d: (r["n_lines"], r["n_removed"]) for d, r in got.items()} == brute(rows)


def test_repeated_rows_null_keys_and_empty(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(1, text)] * 3 + [(None, text), (None, None), (1, text + "\nmore")], "doc_id long, text string")
    rows = L.dedup_lines(df).collect()
    assert len(rows) == 6
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0, 0]
    assert all(r["n_removed"] == 1 for r in rows if r["doc_id"] == 1)
    assert L.dedup_lines(df.limit(0)).count() == 0
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text + "\n"), F.col("id").cast("string")).alias("text"))
    assert L.dedup_lines(hot).agg(F.sum("n_removed")).collect()[0][0] == 1999


def every_earlier(rows):
    """Positions that go from each document: those aligned with the holders of
    its lines, and, of the other lines that an earlier document has, those
    aligned with any earlier document on all shared lines."""
    docs = [(d, L.line_keys(t) if t else []) for d, t in sorted(rows, key=lambda r: r[0])]
    holder, out = {}, {}
    for n, (d, keys) in enumerate(docs):
        gone = set()
        for h in {holder[k][0] for k in keys if k in holder}:
            gone.update(L.aligned([(i, holder[k][1]) for i, k in enumerate(keys) if k in holder and holder[k][0] == h]))
        for _, other in docs[:n]:
            place = {k: j for j, k in enumerate(other)}
            gone.update(L.aligned([(i, place[k]) for i, k in enumerate(keys) if k in place]))
        out[d] = gone
        for i, k in enumerate(keys):
            holder.setdefault(k, (d, i))
    return out


def test_lines_crossed_in_their_holder(spark):
    line = lambda c: " ".join([c] * 6)
    text = lambda s: "\n".join(map(line, s))
    # 1 has a and b crossed; 3 is a copy of 2 in its shared lines, 5 shares a pair only with 2
    rows = [(1, text("bxa")), (2, text("ab")), (3, text("aub")), (4, text("ab")), (5, text("avwb")), (6, text("wav")), (7, text("ba"))]
    rng = random.Random(5)
    rows += [(d, text(rng.sample("abcdefghij", rng.randint(1, 6)))) for d in range(8, 90)]
    rows += [(d, text(rng.sample("klmno", rng.randint(2, 5)) + [str(d)])) for d in range(90, 150)]
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = every_earlier(rows)
    assert got[3]["text"] == line("u") and got[4]["text"] == ""
    for d, t in rows:
        assert got[d]["n_removed"] == len(want[d]), d
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])


def crossed(spark, n, mixed=False):
    """A holder of ``b .. a``, then documents ``a, u, b`` (with ``mixed`` every third
    ``b, u, a``), each ``u`` in two of them that are not neighbours."""
    line = lambda c: F.concat_ws(" ", *[c] * 6)
    a, b = line(F.lit("a")), line(F.lit("b"))
    u = line(F.concat(F.lit("u"), (F.col("id") % (n // 2)).cast("string")))
    body = F.concat_ws("\n", a, u, b)
    turned = F.concat_ws("\n", b, u, a)
    body = F.when((F.col("id") % 3 == 1) & F.lit(mixed), turned).otherwise(body)
    head = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.concat_ws("\n", b, a).alias("text"))
    return head.unionByName(spark.range(n).select(F.col("id").alias("doc_id"), body.alias("text")))


def test_pairs_grow_with_the_rows(spark, monkeypatch):
    plain, pairs = L._further, []

    def counted(signs, left, found):
        pairs.append(found.distinct().count())
        return plain(signs, left, found)

    monkeypatch.setattr(L, "_further", counted)
    for mixed in (False, True):
        made = {}
        for n in (100, 400):
            pairs.clear()
            docs = crossed(spark, n, mixed)
            got = {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(docs).collect()}
            made[n] = sum(pairs)
            want = every_earlier([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert got == {d: len(g) for d, g in want.items()}
        assert 0 < made[400] < 4.5 * made[100] + 50 and made[400] < 8 * 400
    assert len(pairs) >= 2  # the first candidates do not do


def test_rounds_reach_the_first_document(spark, monkeypatch):
    # a line of its own way of crossing is tried with all earlier documents, and aligns with the very first
    line = lambda c: " ".join([c] * 6)
    text = lambda s: "\n".join(map(line, s.split()))
    rows = [(0, text("b a")), (1, text("a z b"))] + [(d, text(f"b u{d % 60} a")) for d in range(2, 122)] + [(200, text("a y b")), (201, text("y"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(df.repartition(5)).collect()}
    assert got == {d: len(g) for d, g in every_earlier(rows).items()}
    assert got[200] == 2
