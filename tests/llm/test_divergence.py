"""Source divergence against SQL and a plain version, in whole numbers."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lexlab.llm import divergence as D
from tests.conftest import SF_MID

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (v, t) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_MID}/documents.parquet'")
    got = D.audit_sources(spark.read.parquet(f"{SF_MID}/documents.parquet"))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == sorted(con.execute(D.oracle_sql()).fetchall())


@pytest.mark.parametrize("cells", [1 << 12, 1])
def test_edges_and_shards(spark, cells):
    texts = ["Red red BLUE été Été", "red, green-blue", "été 中文 \U0001f600x", None, "", "1234 --", "red " * 500 + "\x00blue\x7fgreen",
             "ﬁ ſ K İ red"]
    rows = [(lang, source, texts[(i * 7 + j * 3 + k) % len(texts)]) for i, lang in enumerate(["en", None, "", "fr"])
            for j, source in enumerate(["a", "b", None, "é", "Z"]) for k in range(5)]
    rows += [("only", "one", "alone here"), ("few", "x", "none kept"), ("few", "y", None)] + [("en", "a", "red red")] * 40
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "lang string, source string, text string, n int, total int, term string")
    assert rows_of(D.audit_sources(df, min_docs=3, top=2, shard_cells=cells)) == plain(rows, 3, 2)
    assert D.audit_sources(df.limit(0)).count() == 0


def test_tasks_hand_on_counts_when_full(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k)}" for k in range(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(1)
    want = plain(rows, 30, 50)
    monkeypatch.setattr(D, "PARTIAL_ROWS", 50)
    monkeypatch.setattr(D, "batches", lambda frames: (b.slice(i, 7) for b in frames for i in range(0, b.num_rows, 7)))
    assert rows_of(D.audit_sources(df)) == want


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 2 * 10**13, 2000)
    size = rng.integers(2 * 10**13, 10**14, 2000)
    terms = rng.integers(1, 10**7, 2000)
    want = [1 + 10**9 * (int(a) + 5) // (int(b) + 5 * int(c)) for a, b, c in zip(n, size, terms)]
    assert D.shares(n, size, terms).tolist() == want
