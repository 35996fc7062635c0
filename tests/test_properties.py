"""Property tests: Spark metrics vs a brute-force Python model of the contract."""

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from lexlab.operators import metrics as M
from lexlab.operators import split as spl


def brute_macro_f1(labels, preds):
    classes = sorted(set(labels) | set(preds))
    f1s = []
    for c in classes:
        tp = sum(1 for y, p in zip(labels, preds) if y == c and p == c)
        fp = sum(1 for y, p in zip(labels, preds) if y != c and p == c)
        fn = sum(1 for y, p in zip(labels, preds) if y == c and p != c)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1s.append(2 * prec * rec / (prec + rec) if prec + rec else 0.0)
    return sum(f1s) / len(f1s)


pairs = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs)
def test_macro_f1_matches_brute_force(spark, rows):
    labels, preds = [r[0] for r in rows], [r[1] for r in rows]
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], "doc_id long, label int, pred int")
    got = M.macro_f1(M.confusion_long(df, 3)).first().macro_f1
    assert abs(got - brute_macro_f1(labels, preds)) < 1e-6
    assert 0.0 <= got <= 1.0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.integers(0, 10_000), min_size=1, max_size=6))
def test_quotas_partition_each_class(counts):
    q = spl.quotas_from_counts(counts)
    n = sum(counts.values())
    sizes = spl.split_sizes(n)
    assert sum(t for t, _, _ in q.values()) == sizes["train"]
    assert sum(v for _, v, _ in q.values()) == sizes["validation"]
    assert sum(s for _, _, s in q.values()) == sizes["test"]
    for c, (t, v, s) in q.items():
        assert t + v + s == counts[c] and min(t, v, s) >= 0
        if n:
            assert abs(t - counts[c] * sizes["train"] / n) < 1.0
