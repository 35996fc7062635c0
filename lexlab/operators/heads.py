"""Scoring heads over frozen features, all as column expressions.

* fixed head (``eval_only``): weights drawn from ``md5('w:<seed>:<c>:<j>')``,
  so the untrained baseline is a pure function of the seed and any SQL
  engine can recompute it;
* multinomial naive Bayes on hashed word counts (``head_only`` in closed
  form): one grouped count over the training rows, classes x features;
* nearest-centroid head on dense vectors: one grouped mean, classes x dim.

Model tables are bounded by classes x features and are the only things
brought to the driver; scoring is a per-row projection (no shuffle).
Score arrays are folded left to right so every engine sums in one order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlab.functions.exprs import argmax, col, double_array, dot, py_unit, seeded_md5, softmax, unit_interval
from lexlab.functions.text import token_indices

NUM_FEATURES = 1024
FIT_SHARE = 0.8


# ---------------------------------------------------------------------------
# fixed (untrained) heads
# ---------------------------------------------------------------------------
def fixed_weights(seed: int, n_classes: int, dim: int) -> list[list[float]]:
    """Driver-side weight table, n_classes x dim (bounded by the head size)."""
    return [[py_unit(f"w:{seed}:{c}:{j}") - 0.5 for j in range(dim)] for c in range(n_classes)]


def sparse_logits(idx: str | Column, weights: Sequence[Sequence[float]],
                  bias: Sequence[float] | None = None, scale: Column | None = None) -> Column:
    """logit_c = (sum over feature ids i of W[c][i]) * scale + bias_c.

    The id array is walked once, with one running sum per class."""
    arrays = [double_array(wc) for wc in weights]
    zero = F.struct(*[F.lit(0.0).alias(f"c{c}") for c in range(len(weights))])

    def step(acc: Column, i: Column) -> Column:
        return F.struct(*[(acc[f"c{c}"] + F.element_at(arr, i + 1)).alias(f"c{c}") for c, arr in enumerate(arrays)])

    def finish(acc: Column) -> Column:
        out = []
        for c in range(len(weights)):
            s = acc[f"c{c}"]
            if scale is not None:
                s = s * scale
            if bias is not None:
                s = s + F.lit(float(bias[c]))
            out.append(s)
        return F.array(*out)

    return F.aggregate(col(idx), zero, step, finish)


def fixed_text_logits(idx: str | Column, seed: int, n_classes: int = 3,
                      num_features: int = NUM_FEATURES) -> Column:
    """Untrained head on hashed word counts, length-normalised by sqrt(n)."""
    scale = F.lit(1.0) / F.sqrt(F.greatest(F.size(col(idx)), F.lit(1)).cast("double"))
    return sparse_logits(idx, fixed_weights(seed, n_classes, num_features), scale=scale)


def dense_logits(vec: str | Column, weights: Sequence[Sequence[float]],
                 bias: Sequence[float] | None = None) -> Column:
    out = []
    for c, wc in enumerate(weights):
        s = dot(F.transform(col(vec), lambda x: x.cast("double")), double_array(wc))
        if bias is not None:
            s = s + F.lit(float(bias[c]))
        out.append(s)
    return F.array(*out)


def fixed_vector_logits(vec: str | Column, seed: int, n_classes: int, dim: int) -> Column:
    return dense_logits(vec, fixed_weights(seed, n_classes, dim))


# ---------------------------------------------------------------------------
# predictions from a score array
# ---------------------------------------------------------------------------
def with_prediction(df: DataFrame, logits: Column, prefix: str = "") -> DataFrame:
    """Add ``<prefix>pred`` (first argmax) and ``<prefix>confidence``."""
    lg, pr = f"_{prefix}logits", f"_{prefix}probs"
    out = df.withColumn(lg, logits).withColumn(pr, softmax(lg))
    out = out.withColumn(f"{prefix}pred", argmax(lg))
    out = out.withColumn(f"{prefix}confidence", F.element_at(F.col(pr), F.col(f"{prefix}pred") + 1))
    return out.drop(lg, pr)


# ---------------------------------------------------------------------------
# naive Bayes on hashed word counts
# ---------------------------------------------------------------------------
class NaiveBayesTable:
    """log prior (C) and log likelihood (C x D) of a multinomial NB."""

    def __init__(self, log_prior: list[float], log_theta: list[list[float]]):
        self.log_prior = log_prior
        self.log_theta = log_theta

    @property
    def n_params(self) -> int:
        return len(self.log_prior) * (1 + len(self.log_theta[0]))

    def logits(self, idx: str | Column) -> Column:
        return sparse_logits(idx, self.log_theta, bias=self.log_prior)


def in_fit(seed: int, key_col: str = "doc_id") -> Column:
    """The seeded resample of the train rows that a run with this seed is
    fitted on: ``FIT_SHARE`` of them, by a hash of seed and key."""
    return unit_interval(seeded_md5(f"fit{seed}", key_col)) < F.lit(FIT_SHARE)


def fit_naive_bayes(train: DataFrame, idx_col: str = "idx", label_col: str = "label",
                    n_classes: int = 3, num_features: int = NUM_FEATURES,
                    smoothing: float = 1.0) -> NaiveBayesTable:
    """Closed-form multinomial NB: one partial+final aggregation of
    (class, feature) counts; only classes x features rows reach the driver."""
    return fit_naive_bayes_many(train, [F.lit(True)], idx_col, label_col, n_classes, num_features, smoothing)[0]


def fit_naive_bayes_many(train: DataFrame, members: Sequence[Column], idx_col: str = "idx", label_col: str = "label",
                         n_classes: int = 3, num_features: int = NUM_FEATURES,
                         smoothing: float = 1.0) -> list[NaiveBayesTable]:
    """One NB per condition in ``members`` (a subset of the train rows each),
    all from the same two aggregations: a word moves once, with one flag per
    subset, whatever their number.  Rows whose label is NULL or outside the classes
    are left out."""
    train = train.filter(F.col(label_col).between(0, n_classes - 1))
    flags = [F.when(m, 1).otherwise(0).alias(f"_m{k}") for k, m in enumerate(members)]
    rows = train.select(label_col, idx_col, *flags)
    names = [f"_m{k}" for k in range(len(members))]
    sums = [F.sum(n).alias(n) for n in names]
    counts = rows.select(label_col, *names, F.explode(idx_col).alias("_i")).groupBy(label_col, "_i").agg(*sums).collect()
    docs = rows.groupBy(label_col).agg(*sums).collect()
    return [naive_bayes_from_counts([{label_col: r[label_col], "_i": r["_i"], "_n": r[n]} for r in counts],
                                    [{label_col: r[label_col], "_d": r[n]} for r in docs],
                                    label_col, n_classes, num_features, smoothing) for n in names]


def naive_bayes_from_counts(count_rows, doc_rows, label_col: str, n_classes: int,
                            num_features: int, smoothing: float = 1.0) -> NaiveBayesTable:
    cnt = [[0] * num_features for _ in range(n_classes)]
    for r in count_rows:
        cnt[r[label_col]][r["_i"]] = r["_n"]
    ndoc = [0] * n_classes
    for r in doc_rows:
        ndoc[r[label_col]] = r["_d"]
    total_docs = sum(ndoc)
    log_prior = [math.log(ndoc[c] / total_docs) if ndoc[c] else -1e300 for c in range(n_classes)]
    log_theta = []
    for c in range(n_classes):
        tot = sum(cnt[c])
        den = tot + smoothing * num_features
        log_theta.append([math.log((cnt[c][j] + smoothing) / den) for j in range(num_features)])
    return NaiveBayesTable(log_prior, log_theta)


# ---------------------------------------------------------------------------
# nearest-centroid head on dense vectors
# ---------------------------------------------------------------------------
def fit_centroids(train: DataFrame, vec_col: str, label_col: str, n_classes: int,
                  dim: int) -> tuple[list[list[float]], list[float]]:
    """Class means (one grouped aggregation, one row per class) as a linear head:
    w_c = mu_c, b_c = -|mu_c|^2 / 2  (argmax = nearest centroid).  Rows whose label is
    NULL or outside the classes are left out."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    train = train.filter(F.col(label_col).between(0, n_classes - 1))
    rows = (train.select(label_col, array_to_vector(F.col(vec_col)).alias("_v"))
            .groupBy(label_col).agg(Summarizer.mean(F.col("_v")).alias("_m")).collect())
    mu = [[0.0] * dim for _ in range(n_classes)]
    for r in rows:
        mu[r[label_col]] = [float(x) for x in r["_m"]]
    bias = [-0.5 * sum(v * v for v in m) for m in mu]
    return mu, bias


def text_features(df: DataFrame, text_col: str = "sentence", num_features: int = NUM_FEATURES,
                  out_col: str = "idx") -> DataFrame:
    """Hashed word ids of the whole text (no truncation)."""
    from lexlab.functions.text import word_tokens
    return df.withColumn(out_col, token_indices(word_tokens(text_col), num_features))
