"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents marked good, outside the held-out fold;
unlabelled text is every document outside that fold without a mark.  Documents marked bad are
on neither side; nothing else is learned from their marks.  A linear score over style features of the whole text is fitted in
three steps, each by passes over one stored table of features that cover every
document of the fold:

1. positives against unlabelled, by logistic regression;
2. the class prior: the share of unlabelled text over the share of positives
   above a score bounds it from above, for every score; the least such ratio is
   the estimate (from a histogram of all scores);
3. the non-negative unbiased risk
   ``prior R_p(+) + max(0, R_u(-) - prior R_p(-))`` with the sigmoid loss, which is
   bounded, so a prior that is a little off does little harm.  Steps are Newton
   steps with a line search on that risk; one that would take the second part,
   the risk of negatives, below ``-beta`` (which only overfitting does) is refused.

A pass returns sixteen vectors of sums, whatever the number of documents and
partitions; nothing else reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import FINE, batches, utf8, word_hashes
from lexlab.session import stage_table

PREDICT_FROM = 0.3
_code = np.arange(256)
#: bins of the byte histogram: control, newline, tab, blank, digit, capital,
#: each mark, each small letter, and four classes outside ASCII
_BIN = np.select(
    [_code == 10, _code == 9, _code == 32, (_code < 32) | (_code == 127), (_code >= 48) & (_code <= 57),
     (_code >= 65) & (_code <= 90), (_code >= 97) & (_code <= 122), _code >= 224, _code >= 192, _code >= 128],
    [1, 2, 3, 0, 4, 5, 6 + _code - 97, 32, 33, 34], 35)
_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
for _i, _c in enumerate(_marks):
    _BIN[_c] = 35 + _i
N_BINS = 35 + len(_marks)
N_STYLE = 12
DIMENSIONS = N_BINS + N_STYLE


def features(column) -> np.ndarray:
    """Style features of each text of an Arrow column; zeros for an empty one."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    hist = np.bincount(row * N_BINS + _BIN[data], minlength=n * N_BINS).reshape(n, N_BINS).astype(float)
    share = hist / np.maximum(size, 1)[:, None]
    words, first = word_hashes(data, offsets)
    count = np.diff(first)
    style = np.zeros((n, N_STYLE))
    chars = np.maximum(size, 1)
    marks = hist[:, 35:].sum(1)
    lines = hist[:, 1] + 1
    per = np.maximum(count, 1)
    style[:, 0] = np.log1p(size)
    style[:, 1] = (chars - hist[:, 1] - hist[:, 3] - marks) / per  # letters per word
    style[:, 2] = marks / per
    style[:, 3] = np.log1p(count / lines)
    style[:, 4] = np.log1p(lines)
    for i in range(n):
        w = words[first[i]:first[i + 1]]
        if len(w):
            _, k = np.unique(w, return_counts=True)
            style[i, 5] = len(k) / len(w)
            style[i, 6] = k.max() / len(w)
            style[i, 7] = (k == 1).sum() / len(w)
            style[i, 8] = (w[1:] == w[:-1]).sum() / len(w)
            style[i, 9] = len(np.unique(w[1:] ^ (w[:-1] << np.uint64(1)))) / len(w)
            style[i, 10] = len(k) / np.sqrt(len(w))
    style[:, 11] = hist[:, 5] / per
    return np.hstack([np.log1p(200 * share), style * (size > 0)[:, None]])


def held_out(key: Column) -> Column:
    """The fold that labels are never learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@dataclass(frozen=True)
class Model:
    """``score = sigmoid(weights . (x - mean) / scale + bias)``."""
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _unlearned(value: float = 0.5) -> Model:
    z = np.zeros(DIMENSIONS)
    return Model(z, 0.0, z, np.ones(DIMENSIONS), value)


def feature_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__key, x`` (32-bit floats) for every row."""
    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([src.schema["__key"], T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(frames):
        for batch in batches(frames, FINE):
            x = features(batch.column(1)).astype(np.float32)
            offs = pa.array(np.arange(0, x.size + 1, DIMENSIONS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offs, pa.array(x.ravel()))],
                                             names=schema.names)

    return src.mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False)
    return x.reshape(-1, DIMENSIONS).astype(float)


def _sums(table: DataFrame, width: int, per_batch, width_of_tree: int = 16) -> np.ndarray:
    """Sum over all rows of ``per_batch(x, positive)``, a vector of ``width``.

    Partitions sum first, then ``width_of_tree`` tasks sum what they made, in the
    order of the partitions; that many rows reach the driver, however many
    partitions there are."""
    names = ["part", "s"]

    def row(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=names)

    def run(frames):
        total = np.zeros(width)
        for batch in frames:
            if batch.num_rows:
                total += per_batch(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield row(TaskContext.get().partitionId(), total)

    def add(frames):
        first, total = None, np.zeros(width)
        for batch in frames:  # in the order of the partitions, so that a repeated task adds up alike
            for p, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                first = p if first is None else first
                total += v.values.to_numpy()
        if first is not None:
            yield row(first, total)

    sums = (table.select("x", "positive").mapInArrow(run, "part long, s array<double>").repartition(width_of_tree, "part").sortWithinPartitions("part")
            .mapInArrow(add, "part long, s array<double>").collect())
    return np.sum([np.array(r["s"]) for r in sorted(sums, key=lambda r: r["part"])], axis=0) if sums else np.zeros(width)


def _standard(x, mean, scale):
    return np.hstack([np.clip((x - mean) / scale, -20, 20), np.ones((len(x), 1))])


def fit(table: DataFrame, *, ridge: float = 1e-3, steps: int = 8, beta: float = 0.03, prior: float | None = None,
        least_share: float = 0.2) -> Model:
    """Fit on ``table (x, positive)``: positives and unlabelled rows.

    ``prior`` None: estimated.  Without positives or without unlabelled rows
    nothing can be learned, and every score is 0.5.
    """
    d = DIMENSIONS

    def moments(x, pos):
        u = x[~pos]
        return np.concatenate([[pos.sum(), len(u)], u.sum(0), (u * u).sum(0)])

    # two halves by a hash of the features: one to fit the first score, the other to read the prior from
    half = [table.filter(F.pmod(F.xxhash64("x"), F.lit(2)) == k) for k in (0, 1)]
    each = [_sums(h, 2 + 2 * d, moments) for h in half]
    got = each[0] + each[1]
    n_p, n_u = got[0], got[1]
    if n_p == 0 or n_u == 0:
        return _unlearned()
    mean = got[2:2 + d] / n_u
    scale = np.sqrt(np.maximum(got[2 + d:] / n_u - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    penalty = ridge * np.append(np.ones(d), 0)
    if min(each[0][0], each[0][1], each[1][0], each[1][1]) == 0:
        half, each = [table, table], [got, got]

    def newton(theta, gradient, hessian):
        step = np.linalg.solve(hessian + np.diag(penalty + 1e-9), gradient + penalty * theta)
        return theta - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))

    # 1. positives against unlabelled, both sides with the same weight
    theta = np.zeros(d + 1)
    for _ in range(5):
        def naive(x, pos, theta=theta):
            x = _standard(x, mean, scale)
            s = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
            w = np.where(pos, 1 / each[0][0], 1 / each[0][1])
            return np.concatenate([x.T @ (w * (s - pos)), (x.T @ (x * (w * s * (1 - s))[:, None])).ravel()])

        got = _sums(half[0], (d + 1) * (d + 2), naive)
        theta = newton(theta, got[:d + 1], got[d + 1:].reshape(d + 1, d + 1))

    # 2. the prior, from histograms of all scores
    bins = 1000

    def histogram(x, pos):
        s = 1 / (1 + np.exp(-np.clip(_standard(x, mean, scale) @ theta, -35, 35)))
        k = np.minimum((s * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(k[pos], minlength=bins), np.bincount(k[~pos], minlength=bins)]).astype(float)

    read = _sums(half[1], 2 * bins, histogram)
    if prior is None:
        m_p, m_u = each[1][0], each[1][1]
        a_p, a_u = np.cumsum(read[:bins][::-1]) / m_p, np.cumsum(read[bins:][::-1]) / m_u
        wide = a_p >= least_share  # a ratio of small shares says little
        a_p, a_u = a_p[wide], a_u[wide]
        # each ratio with its standard error, as the least of many is too low by chance
        error = np.sqrt(a_u * (1 - a_u) / m_u + (a_u / a_p) ** 2 * a_p * (1 - a_p) / m_p) / a_p
        prior = float(np.clip((a_u / a_p + error).min(), 0.01, 0.99))

    # 3. the non-negative unbiased risk, from the first score with its bias moved to where
    # the share of unlabelled text above it is the prior
    cut = int(np.searchsorted(np.cumsum(read[bins:]) / read[bins:].sum(), 1 - prior)) + 0.5
    theta[d] -= np.log(np.clip(cut / bins, 1e-3, 1 - 1e-3) / (1 - np.clip(cut / bins, 1e-3, 1 - 1e-3)))
    lengths = np.array([0, 4, 2, 1, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.02])
    for _ in range(steps):
        def slopes(x, pos, theta=theta):
            x = _standard(x, mean, scale)
            s = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
            q = np.where(pos, 1 / n_p, 1 / n_u) * s * (1 - s)
            return np.concatenate([x[pos].T @ q[pos], x[~pos].T @ q[~pos], (x.T @ (x * q[:, None])).ravel()])

        got = _sums(table, (d + 1) * (d + 3), slopes)
        g_p, g_u, h = got[:d + 1], got[d + 1:2 * d + 2], got[2 * d + 2:].reshape(d + 1, d + 1)
        # of prior * E_p[sigmoid(-z)] + E_u[sigmoid(z)] - prior * E_p[sigmoid(z)]
        gradient = -prior * g_p + (g_u - prior * g_p) + penalty * theta
        way = -np.linalg.solve(h + np.diag(penalty + 1e-6), gradient)
        way = way * min(1.0, 2.0 / max(np.abs(way).max(), 1e-12))

        def along(x, pos, theta=theta, way=way):
            x = _standard(x, mean, scale)
            z = np.clip((x @ theta)[:, None] + (x @ way)[:, None] * lengths[None, :], -35, 35)
            s = 1 / (1 + np.exp(-z))
            return np.concatenate([s[pos].sum(0) / n_p, s[~pos].sum(0) / n_u])

        s_p, s_u = _sums(table, 2 * len(lengths), along).reshape(2, -1)
        rest = s_u - prior * s_p
        weight = np.array([0.5 * (penalty * (theta + t * way) ** 2).sum() for t in lengths])
        risks = prior * (1 - s_p) + np.maximum(rest, 0) + weight
        allowed = np.where((rest >= -beta) | (lengths == 0), risks, np.inf)
        k = int(allowed.argmin())
        if not allowed[k] < allowed[0] - 1e-6:
            break
        theta = theta + lengths[k] * way
    return Model(theta[:d], float(theta[d]), mean, scale, prior)


def training_rows(table: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``x, positive`` of the rows outside the held-out fold that are marked
    good or not marked at all.  A document marked more than once counts by its
    best mark; one whose marks are all null has none; labels without a
    document are passed over."""
    marks = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("m_key")).agg((F.max(label) == 1).alias("good")))
    rows = table.filter(~held_out(F.col("__key"))).join(marks, F.col("__key") == F.col("m_key"), "left")
    return rows.filter("good IS NULL OR good").select("x", F.coalesce("good", F.lit(False)).alias("positive"))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          **options) -> tuple[Model, DataFrame]:
    """The model, and the stored feature table of all documents."""
    table = stage_table(feature_table(docs, key, text), "features")
    rows = stage_table(training_rows(table, labels, key=key, label=label), "training")  # each pass of the fit reads it
    return fit(rows, **options), table


def score_features(table: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every row of a feature table."""
    schema = T.StructType([table.schema["__key"], T.StructField("score", T.DoubleType())])

    def run(frames):
        for batch in frames:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))],
                                                 names=schema.names)

    return table.mapInArrow(run, schema).select(
        F.col("__key").alias(key), held_out(F.col("__key")).alias("held_out"), "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
             **options) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``.

    The score (0 to 1) is the likelihood of a good document; null and empty
    texts are scored by their (zero) features; repeated rows score alike;
    a null key is in the held-out fold; other columns are ignored; an empty
    table gives an empty result."""
    model, table = train(docs, labels, key=key, text=text, label=label, **options)
    return score_features(table, model, key=key)


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
              **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all columns; texts
    are scored where they are read."""
    model, _ = train(docs, labels, key=key, text=text, label=label, **options)
    at = docs.columns.index(text)

    def run(frames):
        for batch in batches(frames, FINE):
            yield batch.filter(pa.array(model.scores(features(batch.column(at))) >= PREDICT_FROM))

    return docs.mapInArrow(run, docs.schema)
