"""Spark ML rungs: heads trained on frozen features.

* ``head_only``: multinomial logistic regression (distributed gradient sums,
  one tree-aggregate per iteration) on the feature vector;
* ``rank_r``:  PCA(k=r) then multinomial logistic regression -- the Spark-native
  "few trainable parameters on frozen features" rung.  This is not a weight
  adapter inside an encoder; it stands where the adapter rungs stand.

Imbalance: rows are weighted by inverse class frequency (``weightCol``) so
the regression does not collapse onto the majority class.  Class counts are a
bounded (classes-row) aggregate.

Feature sets (the "backbones"):
* ``word_tfidf``: lower-cased word tokens -> HashingTF(1024) -> IDF
* ``char3_tfidf``: character 3-grams -> HashingTF(1024) -> IDF
* ``emb``: the frozen 64-d embedding array as a dense vector
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlab.constants import LORA_RANK
from lexlab.functions.exprs import argmax, map_literal

NUM_FEATURES = 1024
WORD_PATTERN = r"[^\p{L}\p{N}_]+"


def class_counts(df: DataFrame, label_col: str = "label") -> dict[int, int]:
    """Rows per class (a classes-row aggregate)."""
    return {r[label_col]: r["count"] for r in df.groupBy(label_col).count().collect()}


def class_weights(df: DataFrame, label_col: str = "label",
                  counts: dict[int, int] | None = None) -> dict[int, float]:
    """Inverse class frequency, N / (C * n_c)."""
    counts = counts if counts is not None else class_counts(df, label_col)
    n, c = sum(counts.values()), len(counts)
    return {k: n / (c * v) for k, v in counts.items()}


def with_weights(df: DataFrame, weights: dict[int, float], label_col: str = "label",
                 out_col: str = "weight") -> DataFrame:
    return df.withColumn(out_col, F.coalesce(F.element_at(map_literal(weights), F.col(label_col)),
                                             F.lit(1.0)).cast("double"))


def feature_stages(feature_set: str, text_col: str = "sentence", vec_col: str = "embedding") -> list:
    if feature_set == "word_tfidf":
        return [RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WORD_PATTERN, gaps=True,
                               toLowercase=True, minTokenLength=1),
                HashingTF(inputCol="_words", outputCol="_tf", numFeatures=NUM_FEATURES),
                IDF(inputCol="_tf", outputCol="features")]
    if feature_set == "char3_tfidf":
        return [RegexTokenizer(inputCol=text_col, outputCol="_chars", pattern=".", gaps=False,
                               toLowercase=True, minTokenLength=1),
                NGram(n=3, inputCol="_chars", outputCol="_grams"),
                HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=NUM_FEATURES),
                IDF(inputCol="_tf", outputCol="features")]
    if feature_set == "emb":
        # expects ``vec_col`` already a vector (see ``emb_frame``)
        return [VectorAssembler(inputCols=[vec_col], outputCol="features")]
    raise ValueError(f"unknown feature set {feature_set!r}")


def head_stages(method: str, rank: int = LORA_RANK, max_iter: int = 50, reg: float = 0.01) -> list:
    lr = dict(labelCol="label", weightCol="weight", family="multinomial", maxIter=max_iter,
              regParam=reg, elasticNetParam=0.0, standardization=True)
    if method == "head_only":
        return [LogisticRegression(featuresCol="features", **lr)]
    if method == "rank_r":
        return [PCA(k=rank, inputCol="features", outputCol="_low"),
                LogisticRegression(featuresCol="_low", **lr)]
    raise ValueError(f"not a trained method: {method!r}")


def fit(train: DataFrame, feature_set: str, method: str, max_iter: int = 50, **kw) -> PipelineModel:
    """Fit features + head on the train rows (expects label and weight columns)."""
    return Pipeline(stages=feature_stages(feature_set, **kw) + head_stages(method, max_iter=max_iter)).fit(train)


def counting(feature_set: str) -> PipelineModel:
    """The stages before IDF of a text feature set, which learn nothing: tokens and hashed counts ``_tf``."""
    return PipelineModel(feature_stages(feature_set)[:-1])


def fit_counted(train: DataFrame, feature_set: str, method: str, max_iter: int = 50) -> tuple[PipelineModel, PipelineModel]:
    """:func:`fit` on rows that :func:`counting` has been through: the model for such rows,
    and the whole one, for texts."""
    fitted = Pipeline(stages=feature_stages(feature_set)[-1:] + head_stages(method, max_iter=max_iter)).fit(train)
    return fitted, PipelineModel(counting(feature_set).stages + fitted.stages)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add pred (int) and confidence (max class probability)."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))
    return (out.withColumn("_p", p).withColumn("pred", argmax("_p"))
               .withColumn("confidence", F.element_at("_p", F.col("pred") + 1))
               .drop("_p"))


def trained_params(model: PipelineModel, n_features: int) -> tuple[int, int]:
    """(trainable, total) of a fitted pipeline: head coefficients are trainable;
    IDF weights and PCA components are fitted without labels and count as
    frozen."""
    trainable, frozen = 0, 0
    for st in model.stages:
        name = type(st).__name__
        if name == "LogisticRegressionModel":
            trainable += st.coefficientMatrix.numRows * st.coefficientMatrix.numCols + len(st.interceptVector)
        elif name == "IDFModel":
            frozen += len(st.idf)
        elif name == "PCAModel":
            frozen += st.pc.numRows * st.pc.numCols
    return trainable, trainable + frozen


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def emb_frame(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", array_to_vector("embedding"))
