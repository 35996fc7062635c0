"""Prediction tables built from the fixtures.

``text_scored``: the labelled relation with its split, hashed word ids of
the whole text, and one prediction/confidence column pair per model (fixed
heads per seed, naive Bayes trained on the train split), all in one
projection.  ``stack_models`` turns that wide row into the long prediction
table P(model_id, doc_id, split, label, pred, confidence, ...) with an
``explode`` (rows stay in their partition, no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.functions.text import token_indices, word_tokens
from lexlab.operators import heads as H
from lexlab.operators.gates import slice_tags
from lexlab.operators import split as spl
from lexlab.store import store
from lexlab.sources import fixtures as fx

TEXT_CLASSES = 3
EMB_DIM = 64


def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    L = fx.labelled(spark, sf_dir)
    return spl.stratified_split(L, label_col="label", key_col="doc_id")


def text_features_table(spark: SparkSession, sf_dir: str, extra_cols: Sequence[str] = (),
                        with_slices: bool = False) -> DataFrame:
    """(doc_id, split, label, lang, idx): split + hashed word ids, computed once.

    A table of the prepared store: the NB fit and the scoring pass both read it,
    and so does every other query on the same inputs, instead of re-running the join, split
    and tokenizer.
    """
    feats = (text_split(spark, sf_dir)
             .withColumn("_tok", word_tokens("sentence"))
             .withColumn("idx", token_indices("_tok", H.NUM_FEATURES)))
    cols = ["doc_id", "split", "label", "lang", "idx"]
    if with_slices:   # two extra regex passes over each text: only when asked for
        feats = feats.withColumn("slices", slice_tags("sentence", "lang", F.col("_tok")))
        cols.append("slices")
    return store(spark).acquire(feats.select(*cols, *extra_cols), "text-features")


def text_scored(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = (42,),
                nb: bool = True, extra_cols: Sequence[str] = (), with_slices: bool = False,
                nb_seeds: Sequence[int] = (), splits: Sequence[str] = ("test",),
                nb_lang: str | None = None) -> DataFrame:
    """Rows of ``splits`` with one prediction per model: fixed heads of
    ``seeds``, naive Bayes on all train rows (``nb``; of one language with
    ``nb_lang``) and on the resample of each of ``nb_seeds``.  Train rows are
    read for the fits only, and scored only if asked for."""
    base = text_features_table(spark, sf_dir, extra_cols, with_slices)
    out = base.filter(F.col("split").isin(*splits))
    for s in seeds:
        out = H.with_prediction(out, H.fixed_text_logits("idx", s, TEXT_CLASSES), prefix=f"fixed_s{s}_")
    members = {f"nb_s{s}": H.in_fit(s) for s in nb_seeds}
    if nb:
        members["nb"] = F.lit(True) if nb_lang is None else F.coalesce(F.col("lang") == nb_lang, F.lit(False))
    if members:
        train = base.filter(F.col("split") == "train")
        tables = H.fit_naive_bayes_many(train, list(members.values()), "idx", "label", TEXT_CLASSES)
        for name, table in zip(members, tables):
            out = H.with_prediction(out, table.logits("idx"), prefix=f"{name}_")
    return out.drop("idx")


def model_names(seeds: Sequence[int] = (42,), nb: bool = True, nb_seeds: Sequence[int] = ()) -> list[str]:
    return [f"fixed_s{s}" for s in seeds] + [f"nb_s{s}" for s in nb_seeds] + (["nb"] if nb else [])


def stack_models(wide: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide (one pred/confidence pair per model) -> long P table."""
    arr = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"{m}_pred").alias("pred"),
                             F.col(f"{m}_confidence").alias("confidence")) for m in models])
    return (wide.select(*keep, F.explode(arr).alias("_m"))
            .select(F.col("_m.model_id").alias("model_id"), *keep,
                    F.col("_m.pred").alias("pred"), F.col("_m.confidence").alias("confidence")))


def text_predictions(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = (42,),
                     nb: bool = True, keep: Sequence[str] = ("doc_id", "split", "label", "lang"),
                     nb_seeds: Sequence[int] = (), splits: Sequence[str] = ("test",),
                     nb_lang: str | None = None) -> DataFrame:
    extra = [c for c in keep if c not in ("doc_id", "split", "label", "lang")]
    wide = text_scored(spark, sf_dir, seeds, nb, extra_cols=[c for c in extra if c != "slices"],
                       with_slices="slices" in keep, nb_seeds=nb_seeds, splits=splits, nb_lang=nb_lang)
    return stack_models(wide, model_names(seeds, nb, nb_seeds), list(keep))


# ---------------------------------------------------------------------------
# embeddings (frozen encoder output, 10 classes)
# ---------------------------------------------------------------------------
def emb_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl.stratified_split(fx.embeddings(spark, sf_dir), label_col="label", key_col="vec_id")


def emb_classes(spark: SparkSession, sf_dir: str) -> int:
    """Class count of the label column (bounded metadata query)."""
    mx = fx.embeddings(spark, sf_dir).agg(F.max("label")).first()[0]
    return int(mx) + 1 if mx is not None else 0


def emb_scored(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = (42,),
               centroid: bool = True, n_classes: int | None = None,
               splits: Sequence[str] = ("validation", "test")) -> DataFrame:
    """Rows of ``splits`` with the predictions of the fixed and the centroid
    head of every seed; a centroid head is fitted on its seed's resample."""
    c = n_classes or emb_classes(spark, sf_dir)
    df = emb_split(spark, sf_dir)
    out = df.filter(F.col("split").isin(*splits))
    for s in seeds:
        out = H.with_prediction(out, H.fixed_vector_logits("embedding", s, c, EMB_DIM), prefix=f"fixed_s{s}_")
    if centroid:
        train = df.filter(F.col("split") == "train")
        for s in seeds:
            w, b = H.fit_centroids(train.filter(H.in_fit(s, "vec_id")), "embedding", "label", c, EMB_DIM)
            out = H.with_prediction(out, H.dense_logits("embedding", w, b), prefix=f"centroid_s{s}_")
    return out.drop("embedding")
