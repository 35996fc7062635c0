"""Label domain: encode, decode, remap between families, distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.constants import FAMILY_LABEL2ID
from lexlab.functions.exprs import col, map_literal


def label2id(family: str = "general") -> dict[str, int]:
    if family not in FAMILY_LABEL2ID:
        raise ValueError(f"family must be one of {sorted(FAMILY_LABEL2ID)}")
    return dict(FAMILY_LABEL2ID[family])


def id2label(family: str = "general") -> dict[int, str]:
    return {v: k for k, v in label2id(family).items()}


def names_in_id_order(family: str = "general") -> list[str]:
    m = id2label(family)
    return [m[i] for i in sorted(m)]


def label_from_flags(quality: Column, toxic: Column) -> Column:
    """Fixture rule: toxic -> negative, quality -> positive, else neutral."""
    g = FAMILY_LABEL2ID["general"]
    return (F.when(toxic == 1, F.lit(g["negative"]))
            .when(quality == 1, F.lit(g["positive"]))
            .otherwise(F.lit(g["neutral"]))).cast("int")


def encode_label(name: str | Column, family: str = "general") -> Column:
    """name -> id; NULL for a name outside the domain."""
    return F.element_at(map_literal(label2id(family)), col(name)).cast("int")


def decode_label(label: str | Column, family: str = "general") -> Column:
    """id -> name; NULL for an unknown id."""
    return F.try_element_at(map_literal(id2label(family)), col(label))


def remap_ids(source: str = "general", target: str = "general") -> dict[int, int]:
    """Compose source id -> name -> target id.  Raises if a name is missing."""
    src, tgt = label2id(source), label2id(target)
    missing = sorted(set(src) - set(tgt))
    if missing:
        raise KeyError(f"labels {missing} absent from family {target!r}")
    return {i: tgt[name] for name, i in src.items()}


def remap_labels(df: DataFrame, source: str = "general", target: str = "general",
                 label_col: str = "label") -> DataFrame:
    """Recode label ids from one family's order to another's.

    The composed map is a literal, so this is one projection; when the two
    orders are equal the input is returned unchanged.  An id outside the source
    domain fails the job; NULL stays NULL.
    """
    mapping = remap_ids(source, target)
    if all(k == v for k, v in mapping.items()):
        return df
    new = F.try_element_at(map_literal(mapping), F.col(label_col)).cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown label id "), F.col(label_col).cast("string"))).cast("int")
    return df.withColumn(label_col, F.when(F.col(label_col).isNull() | new.isNotNull(), new).otherwise(unknown))


def label_map_table(spark: SparkSession) -> DataFrame:
    """Static relation label_map(family, id, name) for joins."""
    rows = [(fam, i, n) for fam, m in FAMILY_LABEL2ID.items() for n, i in m.items()]
    return spark.createDataFrame(rows, "family string, id int, name string")


def decode_by_join(df: DataFrame, label_map: DataFrame, family: str = "general",
                   label_col: str = "label") -> DataFrame:
    """Equi-lookup into the label domain via a broadcast join.

    The domain has a fixed, tiny size (one row per class), so the broadcast
    is bounded by construction.
    """
    dom = (label_map.filter(F.col("family") == family)
           .select(F.col("id").alias(label_col), F.col("name").alias("label_name")))
    return df.join(F.broadcast(dom), label_col, "left")


def class_distribution(df: DataFrame, name_col: str = "label_name") -> DataFrame:
    """value_counts(): one row per class, most frequent first."""
    return (df.groupBy(name_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.col(name_col)))
