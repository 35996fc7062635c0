"""Stratified train / validation / test split, sampling, split checks.

Exact mode (default)
--------------------
Sizes follow stratified shuffle-split arithmetic with exact integers:

    hold  = ceil(30 n / 100)          train = n - hold
    test  = ceil(hold / 2)            val   = hold - test

Per class, the train share is the largest-remainder apportionment of
``train`` over the class counts (ties by class id), the rest of the class is
its holdout; the validation share is the same apportionment of ``val`` over
the holdout counts, the rest is test.

Within each class rows are ordered by ``md5('<seed>:<key>')``; the first
``test_c`` rows are test, the next ``val_c`` validation, the rest train.
That ordering is computed without a window over a whole class (a class may
hold most of the table):

1. histogram of (class, first 4 hex digits of the hash): at most
   classes x 65,536 rows, pre-aggregated map-side and stored;
2. running sums over that histogram give each bucket's start offset, and the
   at most two buckets per class that hold a cut;
3. only the rows of those buckets (about 1/65,536 of a class each) are ranked,
   to find the hash value at the cut;
4. every row is then labelled by comparing its hash with at most two
   (bucket, hash) thresholds of its class, looked up in literal maps: a pure
   projection, no join and no shuffle of the data rows.

The driver sees one count and at most two thresholds per class.  The quota
arithmetic runs there in exact Python integers.

NULL labels are a class of their own (last in the order of ties).  Rows with
equal keys share a hash and always land in the same split, so that no copy
leaks; sizes are then off by at most the rows of one key per cut.  A NULL key
counts as one key.

With ``group_col`` the hash is taken of the group key, so copies (for
example identical texts) with the same label always land in the same split
(copies carrying different labels sit in different class strata); sizes may
then be off by at most one group per cut.

Hash mode
---------
``mode="hash"``: one projection, split by the hash fraction; no shuffle,
sizes approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlab.constants import (
    HOLDOUT_DEN, RATIO_DEN, SPLIT_SEED, TEST_OF_HOLDOUT_NUM, TRAIN_RATIO_NUM,
)
from lexlab.functions.exprs import map_literal, seeded_md5, unit_interval
from lexlab.session import stage_table

SPLITS = ["train", "validation", "test"]
BUCKET_HEX = 4  # 65,536 buckets per class


def split_sizes(n: int, train_num: int = TRAIN_RATIO_NUM, den: int = RATIO_DEN,
                test_num: int = TEST_OF_HOLDOUT_NUM, test_den: int = HOLDOUT_DEN) -> dict[str, int]:
    """Total split sizes with exact integer ceilings."""
    hold = -(-(den - train_num) * n // den)
    test = -(-test_num * hold // test_den)
    return {"train": n - hold, "validation": hold - test, "test": test}


def apportion(counts: dict[int, int], draws: int) -> dict[int, int]:
    """Largest-remainder apportionment of ``draws`` over class counts
    (exact integers; ties by class id)."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    floor = {c: k * draws // n for c, k in counts.items()}
    rem = {c: k * draws % n for c, k in counts.items()}
    short = draws - sum(floor.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:short]:
        floor[c] += 1
    return floor


def quotas_from_counts(counts: dict[int, int], train_num: int = TRAIN_RATIO_NUM, den: int = RATIO_DEN,
                       test_num: int = TEST_OF_HOLDOUT_NUM, test_den: int = HOLDOUT_DEN
                       ) -> dict[int, tuple[int, int, int]]:
    """class -> (train_c, val_c, test_c)."""
    n = sum(counts.values())
    hold = -(-(den - train_num) * n // den)
    train = apportion(counts, n - hold)
    hold_c = {c: counts[c] - train[c] for c in counts}
    h = sum(hold_c.values())
    test_total = -(-test_num * h // test_den)
    val = apportion(hold_c, h - test_total)
    return {c: (train[c], val[c], hold_c[c] - val[c]) for c in counts}


def stratified_split(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
                     seed: int = SPLIT_SEED, group_col: str | None = None,
                     mode: str = "exact", split_col: str = "split",
                     train_num: int = TRAIN_RATIO_NUM, den: int = RATIO_DEN,
                     test_num: int = TEST_OF_HOLDOUT_NUM, test_den: int = HOLDOUT_DEN) -> DataFrame:
    """Add a ``split`` column (train / validation / test) to ``df``.

    Exact mode runs small jobs whose results are bounded independently of the
    data size (one count and at most two thresholds per class reach the
    driver), then labels rows with a pure projection.
    """
    if mode not in ("exact", "hash"):
        raise ValueError("mode must be 'exact' or 'hash'")
    h = seeded_md5(seed, group_col or key_col)
    if mode == "hash":
        u = unit_interval(h)
        test_share = (den - train_num) / den * test_num / test_den
        hold_share = (den - train_num) / den
        return df.withColumn(split_col, F.when(u < F.lit(test_share), "test")
                             .when(u < F.lit(hold_share), "validation").otherwise("train"))

    spark = df.sparkSession
    never_null = F.coalesce(F.concat(F.lit("v"), F.col(label_col).cast("string")), F.lit("null"))
    units = (df.withColumn("_c", never_null).withColumn("_h", F.coalesce(h, F.md5(F.lit(f"{seed}:"))))
             .withColumn("_b", F.substring("_h", 1, BUCKET_HEX)))

    # 1. bounded histogram: at most classes x 16^BUCKET_HEX rows
    hist = stage_table(units.groupBy("_c", "_b").agg(F.max(label_col).alias("_label"), F.count(F.lit(1)).alias("_n")),
                       "split-histogram")
    rows = hist.groupBy("_c").agg(F.max("_label").alias("label"), F.sum("_n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["label"] is None, r["label"]) if r["label"] is not None else (True, 0))
    quotas = quotas_from_counts({i: r["n"] for i, r in enumerate(rows)}, train_num, den, test_num, test_den)

    # 2. cut positions (at most two per class) -> bucket and rank within it
    wanted = [(r["_c"], cut, pos) for i, r in enumerate(rows)
              for cut, pos in ((1, quotas[i][2]), (2, quotas[i][2] + quotas[i][1])) if pos > 0]
    th: dict[tuple[str, int], tuple[str, str]] = {}
    if wanted:
        before_b = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cuts = (hist.withColumn("_end", F.sum("_n").over(before_b))
                .join(F.broadcast(spark.createDataFrame(wanted, "_c string, cut int, pos long")), "_c")
                .filter((F.col("pos") <= F.col("_end")) & (F.col("pos") > F.col("_end") - F.col("_n")))
                .select("_c", "_b", "cut", (F.col("pos") - (F.col("_end") - F.col("_n"))).alias("rank")).collect())
        cuts = F.broadcast(spark.createDataFrame([tuple(r) for r in cuts], "_c string, _b string, cut int, rank long"))

        # 3. hash value at each cut: one row per distinct hash (copies of a hot group collapse
        # map-side), running counts inside the few cut buckets
        w = (Window.partitionBy("_c", "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at_cut = (units.select("_c", "_b", "_h").join(cuts, ["_c", "_b"], "left_semi")
                  .groupBy("_c", "_b", "_h").agg(F.count(F.lit(1)).alias("_k")).withColumn("_cum", F.sum("_k").over(w))
                  .join(cuts, ["_c", "_b"])
                  .filter((F.col("_cum") >= F.col("rank")) & (F.col("_cum") - F.col("_k") < F.col("rank"))))
        th = {(r["_c"], r["cut"]): (r["_b"], r["_h"]) for r in at_cut.collect()}

    # 4. per-row decision: a projection with literal class -> threshold maps
    #    (one map lookup per row, whatever the number of classes)
    def before(cut_id: int):
        mine = {c: v for (c, k), v in th.items() if k == cut_id}
        if not mine:
            return F.lit(False)
        tb = F.try_element_at(map_literal({c: b for c, (b, _) in mine.items()}), F.col("_c"))
        tv = F.try_element_at(map_literal({c: hv for c, (_, hv) in mine.items()}), F.col("_c"))
        cond = (F.col("_b") < tb) | ((F.col("_b") == tb) & (F.col("_h") <= tv))
        return F.coalesce(cond, F.lit(False))

    out = units.withColumn(split_col, F.when(before(1), "test").when(before(2), "validation")
                           .otherwise("train"))
    return out.drop("_h", "_b", "_c")


def split_counts(split_df: DataFrame, label_col: str = "label_name",
                 split_col: str = "split") -> DataFrame:
    """Rows per (split, class), plus per-split totals (class NULL) via rollup."""
    return (split_df.rollup(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col(split_col).isNotNull()))


def split_disjoint(source: DataFrame, split_df: DataFrame, key_col: str = "doc_id",
                   split_col: str = "split") -> DataFrame:
    """One row of partition checks: every key in exactly one split, none lost.

    Source and split rows are tagged and grouped by key together, with counts
    and least and greatest split only: one shuffle keyed by ``key_col``, then a
    single row of sums.
    """
    none = F.lit(None).cast("string")
    tagged = (source.select(F.col(key_col).alias("_key"), F.lit(1).alias("_src"), none.alias("_split"))
              .unionByName(split_df.select(F.col(key_col).alias("_key"), F.lit(0).alias("_src"), F.col(split_col).alias("_split"))))
    per_key = tagged.groupBy("_key").agg(F.max("_src").alias("src"), F.count("_split").alias("k"),
                                         F.min("_split").alias("lo"), F.max("_split").alias("hi"))

    def total(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)

    return per_key.agg(
        total(F.col("src") == 1, "n_source"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n_assigned"),
        total(F.col("lo") != F.col("hi"), "n_multi_split"), total(F.col("k") > 1, "n_duplicated"),
        total((F.col("src") == 1) & (F.col("k") == 0), "n_missing"), total(F.col("src") == 0, "n_extra"))


def sample_rows(df: DataFrame, n: int = 5, key_col: str = "doc_id", seed: int = SPLIT_SEED) -> DataFrame:
    """Seeded simple random sample of ``n`` rows (top-n by hash: the limit is
    the feature; planned as TakeOrderedAndProject, no full sort)."""
    return df.withColumn("_h", seeded_md5(seed, key_col)).orderBy("_h").limit(n).drop("_h")
