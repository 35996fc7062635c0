"""Charter extensions: slice tags, acceptance / promotion gates, registry rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlab.functions.text import word_tokens

# negation cue words of the four languages, and slice thresholds
NEGATION = ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot",
            "ne", "pas", "jamais", "aucun", "aucune", "rien", "personne",
            "nicht", "kein", "keine", "keinen", "nie", "niemals", "nichts", "niemand", "weder",
            "nunca", "jam\u00e1s", "ning\u00fan", "ninguno", "ninguna", "nada", "nadie", "tampoco")
CAPITALISED_RE = r"\p{Lu}\p{Ll}+"
LEN_SHORT, LEN_MEDIUM = 200, 1000     # tokens
ENTITY_SHARE_DEN = 5                  # capitalised words >= 1/5 of tokens
NOUNS_CAPITALISED = "de"              # capitals say nothing about names there


def slice_tags(text: str | Column, lang: str | Column, tokens: Column | None = None) -> Column:
    """array of slice names a text belongs to: all, a length bin, negation,
    entity_heavy (never for the language that capitalises all nouns)."""
    t = F.col(text) if isinstance(text, str) else text
    words = word_tokens(t) if tokens is None else tokens
    n = F.size(words)
    length = (F.when(n < LEN_SHORT, "len_short").when(n < LEN_MEDIUM, "len_medium")
              .otherwise("len_long"))
    neg = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in NEGATION])), F.lit("negation"))
    caps = F.size(F.regexp_extract_all(t, F.lit(CAPITALISED_RE), F.lit(0)))
    language = F.coalesce(F.col(lang) if isinstance(lang, str) else lang, F.lit(""))
    ent = F.when((n > 0) & (language != NOUNS_CAPITALISED) & (caps * ENTITY_SHARE_DEN >= n), F.lit("entity_heavy"))
    return F.array_compact(F.array(F.lit("all"), length, neg, ent))


def gate_rows(values: DataFrame, gates: Mapping[str, tuple[str, float, str]]) -> DataFrame:
    """Turn metric columns of a (one-row-per-group) table into gate rows.

    ``gates``: gate name -> (value column, threshold, op) with op in
    {">=", ">", "<", "<="}.  Output (gate, value, threshold, passed).
    """
    ops = {">=": lambda v, t: v >= t, ">": lambda v, t: v > t,
           "<": lambda v, t: v < t, "<=": lambda v, t: v <= t}
    arr = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"),
                             F.lit(float(th)).alias("threshold"),
                             F.coalesce(ops[op](F.col(c), F.lit(float(th))), F.lit(False)).alias("passed"))
                    for g, (c, th, op) in gates.items()])
    return values.select(F.explode(arr).alias("g")).select("g.*")


def registry_rows(df: DataFrame, config: Mapping[str, object], group_col: str = "split",
                  hash_cols: tuple[str, ...] = ("doc_id", "sentence", "label"),
                  approver: str = "pending") -> DataFrame:
    """Order-free data hash per group (sum of the rows' md5 prefixes, 60 bits
    each, as a 38-digit number, plus the row count), config hash, version and
    approver.  A NULL column is told apart from an empty one."""
    cfg_json = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(dict(config).items())]))
    row = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in hash_cols])
    row_hash = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    cfg_hash = F.sha2(cfg_json, 256)
    return (df.groupBy(group_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                      F.sum(row_hash).cast("string").alias("data_hash"))
            .withColumn("config_hash", cfg_hash)
            .withColumn("version", F.concat(F.lit("v-"), F.substring(cfg_hash, 1, 12)))
            .withColumn("approver", F.lit(approver)))


def latency_report(run_log: DataFrame, value_col: str, group_cols: tuple[str, ...] = (),
                   pct: float = 0.95, accuracy: int = 10000) -> DataFrame:
    """p50 / p95 / max of a latency column per group (approximate percentiles:
    bounded memory per group, no global sort)."""
    return run_log.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.percentile_approx(value_col, 0.5, accuracy).alias("p50"),
        F.percentile_approx(value_col, pct, accuracy).alias("p95"),
        F.max(value_col).alias("max"))
