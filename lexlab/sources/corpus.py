"""Labelled-text corpus: ``sentence@label`` lines in ISO-8859-1.

Reading
-------
``read_corpus_lines`` uses Spark's text source, which hands on the bytes of
each line, and decodes those.  Files are split across tasks; lines break on
``\\n``, ``\\r`` and ``\\r\\n`` only, so NUL, U+0085 and other control characters
stay inside their line.  Every line is a row: blank ones too, which parsing
quarantines.

Parsing
-------
``parse_lines`` splits on the *last* delimiter, trims Python-``strip``
whitespace from both parts, and encodes the label.  Bad lines are not
fatal: they get a ``reason`` (``no_delimiter`` / ``unknown_label``) and can
be routed to a quarantine table; ``strict=True`` fails the job instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlab.constants import (
    AGREEMENT_FILES, AGREEMENT_MIN_PCT, CORPUS_DELIMITER, CORPUS_ENCODING,
)
from lexlab.functions.exprs import seeded_md5, split_last, strip_ws, unit_interval
from lexlab.operators.labels import encode_label


def known_subset(agreement: str) -> str:
    """The agreement subset itself; an unknown one raises."""
    if agreement in AGREEMENT_FILES:
        return agreement
    raise ValueError(f"no corpus subset {agreement!r}; there are " + ", ".join(sorted(AGREEMENT_FILES)))


def corpus_path(root: str, agreement: str = "all") -> str:
    return f"{root.rstrip('/')}/{AGREEMENT_FILES[known_subset(agreement)]}"


def read_corpus_lines(spark: SparkSession, path: str, encoding: str = CORPUS_ENCODING) -> DataFrame:
    """One row per line: (line, source_file)."""
    return (spark.read.text(path)
            .select(F.decode(F.col("value").cast("binary"), encoding).alias("line"),
                    F.col("_metadata.file_path").alias("source_file")))


def read_corpus(spark: SparkSession, root: str, agreement: str = "all",
                family: str = "general") -> DataFrame:
    """Read one agreement subset's file and parse it (good and bad rows)."""
    return parse_lines(read_corpus_lines(spark, corpus_path(root, agreement)), family=family)


def tag_agreement(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Agreement subset from the landing path (for a folder of all four)."""
    tag = F.lower(F.regexp_extract(F.col(file_col), r"Sentences_(\w+?)Agree", 1))
    return df.withColumn("agreement", tag)


def parse_lines(df: DataFrame, line_col: str = "line", family: str = "general",
                strict: bool = False) -> DataFrame:
    """Add ``sentence``, ``label_name``, ``label`` and ``reason`` columns.

    ``reason`` is NULL for a good row.
    """
    has, head, tail = split_last(F.col(line_col), CORPUS_DELIMITER)
    name = strip_ws(tail)
    out = (df.withColumn("_has", has)
             .withColumn("sentence", F.when(F.col("_has"), strip_ws(head)))
             .withColumn("label_name", F.when(F.col("_has"), name))
             .withColumn("label", encode_label(F.col("label_name"), family))
             .withColumn("reason", F.when(~F.col("_has") | F.col(line_col).isNull(), F.lit("no_delimiter"))
                         .when(F.col("label").isNull(), F.lit("unknown_label")))
             .drop("_has"))
    if strict:
        out = out.withColumn("reason", F.when(
            F.col("reason").isNotNull(),
            F.raise_error(F.concat(F.lit("bad corpus line ("), F.col("reason"), F.lit(")"))))
            .otherwise(F.col("reason")))
    return out


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def quarantine_rows(parsed: DataFrame, line_col: str = "line") -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).drop("sentence", "label", "label_name")


# ---------------------------------------------------------------------------
# agreement subsets
# ---------------------------------------------------------------------------
def with_agreement_level(df: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Deterministic agreement level (100 / 75 / 66 / 50 percent) per row,
    drawn from a hash of the key: the test tables carry no annotator data."""
    u = unit_interval(seeded_md5("agree", key_col))
    pct = (F.when(u < 0.40, 100).when(u < 0.65, 75).when(u < 0.85, 66).otherwise(50))
    return df.withColumn("agreement_pct", pct.cast("int"))


def select_agreement(df: DataFrame, agreement: str, pct_col: str = "agreement_pct") -> DataFrame:
    """Rows of one agreement subset (subsets are nested: 75 includes all)."""
    return df.filter(F.col(pct_col) >= F.lit(AGREEMENT_MIN_PCT[known_subset(agreement)]))


# ---------------------------------------------------------------------------
# writing corpus files (lands subsets for round trips)
# ---------------------------------------------------------------------------
#: what each encoding that has fewer characters than Unicode can hold
ENCODABLE = {"ISO-8859-1": r"^[\x00-\xFF]*$", "US-ASCII": r"^[\x00-\x7F]*$"}


def write_corpus_lines(lines: DataFrame, path: str, line_col: str = "line",
                       encoding: str = CORPUS_ENCODING) -> DataFrame:
    """One line per row, as bytes of ``encoding``; the lines that it cannot hold are
    not written but returned, with the reason ``not_encodable`` (none for UTF-8).
    NULL lines are written as empty ones."""
    fits = F.col(line_col).rlike("(?s)" + ENCODABLE[encoding]) if encoding in ENCODABLE else F.lit(True)
    fits = F.coalesce(fits, F.lit(True))
    body = F.when(fits, F.encode(F.when(fits, F.coalesce(F.col(line_col), F.lit(""))), encoding).cast("string"))
    lines.filter(fits).select(body.alias("value")).write.mode("overwrite").text(path)
    return lines.filter(~fits).withColumn("reason", F.lit("not_encodable"))
