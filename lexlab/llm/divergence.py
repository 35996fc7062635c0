"""Source divergence audit as an Arrow compute pipeline.

Inside ``mapInArrow`` texts go through ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and hash ``group_by``; a task hands on counts per
``(lang, source, term)``, not words.  The merged counts of terms that enough
documents of a language hold are dealt into columnar shards by term; a shard holds,
for its terms, the counts of every source of a language, and works out its share
of each distance between two sources and its own candidates for the top terms.
Shares are summed, candidates are ranked again.

All arithmetic is on integers.  With ``n`` occurrences of a term in a group of
``N`` kept occurrences and ``V`` kept terms, its smoothed share in billionths is
``p = 1 + floor(10**9 * (n + 5) / (N + 5 V))``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexlab.llm.common import batches
from lexlab.session import drop_staged, stage_table

#: what lies between terms: everything in ASCII but letters
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, PRIOR = 1_000_000_000, 5
MIN_DOCS, TOP = 30, 50
PARTIAL_ROWS = 400_000  # counts that a task holds before it hands them on
SHARD_CELLS = 1 << 12  # sources x terms of a shard, or 4 times its pairs if that is more


# ---- counts -----------------------------------------------------------------------
def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts of one batch; a group's row with the empty term says that it occurs."""
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
    marks = groups.append_column("term", pa.array([""] * len(groups), pa.string()))
    marks = marks.append_column("n", pa.array(np.zeros(len(groups), np.int64))).append_column("docs", pa.array(np.zeros(len(groups), np.int64)))
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BREAK)
    row, term = pc.list_parent_indices(parts), pc.list_flatten(parts)
    filled = pc.not_equal(pc.binary_length(term), 0)
    row, term = row.filter(filled), term.filter(filled).dictionary_encode()
    in_row = pa.table({"row": row, "t": term.indices}).group_by(["row", "t"], use_threads=False).aggregate([([], "count_all")])
    # groups by number
    a, b = lang.dictionary_encode(), source.dictionary_encode()
    group = a.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(b.dictionary) + 1) + b.indices.to_numpy(zero_copy_only=False)
    at = in_row["row"].to_numpy()
    total = (pa.table({"g": group[at], "row": at, "t": in_row["t"], "n": in_row["count_all"]})
             .group_by(["g", "t"], use_threads=False).aggregate([("n", "sum"), ("n", "count"), ("row", "min")]))
    first = pa.array(total["row_min"].to_numpy())
    terms = pa.table({"lang": lang.take(first), "source": source.take(first), "term": term.dictionary.take(total["t"].combine_chunks()),
                      "n": total["n_sum"], "docs": total["n_count"]})
    return pa.concat_tables([marks, terms])


def _merged(tables: list[pa.Table]) -> pa.Table:
    got = (pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False)
           .aggregate([("n", "sum"), ("docs", "sum")]))
    return got.rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs`` counted per task: occurrences, and rows
    that hold the term.  A group's row with the empty term stands for the group."""
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                        ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(frames):
        held, rows = [], 0
        for batch in batches(frames):
            lang, source, text = (c.cast(pa.string()) for c in batch.columns)
            held.append(_counted(lang, source, text))
            rows += held[-1].num_rows
            if rows >= PARTIAL_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows >= PARTIAL_ROWS // 2:
                    yield from held[0].combine_chunks().to_batches(100_000)
                    held, rows = [], 0
        if held:
            yield from _merged(held).combine_chunks().to_batches(100_000)

    return src.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def merged_counts(docs: DataFrame, min_docs: int = MIN_DOCS, **columns) -> tuple[DataFrame, DataFrame]:
    """``(kept, groups)``: counts of kept terms, ``lang, source, term, n, total``
    with the language's total, and a row ``lang, source, size, terms, lang_size``
    for every group, with its kept occurrences and its language's."""
    counts = stage_table(partial_counts(docs, **columns).groupBy("lang", "source", "term")
                         .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = (counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
             .filter(F.col("docs") >= min_docs).drop("docs"))
    kept = stage_table(counts.filter("term != ''").drop("docs").join(terms, ["lang", "term"])
                       .select("lang", "source", "term", "n", "total"), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = (kept.groupBy("lang", "term").agg(F.first("total").alias("total"))
             .groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size")))
    groups = stage_table(counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left")
                         .join(langs, "lang", "left").fillna(0, ["size", "terms", "lang_size"]), "groups")
    drop_staged(counts)
    return kept, groups


# ---- shards -------------------------------------------------------------------------
def shares(n: np.ndarray, size, terms) -> np.ndarray:
    """``1 + floor(SCALE * (n + PRIOR) / (size + PRIOR * terms))``, exact while
    the denominator is below 2.8e14 (some 10**14 words of one group)."""
    den = np.asarray(size, np.int64) + PRIOR * np.asarray(terms, np.int64)
    whole, rest = np.divmod(n.astype(np.int64) + PRIOR, den)
    high, rest = np.divmod(rest * 31_250, den)  # SCALE = 31,250 * 32,000
    return 1 + whole * SCALE + high * 32_000 + rest * 32_000 // den


_SHARE = "lang string, source string, part string, item string, value long"
_SHARE_ARROW = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())])


def _shard(kept: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A shard's share of the distances, and its best terms, for one language."""
    order = pc.sort_indices(groups["source"])
    groups = groups.take(order)
    sources, out = groups["source"].combine_chunks(), []
    lang = groups["lang"][0]
    size, terms, lang_size = (groups[c].to_numpy() for c in ("size", "terms", "lang_size"))
    term = kept["term"].combine_chunks().dictionary_encode()
    names, at, of = term.dictionary, term.indices.to_numpy(zero_copy_only=False), pc.index_in(kept["source"].combine_chunks(), sources).to_numpy()

    def rows(source, part, item, value):
        out.append(pa.table([pa.repeat(lang, len(item)), source, pa.repeat(part, len(item)), item, pa.array(value, pa.int64())],
                            schema=_SHARE_ARROW))

    p = np.zeros((len(sources), len(names)), np.int64)
    if len(names):
        p[:] = shares(np.zeros(len(sources), np.int64), size, terms)[:, None]
        mine = shares(kept["n"].to_numpy(), size[of], terms[of])
        p[of, at] = mine
        over = mine - shares(kept["total"].to_numpy(), lang_size[of], terms[of])
        mine = np.flatnonzero((over > 0) & (kept["n"].to_numpy() > 0))
        ranked = pa.table({"s": of[mine], "v": -over[mine], "t": names.take(pa.array(at[mine]))}).sort_by(
            [("s", "ascending"), ("v", "ascending"), ("t", "ascending")])
        s = ranked["s"].to_numpy()
        best = np.arange(len(s)) - np.searchsorted(s, s) < top
        rows(sources.take(pa.array(s[best])), "term", ranked["t"].filter(pa.array(best)).combine_chunks(), -ranked["v"].to_numpy()[best])
    for i in range(len(sources)):
        others = np.delete(np.arange(len(sources)), i)
        rows(pa.repeat(sources[i], len(others)), "pair", sources.take(pa.array(others)), np.abs(p - p[i]).sum(axis=1)[others])
    return pa.concat_tables(out) if out else _SHARE_ARROW.empty_table()


def audit_sources(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text",
                  min_docs: int = MIN_DOCS, top: int = TOP, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language
    differs from its others (part ``pair``: the sum over all kept terms of the
    distance of their shares) and from the language (part ``term``: its ``top``
    terms above the language's share).

    Null lang, source and text are empty strings, and empty ones are groups like
    any other; a text without terms counts for its group only.  Repeated rows
    count one by one; ties are ordered by the item's UTF-8 bytes; other columns are
    ignored; a single source has no pairs; an empty table gives an empty result."""
    kept, groups = merged_counts(docs, min_docs, lang=lang, source=source, text=text)
    # shares of distances are then fewer than a quarter of the cells, at any number of sources
    wide = groups.groupBy("lang").agg(F.max("terms").alias("v"), F.count(F.lit(1)).alias("s"))
    wanted = F.ceil(F.col("v") * F.col("s") / F.greatest(F.lit(shard_cells), 4 * F.col("s") * F.col("s")))
    n_shards = max(1, wide.agg(F.max(wanted)).first()[0] or 1)
    left = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n_shards)))
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    parts = (left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard"))
             .applyInArrow(lambda a, b: _shard(a, b, top), _SHARE))
    values = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = values.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
cell AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
sized AS (SELECT cell.*, v, sum(n) OVER (PARTITION BY lang, source) AS size, sum(n) OVER (PARTITION BY lang, term) AS total,
                 sum(n) OVER (PARTITION BY lang) AS lang_size
          FROM cell JOIN vocab USING (lang)),
share AS (SELECT lang, source, term, n,
                 1 + (1000000000::HUGEINT * (n + 5)) // (size + 5 * v) AS p,
                 1 + (1000000000::HUGEINT * (total + 5)) // (lang_size + 5 * v) AS q
          FROM sized),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
         GROUP BY a.lang, a.source, b.source),
scored AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
           FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source
           UNION ALL SELECT lang, source, 'term', term, p - q FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM scored)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""
