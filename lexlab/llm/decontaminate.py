"""Benchmark decontamination: a positional inverted index over the corpus.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A test item
is cut into windows of ``window`` consecutive words; a shorter item is one
window.

1. The corpus is counted once for the words of the test (every document).
2. Each window orders its words from the rarest to the commonest; the rarest is
   its *anchor*.
3. The index stores a posting for every occurrence of an anchor word in the
   corpus: document, position, and the words around it.  It is written to the
   shared folder.
4. A posting at position ``p`` of the anchor with offset ``o`` proposes the start
   ``p - o``.  The lists of the other words are intersected at their adjusted
   offsets, from the rarest on, by probing the words stored with the posting; the
   first miss ends the probe.  What is left are exact phrase matches.  With
   ``slop`` set, a posting whose neighbourhood holds all words of the window in
   any order is a proximity match.

A document is one row of the scan, its postings are made where it is read, and
the only shuffles carry term counts and the few postings of each document.  Counts are
summed before they are shuffled by word, hits carry the number of their window, and
item ids are joined to the windows of a document at the end.  The test side is broadcast
after its rows and bytes are counted: a vocabulary beyond ``MAX_BROADCAST_TERMS`` words or
``MAX_BROADCAST_BYTES`` is worked off in blocks of that size, each against all
documents; windows beyond it meet the postings in a join by the anchor word.  Joins by
a word or a window are salted, as either may be frequent.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlab.session import stage_table

MAX_BROADCAST_TERMS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
#: parts of the rows of a frequent word or window
SALTS = 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text; none for null.  A split at what lies between words takes a
    fifth of the time of collecting the matches."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), BETWEEN), ""),
                      F.array().cast("array<string>"))


def test_windows(items: DataFrame, window: int, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``win`` (words), ``items`` (ids, as strings, sorted)."""
    w = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (w.filter(F.size("words") > 0)
            .select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("win"))
            .groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _blocks(terms: DataFrame, n: int, n_bytes: int, limit: int) -> list[DataFrame]:
    """The terms in hash blocks of about ``limit`` and ``MAX_BROADCAST_BYTES`` at
    most, each for a broadcast."""
    k = max(1, -(-n // max(1, limit)), -(-n_bytes // MAX_BROADCAST_BYTES))
    return [F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(k)) == b) if k > 1 else terms) for b in range(k)]


def _salted_join(rows: DataFrame, by: str, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` on ``on``; rows with one value are dealt to
    ``SALTS`` tasks by a hash of ``by``."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [on, "salt"], how).drop("salt")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, slop: int | None = None,
                  key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  max_broadcast_terms: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """One row per row of ``docs``: ``key, n_words, n_hit, spans, items, near_items``.

    ``spans`` are the merged word ranges ``(start, end)`` inside occurrences of
    windows and ``n_hit`` their length; ``items`` are the ids (as strings, sorted
    as strings) of the items with an occurring window; ``near_items`` those with
    a proximity match only (empty unless ``slop`` is set).  A null or empty text
    has no words; items without words are passed over; an item with a null id
    counts by its windows for ``n_hit`` but is not listed; repeated rows each
    give a row; an empty table on either side gives no hits; other columns are
    ignored.
    """
    reach = window - 1 + (slop or 0)
    wins = stage_table(test_windows(items, window, key=item_key, text=item_text)
                       .withColumn("win_id", F.monotonically_increasing_id()), "test-windows")
    terms = wins.select(F.explode("win").alias("term")).distinct()
    n_terms, term_bytes = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    n_windows, window_bytes = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "win"))), F.lit(0))).first()
    by_broadcast = n_windows <= max_broadcast_terms and window_bytes <= MAX_BROADCAST_BYTES

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    if len(_blocks(terms, n_terms, term_bytes, max_broadcast_terms)) > 1:
        src = stage_table(src, "rows")  # several passes must see the same row numbers
    words = src.select("row", "__key", words_of(F.col("__text")).alias("words"))
    # 1. corpus counts of the test's words; outer, as a plain explode asks for the size first and cuts each text twice
    freq = _union([words.select(F.explode_outer("words").alias("term")).join(block, "term")
                   .groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
                   for block in _blocks(terms, n_terms, term_bytes, max_broadcast_terms)])
    # 2. words of each window, rarest first
    placed = wins.select("win_id", F.posexplode("win").alias("at", "term"))
    ordered = (_salted_join(placed, "win_id", freq, "term", "left")
               .groupBy("win_id")
               .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "at", "term")))
                    .alias("probes")))
    anchors = stage_table(ordered.select(F.col("probes")[0]["term"].alias("term"), F.col("probes")[0]["at"].alias("offset"),
                                         "probes", "win_id"), "anchors")

    # 3. postings of the anchor words, and one heading row per document (term '')
    anchor_terms = (anchors.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())
    tokens = words.select("row", "__key", "words", F.posexplode_outer(F.concat(F.array(F.lit("")), F.col("words"))).alias("i", "term"))
    at = F.col("i") - 1
    lo = F.greatest(at - reach, F.lit(0))
    # the neighbourhood is cut out where the document is read: its words never travel with a posting
    index = stage_table(_union([
        tokens.join(block, "term")
        .select("row", "__key", "term", F.size("words").cast("long").alias("n_words"), at.alias("at"), lo.alias("lo"),
                F.when(F.col("term") != "", F.slice("words", lo + 1, at - lo + 1 + reach)).alias("near"))
        for block in _blocks(anchor_terms, n_terms, term_bytes, max_broadcast_terms)]), "postings")

    # 4. intersect at adjusted offsets, from the rarest word on
    postings = index.filter(F.col("term") != "")
    found = postings.join(F.broadcast(anchors), "term") if by_broadcast else _salted_join(postings, "row", anchors, "term")
    found = found.withColumn("start", F.col("at") - F.col("offset"))
    phrase = F.forall("probes", lambda p: F.coalesce(
        F.try_element_at(F.col("near"), F.when(F.col("start") >= F.col("lo"), F.col("start") - F.col("lo") + p["at"] + 1)
                         .otherwise(F.lit(1_000_000_000))) == p["term"], F.lit(False)))
    found = found.withColumn("exact", (F.col("start") >= 0) & phrase)
    if slop is None:
        found = found.filter("exact")
    else:
        around = F.size(F.array_except(F.transform("probes", lambda p: p["term"]), "near")) == 0
        found = found.filter(F.col("exact") | around)
    hits = found.select(
        "row", "win_id", "exact",
        F.when(F.col("exact"), F.struct(F.col("start").alias("start"), (F.col("start") + F.size("probes")).alias("end"))).alias("span"))
    hits = stage_table(hits, "hits")
    spans_of = hits.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("all_spans"))
    listed = _salted_join(hits.select("row", "win_id", "exact").distinct(), "row", wins.select("win_id", "items"), "win_id")
    items_of = listed.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("exact"), F.col("items"))))).alias("items"),
                                         F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("exact"), F.col("items"))))).alias("near"))
    per_doc = spans_of.join(items_of, "row")
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    no_items = F.array().cast("array<string>")

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return (F.when(F.size(acc) == 0, F.array(x))
                .when(x["start"] <= last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
                .otherwise(F.concat(acc, F.array(x))))

    spans = F.aggregate(F.coalesce("all_spans", no_spans), no_spans, merge)
    heads = index.filter(F.col("term") == "").select("row", "__key", "n_words")
    out = (heads.join(per_doc, "row", "left")
           .select(F.col("__key").alias(key), "n_words", spans.alias("spans"),
                   F.array_sort(F.coalesce("items", no_items)).alias("items"),
                   F.coalesce(F.array_sort(F.array_except("near", F.coalesce("items", no_items))), no_items).alias("near_items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(key, "n_words", n_hit.alias("n_hit"), "spans", "items", "near_items")


def digest(result: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the query."""
    return result.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


def oracle_sql(window: int = 10) -> str:
    """DuckDB SQL: every window of every document against every test window."""
    low = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  coalesce(regexp_extract_all({low}, '{WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({low}, '{WORD}'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + {window} - 1] AS win
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {window} + 1, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dw AS (SELECT rid, s, n, w[s:s + n - 1] AS win
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item_id FROM dw JOIN win USING (win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
