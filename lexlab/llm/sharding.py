"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` positions.  Every shard owns ``virtual_nodes`` of them; a
key hashes to a cell and belongs to the next virtual node clockwise.  A shard
takes keys up to its bound; keys that find it full continue clockwise to the
next shard with room.  With ``slack`` 0 the bounds add up to exactly the number
of rows (the remainder goes to the first shards), so the counts of any two
shards differ by one at most; with a larger slack fewer keys overflow, and
fewer move when a shard is added.

How it runs: the keys are counted by cell (``cells`` numbers at most, whatever
the table size); the walk round the ring happens on those numbers alone and
yields intervals ``(cell, first rank, last rank) -> shard, first slot``, at most
``cells + shards`` of them; every row then finds its interval by its rank in the
cell.  Ranks come in two levels, a running sum over ``(cell, sub-cell)`` counts
and a rank inside the sub-cell, so a key that holds a third of all rows spreads
over ``sub_cells`` groups; rows equal in key, size and checksum travel as one
row with a count.  DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlab.session import stage_table

COPY_BLOCK = 65_536


def ring(n_shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of all virtual nodes, clockwise."""
    found = []
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}/{v}".encode()).digest()
            found.append((int.from_bytes(digest[:8], "big") % cells, digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(found)]


def bounds(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may take."""
    if slack <= 0:
        return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    return [-int(-(1 + slack) * n_rows // n_shards)] * n_shards


def walk(counts: dict[int, int], n_shards: int, virtual_nodes: int, cells: int,
         slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Intervals ``(cell, lo, hi, shard, slot)``: the rows of the cell ranked
    ``lo <= rank < hi`` go to the shard's slots from ``slot`` on."""
    nodes = ring(n_shards, virtual_nodes, cells)
    room, used = bounds(sum(counts.values()), n_shards, slack), [0] * n_shards
    nxt = list(range(len(nodes)))  # the first node from here on, clockwise, whose shard may have room

    def with_room(i: int) -> int:
        trail = []
        i %= len(nodes)
        while room[nodes[i][1]] == used[nodes[i][1]] or nxt[i] != i:
            trail.append(i)
            i = (i + 1) % len(nodes) if nxt[i] == i else nxt[i]
        for t in trail:
            nxt[t] = i
        return i

    out, at = [], 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        left, lo, i = counts[cell], 0, at
        while left:
            i = with_room(i)
            shard = nodes[i][1]
            take = min(left, room[shard] - used[shard])
            out.append((cell, lo, lo + take, shard, used[shard]))
            used[shard] += take
            lo, left = lo + take, left - take
    return out


def shard_rows(df: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text",
               virtual_nodes: int = 64, slack: float = 0.0, cells: int = 1 << 14,
               sub_cells: int = 1024) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row of ``df``.

    ``size`` is the UTF-8 length of the text plus 16 (null text: 16);
    ``text_crc32`` is the unsigned CRC of its UTF-8 bytes (null: of none).
    Null keys share one cell; equal keys share a cell and overflow like any
    others; repeated rows get a slot each; an empty table gives an empty
    result; other columns are ignored.
    """
    if n_shards < 1 or virtual_nodes < 1:
        raise ValueError("n_shards and virtual_nodes must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (df.select(F.col(key).alias("__key"), (F.octet_length(body) + 16).cast("long").alias("size"),
                      F.crc32(body.cast("binary")).alias("text_crc32"))
            .groupBy("__key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("cell", F.pmod(F.xxhash64("__key"), F.lit(cells)).cast("int"))
            .withColumn("sub", F.pmod(F.xxhash64("size", "text_crc32", F.lit(1), "__key"), F.lit(sub_cells)).cast("int")))
    rows = stage_table(rows, "ring-rows")
    # at most `cells` numbers
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}
    plan = walk(counts, n_shards, virtual_nodes, cells, slack)
    # at most cells + n_shards rows
    intervals = F.broadcast(df.sparkSession.createDataFrame(
        plan, "i_cell int, lo long, hi long, shard int, first_slot long"))

    before = (rows.groupBy("cell", "sub").agg(F.sum("copies").alias("n"))
              .withColumn("base", F.sum("n").over(Window.partitionBy("cell").orderBy("sub")) - F.col("n"))
              .select("cell", "sub", "base"))
    inside = Window.partitionBy("cell", "sub").orderBy("__key", "size", "text_crc32")
    ranked = (rows.withColumn("within", F.sum("copies").over(inside) - F.col("copies"))
              .join(before, ["cell", "sub"])
              .withColumn("rank", F.col("base") + F.col("within")))
    # copies in blocks, so that no array grows with the number of copies
    blocks = (ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPY_BLOCK}"))))
              .withColumn("i", F.explode(F.sequence(
                  F.col("block") * COPY_BLOCK,
                  F.least(F.col("copies"), (F.col("block") + 1) * COPY_BLOCK) - 1))))
    each = blocks.select("__key", "size", "text_crc32", "cell", (F.col("rank") + F.col("i")).alias("rank"))
    return (each.join(intervals, (F.col("cell") == F.col("i_cell")) & (F.col("rank") >= F.col("lo"))
                      & (F.col("rank") < F.col("hi")))
            .select(F.col("__key").alias(key), "size", "text_crc32", "shard",
                    (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot")))
