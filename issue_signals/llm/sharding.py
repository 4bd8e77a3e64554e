"""Consistent-hash sharding with virtual nodes and bounded loads.

The ring has 2**RING_BITS cells. A row lies in the cell of its id's hash; each shard has `vnodes`
tokens on cells. A cell belongs to the shard of the next token clockwise. Each shard has a capacity;
rows that find their shard full continue clockwise to the next token whose shard has room. The cells
are walked once in ring order with their row counts, which are 2**RING_BITS numbers at any input size;
rows of a cell that must be parted go by their rank in it. Capacities that add up to the number of
rows give counts that are at most one apart; looser ones (`load_factor` above 1) move fewer rows when
a shard is added.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issue_signals.llm.common import shared_table, text_or_empty

RING_BITS = 16
VNODES = 64


def capacities(rows: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """Rows that each shard may hold. Factor 1: exactly `rows` together, at most one apart."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-load_factor * rows // shards)] * shards


def tokens(shards: int, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> list[tuple[int, int]]:
    """(cell, shard), in ring order. A shard's tokens don't depend on the number of shards."""
    made = ((int.from_bytes(md5(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(vnodes))
    return [(at >> (64 - ring_bits), s) for at, s in sorted(made)]


def walk(counts: dict[int, int], room: list[int], ring: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Pieces (cell, first rank, shard, first slot): rows of a cell from a rank on go to a shard, from a slot on."""
    room, used, pieces = list(room), [0] * len(room), []
    cells = [cell for cell, _ in ring]
    for cell in sorted(counts):
        rank, left = 0, counts[cell]
        at = bisect_left(cells, cell) % len(ring)
        while left:
            shard = ring[at][1]
            if took := min(left, room[shard]):
                pieces.append((cell, rank, shard, used[shard]))
                rank, left = rank + took, left - took
                room[shard] -= took
                used[shard] += took
            at = (at + 1) % len(ring)
    return pieces


def sharded(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    load_factor: float = 1.0,
    vnodes: int = VNODES,
    ring_bits: int = RING_BITS,
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    size: the text's UTF-8 bytes plus 1; text_crc32: of the same bytes; a null text has none. slot
    numbers the rows of a shard from 0. Rows of a cell are ordered by the hash of their id, then the
    id, size and checksum; rows that agree in all of them get slots in any order. Null ids lie in one
    cell, after the ids. An empty table gives no rows."""
    text = F.encode(text_or_empty(text_col), "UTF-8")
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("at", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = shared_table(rows.withColumn("cell", F.shiftrightunsigned("at", 64 - ring_bits).cast("int")), "shard-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}  # 2 ** ring_bits rows at most
    pieces = walk(counts, capacities(sum(counts.values()), shards, load_factor), tokens(shards, vnodes, ring_bits))
    grouped: dict[int, list[tuple[int, int, int]]] = {}
    for cell, rank, shard, slot in pieces:
        grouped.setdefault(cell, []).append((rank, shard, slot))
    plan = docs.sparkSession.createDataFrame(list(grouped.items()), "cell int, pieces array<struct<first:long,shard:int,slot:long>>")
    order = Window.partitionBy("cell").orderBy("at", F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - F.lit(1).cast("long"))
    mine = F.element_at(F.filter("pieces", lambda p: p["first"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(plan), "cell").withColumn("piece", mine)
    slot = F.col("piece.slot") + F.col("rank") - F.col("piece.first")
    return placed.select("doc_id", "size", "text_crc32", F.col("piece.shard").alias("shard"), slot.alias("slot"))
