"""Exact dedup over an extendible-hash index on shared files. DataFrame functions only.

A text is normalised by deleting ASCII white space and gets a 64-bit hash. The directory maps the
first bits of a hash to a bucket. It starts with one bucket; while a bucket holds more than
`bucket_rows` distinct hashes it is split by one more bit, and the directory doubles when the bucket
was as deep as the directory, up to `max_depth` bits. Every row finds its bucket in the directory.
Copies are combined by salt first, so that those of a hot text cross the network a few times, not once
per row; then the entries go to the task that owns their bucket, a range of hashes. There entries of
one hash are its chain, told apart byte by byte, and each chain link is one group. The index is
written by bucket; a row looks its group up by bucket, hash and digest.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issue_signals.llm.common import shared_table, text_or_empty, whole_row

#: Distinct hashes that one bucket holds before it splits, and the bits at which splitting ends.
BUCKET_ROWS = 8_000
MAX_DEPTH = 16
#: Entries that copies of one text send to the owner of its bucket, at most.
SALTS = 8

#: Steps of the rank that orders copies: longer text first, then smaller id (a null id last).
_STEP = 2**65
_NULL_ID = 2**63


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    for mark in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def directory(counts: dict[int, int], bucket_rows: int, max_depth: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Global depth, and (first slot, last slot, local depth) of each bucket at that depth.

    counts: distinct hashes per prefix of max_depth bits."""
    sums = [0]
    for prefix in range(1 << max_depth):
        sums.append(sums[-1] + counts.get(prefix, 0))
    depth, done, open_ = 0, [], [(0, 0)]
    while open_:
        bits, local = open_.pop()
        width = max_depth - local
        if sums[(bits + 1) << width] - sums[bits << width] <= bucket_rows or local == max_depth:
            done.append((bits, local))
            continue
        depth = max(depth, local + 1)
        open_ += [(2 * bits, local + 1), (2 * bits + 1, local + 1)]
    return depth, sorted((b << (depth - d), ((b + 1) << (depth - d)) - 1, d) for b, d in done)


def _decimal(number: int) -> Column:
    return F.lit(Decimal(number)).cast("decimal(20,0)")


def _rank(size: Column, key: Column) -> Column:
    """One decimal that is larger for the row that stays; a hash aggregate can keep it."""
    shifted = F.coalesce(key.cast("decimal(20,0)"), _decimal(_NULL_ID)) + _decimal(2**63)
    return (size.cast("decimal(16,0)") * _decimal(_STEP) - shifted).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    rest = F.pmod(rank, _decimal(_STEP))
    key = F.when(rest == 0, F.lit(Decimal(0))).otherwise(_decimal(_STEP) - rest) - _decimal(2**63)
    return F.when(key < _decimal(_NULL_ID), key.cast("long"))


def index_and_entries(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, local_depth, hash, link, text_sha256, group_size, keep_id), where link counts the texts of one
    hash, and the entries (doc_id, bucket, hash, text_sha256), one per row of docs; the index lies in the shared folder."""
    key = F.col(f"`{id_col}`").cast("long")
    norm = normalised(text_or_empty(text_col))
    rows = docs.select(key.alias("doc_id"), F.length(text_or_empty(text_col)).alias("size"), norm.alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    entries = shared_table(rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256")), "dedup-entries")

    prefix = F.shiftrightunsigned("hash", 64 - max_depth).cast("int")
    held = entries.select("hash").distinct().groupBy(prefix.alias("prefix")).count()
    depth, buckets = directory({r[0]: r[1] for r in held.collect()}, bucket_rows, max_depth)  # at most 2 ** max_depth rows
    slots = docs.sparkSession.createDataFrame(
        [(slot, number, local) for number, (low, high, local) in enumerate(buckets) for slot in range(low, high + 1)],
        "slot int, bucket int, local_depth int",
    )
    slot = F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)

    def placed(found: DataFrame) -> DataFrame:
        return found.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")  # at most 2 ** max_depth slots

    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))
    place = ["bucket", "local_depth", "hash", "norm"]
    sent = placed(rows).groupBy(*place, salt.alias("salt")).agg(F.count("*").alias("n"), F.max(_rank(F.col("size"), F.col("doc_id"))).alias("best"))
    owned = sent.repartition("bucket").groupBy(*place).agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    chain = Window.partitionBy("bucket", "hash").orderBy("text_sha256")
    index = (
        owned.select("bucket", "local_depth", "hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", _id_of(F.col("best")).alias("keep_id"))
        .withColumn("link", F.row_number().over(chain))
    )
    return shared_table(index, "dedup-index"), placed(entries).drop("local_depth")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of the texts that are equal after normalising, the longest original stays, then the smallest id.
    A null text counts as empty, and empty texts are equal to each other. A row with a null id loses
    to every other of its length and can stay only in a group without ids. Rows that repeat the
    staying row's id are all marked kept: nothing tells them apart. An empty table gives no rows."""
    index, entries = index_and_entries(docs, id_col, text_col, bucket_rows)
    found = entries.join(index.select("bucket", "hash", "text_sha256", "group_size", "keep_id"), ["bucket", "hash", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names. Of rows that repeat both id and text
    one stays. Null, empty and long texts, null ids and an empty table are met as in `exact_duplicates`."""
    key = F.col(f"`{id_col}`").cast("long")
    on = ["id", "no_id", "sha"]
    keep = exact_duplicates(docs, id_col, text_col).filter("kept")
    keep = keep.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_sha256").alias("sha"))
    sha, size = F.sha2(normalised(text_or_empty(text_col)), 256), F.length(text_or_empty(text_col))
    rows = docs.select(whole_row(docs), F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("no_id"), sha.alias("sha"), size.alias("size"))
    first = Window.partitionBy(*on).orderBy(F.desc("size"))
    rows = rows.join(keep, on, "left_semi").withColumn("place", F.row_number().over(first))
    return rows.filter("place = 1").select("row.*")
