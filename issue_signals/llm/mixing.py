"""Mixing sources to target weights by hash-threshold histograms. No sort of the documents, ever.

Every document has a place in [0, 2**60): the first 60 bits of an MD5 of its id and its text's MD5. A source that is
to give `target` words out of `size` words repeats all its documents floor(target / size) times; the
rest of the target is a budget, met by the documents whose place is below a threshold. The threshold
is found from histograms: words per source and cell of the first `BITS` bits of the place; the cell
in which the running sum passes the budget is the only one that is counted again, by the next `BITS`
bits, and so on for LEVELS levels. What a source gives differs from its target by at most the words
of one cell of 2**-(BITS * LEVELS) of its places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issue_signals.llm.common import WORD, shared_table, whole_row

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times that a source, and so a document, is repeated at most.
MAX_REPEATS = 3
#: Bits of the place per histogram, and histograms.
BITS, LEVELS = 10, 4


def words(text: Column) -> Column:
    """Number of words of the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column, text: Column) -> Column:
    """60 bits that depend on id and text alone, so that rows without id are spread by their texts."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target for rows of (source, source_size): one row per source.

    Each source is to have its weight's share of all words, but max_repeats times its own words at
    most; what that leaves over goes to the others by weight until none is above. That is the same
    as one level per weight, min(weight * level, cap), and the sources reach their caps in the order
    of cap / weight: one window over the sources, not the documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
    })
    # the level if exactly the sources before this one are at their caps; it holds from the first that is not
    level = (F.col("total") - F.col("capped")) / F.col("left_weight")
    free = F.col("weight") * level <= F.col("cap")
    weighed = weighed.withColumn("level", F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("ratio"), level.alias("level")))).over(everything))
    share = F.least(F.col("weight") * F.col("level.level"), F.col("cap"))
    return weighed.select("source", "source_size", F.coalesce(share, F.col("cap")).alias("target"))


def thresholds(rows: DataFrame, aims: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """source and the place below which its documents are taken once more.

    rows: source, size, place. aims: source, budget (words, below the source's own)."""
    state = aims.select("source", F.col("budget").alias("open"), F.lit(0).cast("long").alias("cell"))
    for level in range(1, levels + 1):
        shift = 60 - bits * level
        cell = F.shiftright("place", shift)
        parent = F.shiftright("place", shift + bits)
        counted = rows.alias("r").join(
            state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (parent == F.col("s.cell"))
        )
        counted = counted.groupBy("s.source", "s.open", cell.alias("cell")).agg(F.sum("size").alias("words"))
        # the 2**bits cells of a source at most
        running = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        counted = counted.withColumn("before", running - F.col("words")).withColumn("over", running > F.col("open"))
        crossed = counted.filter("over").groupBy("source").agg(F.min(F.struct("cell", "before")).alias("at"))
        state = (
            state.alias("s")
            .join(crossed.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")))
            .select("s.source", (F.col("s.open") - F.col("at.before")).alias("open"), F.col("at.cell").alias("cell"))
        )
        state = shared_table(state, "mix-thresholds")
    return state.select("source", F.shiftleft("cell", 60 - bits * levels).alias("threshold"))


def mix_plan(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, size, place) of docs, and per source what the mix takes:
    source, source_size, target, whole, threshold."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        words(F.col(f"`{text_col}`")).alias("size"),
        place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("place"),
    )
    rows = shared_table(rows, "mix-sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aims = aims.withColumn("whole", whole.cast("long"))
    aims = shared_table(aims.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    bounds = thresholds(rows, aims.filter("budget > 0"))
    plan = aims.alias("a").join(bounds.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return rows, plan.select("a.source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _repeats() -> Column:
    return F.col("whole") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, repeats, taken.

    repeats is how often the mix takes the document and taken = size * repeats. A null text has size
    0, a null source is a source of its own and the last in order, a null id is taken for an empty
    one. Rows of one source that repeat both id and text are taken alike. A source without words has target 0 and
    repeats 0. Nothing depends on the order or the partitions of docs, so reruns agree. An empty table
    gives no rows."""
    rows, plan = mix_plan(docs, id_col, text_col, source_col, weights, max_repeats)
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    out = joined.select("doc_id", "r.source", "size", "source_size", "target", _repeats().alias("repeats"))
    return out.withColumn("taken", F.col("size") * F.col("repeats"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with all its columns, whatever their names.

    The texts meet the plan, one row per source, and are not shuffled. Nulls, empty and long texts, repeated rows and an
    empty table are met as in `mixture`: a source without words has no place in the mix."""
    _, plan = mix_plan(docs, id_col, text_col, source_col)
    rows = docs.select(whole_row(docs), F.col(f"`{source_col}`").cast("string").alias("of"), place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("place"))
    joined = rows.join(plan, F.col("of").eqNullSafe(F.col("source")))
    copies = F.filter(F.sequence(F.lit(0).cast("long"), _repeats()), lambda k: k > 0)
    return joined.withColumn("copy", F.explode(copies)).select("row.*")
