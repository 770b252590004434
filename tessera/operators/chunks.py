"""Chunk store: content-addressed dedup, completeness of states, tiling and stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_row_number

SALT = bytes([0x0C, 0x43, 0x4D, 0x8A, 0x6B])  # fixed value: goes before the hashed bytes


def salted_digest(raw: Column) -> Column:
    return F.upper(F.sha2(F.concat(F.lit(SALT), raw), 256))


def dense_ids(chunks: DataFrame, digest: str, seq: str, base: int = 0) -> DataFrame:
    """Each row with the id of its digest: digests are numbered in the order of their first row, after `base`.

    Only distinct digests are ranked; a hot digest shrinks to a row per task before.
    """
    first = chunks.groupBy(digest).agg(F.min(seq).alias("first_seq"))
    ids = global_row_number(first, ["first_seq"], "chunk_id").withColumn("chunk_id", (F.col("chunk_id") + base).cast("long"))
    return chunks.join(ids, digest).withColumn("is_new", F.col(seq) == F.col("first_seq"))


def next_id(table: DataFrame, column: str) -> DataFrame:
    return table.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("next_id"))


def frame_counts(placed: DataFrame, frame: str) -> DataFrame:
    """Chunks iterated, new and found per frame."""
    return placed.groupBy(frame).agg(F.count(F.lit(1)).alias("iterated"), F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("found"))


def missing(refs: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """References to chunks that are not stored; repeated references stay repeated."""
    return refs.join(stored, key, "left_anti")


def insert_absent(stored: DataFrame, received: DataFrame, key: str, seq: str) -> DataFrame:
    """The rows to append: absent keys, the first arrival of each."""
    rest = [c for c in received.columns if c != key]
    return received.join(stored, key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(key, *[f"r.{c}" for c in rest])


def complete_states(refs: DataFrame, stored: DataFrame, state: str, key: str) -> DataFrame:
    """States whose every chunk is stored (relational division)."""
    have = stored.select(key).distinct().withColumn("_have", F.lit(True))
    found = refs.join(have, key, "left").groupBy(state).agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("all"), F.count(F.lit(1)).alias("chunks"))
    return found.where("all").select(state, "chunks")


def requested(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Requested ids in their order, with nulls for what is not stored."""
    return requests.join(stored, key, "left").orderBy("pos")


def drawable(states: DataFrame, order: str, limit: int, compat: bool = False) -> DataFrame:
    """The newest states up to the limit; `compat` keeps one more."""
    return states.orderBy(F.desc(order)).limit(limit + 1 if compat else limit)


def by_timestamp(states: DataFrame, ts: str, order: str) -> DataFrame:
    """States ascending by timestamp; of equal timestamps the one of the largest id."""
    rest = [c for c in states.columns if c != ts]
    return states.groupBy(ts).agg(F.max_by(F.struct(*rest), order).alias("r")).select(ts, *[f"r.{c}" for c in rest]).orderBy(ts)


def tiles(images: DataFrame, width: str, height: str, most_w: int, most_h: int) -> DataFrame:
    """A row per tile: its row, column, offsets and size; the last row and column hold the remainder."""
    cols, rows = F.ceil(F.col(width) / most_w).cast("int"), F.ceil(F.col(height) / most_h).cast("int")
    grid = images.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("tile_row", F.explode(F.sequence(F.lit(0), rows - 1)))
    grid = grid.withColumn("tile_col", F.explode(F.sequence(F.lit(0), cols - 1)))
    x, y = F.col("tile_col") * most_w, F.col("tile_row") * most_h
    return grid.withColumns({"x": x, "y": y, "w": F.least(F.lit(most_w), F.col(width) - x), "h": F.least(F.lit(most_h), F.col(height) - y)})


def stitch_offsets(tiles_: DataFrame, image: str) -> DataFrame:
    """Offsets from the tiles' own sizes: sums of the widths to the left and the heights above."""
    left = Window.partitionBy(image, "tile_row").orderBy("tile_col").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(image, "tile_col").orderBy("tile_row").rowsBetween(Window.unboundedPreceding, -1)
    return tiles_.withColumn("left", F.coalesce(F.sum("w").over(left), F.lit(0))).withColumn("top", F.coalesce(F.sum("h").over(above), F.lit(0)))
