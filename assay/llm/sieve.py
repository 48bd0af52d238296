"""Bitmaps of keys: which rows of a large table can have a partner in a smaller one.

A bitmap has BITS bits whatever the number of keys, in rows of 4 KB, so it can be sent to where the rows are. Rows that
it rules out need not move; the others, with few that have no partner, are joined as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BITS = 1 << 23  # 1 MB
ROW = 1 << 15  # bits of one bitmap row, fixed by bitmap_construct_agg


def _spot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BITS))


def sieved(rows: DataFrame, key: str, keys: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in the column ``key`` of ``keys``, and those where it surely is not; null is a key like others."""
    spots = keys.select(_spot(F.col(key)).alias("spot"))
    bits = spots.groupBy(F.expr(f"spot div {ROW}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"spot % {ROW}")).alias("bits"))
    bits = scratch.save(bits, name)
    spot = _spot(F.col(f"r.`{key}`"))
    placed = rows.alias("r").join(F.broadcast(bits.alias("m")), F.floor(spot / ROW) == F.col("m.part"), "left")
    byte = F.conv(F.hex(F.substring(F.col("m.bits"), (F.floor(F.pmod(spot, F.lit(ROW)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, F.pmod(spot, F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return placed.where(held).select("r.*"), placed.where(~held).select("r.*")
