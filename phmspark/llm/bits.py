"""Membership by bits: which rows may be wanted, without moving their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26  # 8 MB


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """Rows with _may: whether the key has the bit of a wanted one (column ``name``), as all that are wanted have, and few
    others while the wanted are few beside ``FILTER_BITS``. The bits travel to the rows, so that texts stay where they are."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    page, place = F.floor(F.col("_bit") / 32768).cast("int"), (F.col("_bit") % 32768).cast("int")
    bits = wanted.select(bit(F.col(name)).alias("_bit")).groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    met = rows.withColumn("_bit", bit(key)).withColumn("_page", page).join(F.broadcast(bits), "_page", "left")  # pages of 4 KB, FILTER_BITS / 32768 at most
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    return met.withColumn("_may", may).select(*rows.columns, "_may")
