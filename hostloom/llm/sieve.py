"""A bitmap of hashed ids, which lets rows through before a join that would otherwise shuffle all of them.

The bitmap has about sixteen bits an id and MOST bits at most, so its size is bounded whatever the number of ids; where
there are more ids, it lets more rows through that the join then rejects. Results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: least and most (16 MB); bits of one of its rows.
LEAST, MOST, ROW = 1 << 20, 1 << 27, 32768


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(bits))


def sieve(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with a column of the name "\\0maybe": whether the key may be among those of ids. A null key may not.

    ids: a table that has been written, for it is read twice.
    """
    n = ids.count()
    bits = min(MOST, max(LEAST, 1 << (16 * n).bit_length()))
    place = _place(key, bits)
    bitmap = ids.select(place.alias("p")).filter("p is not null").groupBy(F.expr(f"p div {ROW}").alias("\0row")).agg(F.expr(f"bitmap_construct_agg(p % {ROW})").alias("\0bits"))
    rows = rows.withColumn("\0place", place).withColumn("\0row", F.floor(F.col("\0place") / ROW).cast("long"))
    rows = rows.join(F.broadcast(bitmap), "\0row", "left")  # MOST bits at most
    within = F.col("\0place") % ROW
    byte = F.conv(F.hex(F.substring(F.col("\0bits"), F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    maybe = F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return rows.withColumn("\0maybe", maybe).drop("\0row", "\0place", "\0bits")


def sifted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Only rows whose key may be among those of ids."""
    return sieve(rows, ids, key).filter(F.col("\0maybe")).drop("\0maybe")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those of ids: only those that may be are shuffled for the join."""
    told = sieve(rows, ids, key)
    clear = told.filter(~F.col("\0maybe")).drop("\0maybe")
    return clear.unionByName(told.filter(F.col("\0maybe")).drop("\0maybe").join(ids.select(key).distinct().hint("merge"), key, "left_anti").select(*(F.col(f"`{c}`") for c in clear.columns)))
