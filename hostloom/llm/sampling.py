"""Labelled rows for fitting: which rows may be learnt from, and a bounded sample of them by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, by: str, id_col: str, most: int) -> DataFrame:
    """About most rows (all, if there are fewer) for each value of by, those of the smallest id hashes.

    The counts read two columns only; rows are then told by a threshold on the hash, so that no
    value's rows meet in one task. The number of values of by is taken to be small (labels).
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(by) == F.lit(value)) & (place < int((1 << 30) * min(1.0, most / n))))
    return rows.filter(keep)
