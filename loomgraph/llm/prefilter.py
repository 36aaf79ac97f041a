"""Joins of whole rows with a list of ids of any size, of which few rows are shuffled.

The ids' bits are set in a table of fixed size, which alone is broadcast: ``BUCKETS`` bitmaps of 4 KB.
Rows whose bit is not set are surely not in the list and stay where they are; the others are joined with
the list itself by a shuffle.  The more ids, the more bits are set and the more rows are shuffled; the
result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bitmaps of 32,768 bits: the broadcast table never exceeds 1,024 * 4 KB = 4 MB.
BUCKETS = 1024


def _hashed(column: Column) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(29)), F.lit(BUCKETS * 32768))


def _marked(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """(row, near): each row as a struct, and whether the bit of its id is set."""
    kind = ids.schema[id_col].dataType  # equal ids of different types have different hashes
    bits = ids.select(_hashed(F.col(id_col)).alias("h")).groupBy(F.expr(f"h % {BUCKETS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(h div {BUCKETS})").alias("bits"))
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), _hashed(F.col(id_col).cast(kind)).alias("h"))
    placed = placed.select("row", F.expr(f"h % {BUCKETS}").alias("bucket"), F.expr(f"CAST(h div {BUCKETS} AS INT)").alias("place"))
    near = F.expr("shiftright(CAST(conv(hex(substring(bits, place div 8 + 1, 1)), 16, 10) AS INT), place % 8) & 1 = 1")
    return placed.join(F.broadcast(bits), "bucket", "left").select("row", F.coalesce(near, F.lit(False)).alias("near"))


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows joined with ``ids``, which has one row for each id and may have further columns; others go."""
    return _marked(rows, ids, id_col).where("near").select("row.*").join(ids.hint("merge"), id_col)


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in ``ids``; a null id is in no list."""
    marked = _marked(rows, ids, id_col)
    near = marked.where("near").select("row.*").join(ids.select(id_col).hint("merge"), id_col, "left_anti")
    return marked.where("NOT near").select("row.*").unionByName(near.select(*[f"`{c}`" for c in rows.columns]))
