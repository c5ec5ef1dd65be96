"""Records that are the same but for formatting or the order of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotsman.session import group_min_count, salt, stash

SALTS = 64


def canonical(col: Column | str) -> Column:
    """Letters and digits (Unicode L and N) without regard to case, in order; null gives the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.upper(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def keys(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(id, key): the key is a 128-bit digest of the sorted canonical fields, with 64 bits of another hash and the length.

    The last two are the collision check: records are one group only where all three agree.  Rows in which all
    fields are empty after canonicalisation are left out.
    """
    sorted_fields = F.array_sort(F.array(*[canonical(f) for f in fields]))
    joined = df.select(F.col(id_col), F.array_join(sorted_fields, "\x00").alias("_c"))
    joined = joined.where(F.length("_c") > len(fields) - 1)
    return joined.select(id_col, F.md5("_c").alias("_d"), F.xxhash64("_c").alias("_x"), F.length("_c").alias("_l")).select(
        id_col, F.concat(F.unhex("_d"), F.unhex(F.lpad(F.hex("_x"), 16, "0")), F.unhex(F.lpad(F.hex(F.col("_l").cast("bigint")), 8, "0"))).alias("key")
    )


def found_copies(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(keep_row_id, row_id): each copy beside the one of the smallest id; one row a copy, so groups stay linear.

    Repeated rows with the same id are one record of that id.  Null fields count as empty.  An empty table gives no rows.
    """
    k = stash(keys(df, id_col, fields), "keys")
    groups = group_min_count(k, "key", id_col, SALTS).where("copies > 1")
    rows = k.select("key", salt(id_col, SALTS).alias("_salt"), F.col(id_col))
    return rows.join(groups, ["key", "_salt"]).where(F.col(id_col) != F.col("least")).select(F.col("least").alias("keep_row_id"), F.col(id_col).alias("row_id"))


def collapse(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(keep_row_id, copies): one row a record, with its number of rows.  Counts are combined map-side and by salt."""
    k = keys(df, id_col, fields)
    part = k.groupBy("key", salt(id_col, SALTS).alias("_salt")).agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_n"))
    return part.groupBy("key").agg(F.min("_least").alias("keep_row_id"), F.sum("_n").alias("copies")).drop("key")


def collisions(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """One row: digests, and those shared by records that the second hash or the length tells apart (0 is expected)."""
    k = keys(df, id_col, fields).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    per = k.groupBy(F.substring("key", 1, 16).alias("digest")).agg(F.count(F.lit(1)).alias("records"))
    return per.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum((F.col("records") > 1).cast("bigint")), F.lit(0)).alias("colliding"))
