"""Carrying values along an order without putting a whole entity into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_blocks(df: DataFrame, entity: list[str], bucket: str, value: str, out: str, fanout: int = 256, levels: int = 1) -> DataFrame:
    """Last non-null ``value`` of the entity's earlier buckets; one row per (entity, bucket) in and out.

    Windows are over (entity, bucket // fanout); each block passes one row to the next level.
    """
    if levels == 0:
        w = Window.partitionBy(*entity).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    block = f"_block{levels}"
    df = df.withColumn(block, F.floor(F.col(bucket) / fanout))
    w = Window.partitionBy(*entity, block).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.last(value, ignorenulls=True).over(w))
    tops = df.groupBy(*entity, block).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(bucket))).alias("_top"))
    above = carry_blocks(tops, entity, block, "_top", "_above", fanout, levels - 1).select(*entity, block, "_above")
    return inside.join(above, [*entity, block], "left").withColumn(out, F.coalesce("_inside", "_above")).drop("_inside", "_above", block)


def last_before(df: DataFrame, entity: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Each row with the last non-null ``value`` of the entity's rows before it; ``bucket`` is a number that rises with ``order``.

    The entity columns must not be null.
    """
    w = Window.partitionBy(*entity, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("_here", F.last(value, ignorenulls=True).over(w))
    tops = df.groupBy(*entity, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    tops = carry_blocks(tops, entity, bucket, "_last", "_earlier").select(*entity, bucket, "_earlier")
    return here.join(tops, [*entity, bucket], "left").withColumn(out, F.coalesce("_here", "_earlier")).drop("_here", "_earlier")


def carry_sums(df: DataFrame, entity: list[str], bucket: str, value: str, out: str, fanout: int = 256, levels: int = 1) -> DataFrame:
    """Sum of ``value`` over the entity's earlier buckets, 0 for none; one row per (entity, bucket) in and out. In blocks like ``carry_blocks``."""
    zero = F.lit(0).cast("long")
    if levels == 0:
        w = Window.partitionBy(*entity).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), zero))
    block = f"_block{levels}"
    df = df.withColumn(block, F.floor(F.col(bucket) / fanout))
    w = Window.partitionBy(*entity, block).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.sum(value).over(w))
    tops = df.groupBy(*entity, block).agg(F.sum(value).alias("_top"))
    above = carry_sums(tops, entity, block, "_top", "_above", fanout, levels - 1).select(*entity, block, "_above")
    return inside.join(above, [*entity, block], "left").withColumn(out, F.coalesce("_inside", zero) + F.coalesce("_above", zero)).drop("_inside", "_above", block)


def sum_before(df: DataFrame, entity: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Each row with the sum of ``value`` over the entity's rows before it; ``bucket`` is a number that rises with ``order``.

    The entity columns must not be null.
    """
    w = Window.partitionBy(*entity, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("_here", F.sum(value).over(w))
    tops = carry_sums(df.groupBy(*entity, bucket).agg(F.sum(value).alias("_sum")), entity, bucket, "_sum", "_earlier").select(*entity, bucket, "_earlier")
    zero = F.lit(0).cast("long")
    return here.join(tops, [*entity, bucket], "left").withColumn(out, F.coalesce("_here", zero) + F.coalesce("_earlier", zero)).drop("_here", "_earlier")
