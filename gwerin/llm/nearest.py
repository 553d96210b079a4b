"""Nearest-time matching of two tables by expanding rings (problem 4).

Each distinct (entity, time) of the left side probes the right side's time buckets: its
own and both neighbours, at first in fine buckets. A match no farther than one bucket
width is provably the nearest: it is accepted and the row leaves. The rest go on with
doubled widths up to the tolerance. A doubled bucket is asked as the fine ones it is made
of, those already asked left out, so the right side is cut into fine buckets and brought
into place once for all rings. It is pre-aggregated to one row per distinct time, and each
ring is an equi-join on (entity, bucket): a hot entity spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000


def rings(tolerance: float, first: float) -> list[int]:
    """Bucket widths in µs, doubled from ``first`` until one reaches the tolerance."""
    top, width = round(tolerance * MICRO), max(1, round(min(first, tolerance) * MICRO))
    out = [width]
    while out[-1] < top:
        out.append(min(2 * out[-1], top))
    return out


def nearest_match(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, right_id: str, tolerance: float, first_ring: float | None = None) -> DataFrame:
    """The left rows, all of them, with ``<right_id>`` of the nearest right row and ``distance`` in seconds.

    Times are compared in whole µs. Of right rows at one time the lowest id counts; of two
    equally near times the earlier one. Null entity or time matches nothing. Repeated left
    rows each get the match; a left column of the name of a result column is an error.
    ``first_ring`` (default tolerance / 4) is the finest bucket in seconds.
    """
    if taken := {right_id, "distance"} & set(left.columns):
        raise ValueError(f"left columns clash with the result: {sorted(taken)}")
    micro = lambda c: F.round(F.col(c).cast("double") * MICRO).cast("long")
    left = left.withColumn("_t", micro(left_time))
    todo = left.select(F.col(entity).alias("_e"), "_t").where("_e is not null and _t is not null").distinct()
    near = right.select(F.col(entity).alias("_e"), micro(right_time).alias("_rt"), F.col(right_id).alias("_rid")).where("_e is not null and _rt is not null and _rid is not null")
    near = near.groupBy("_e", "_rt").agg(F.min("_rid").alias("_rid"))

    widths = rings(tolerance, first_ring or tolerance / 4)
    fine, top = widths[0], round(tolerance * MICRO)
    near = near.withColumn("_b", F.floor(F.col("_rt") / fine))
    rest = todo.withColumn("_best", F.lit(None).cast("struct<d:bigint,_rt:bigint,_rid:bigint>"))
    settled, reached = [], -1
    for width in widths:
        reach = -(-width // fine)
        new = [o for o in range(-reach, reach + 1) if abs(o) > reached]
        reached = reach
        own = F.floor(F.col("_t") / fine)
        asked = rest.select("_e", "_t", "_best", F.explode(F.array(*[own + o for o in new])).alias("_b"))
        distance = F.abs(F.col("_rt") - F.col("_t"))
        found = F.when(distance <= top, F.struct(distance.alias("d"), "_rt", "_rid"))
        probe = asked.join(near, ["_e", "_b"], "left").groupBy("_e", "_t").agg(F.min(F.least("_best", found)).alias("_best"))
        sure = F.coalesce(F.col("_best.d") <= width, F.lit(False))
        settled.append(probe.where(sure))
        rest = probe.where(~sure)
    probe = settled[0]
    for some in settled[1:]:
        probe = probe.unionByName(some)
    best = probe.select(F.col("_e").alias("_me"), F.col("_t").alias("_mt"), F.col("_best._rid").alias(right_id), (F.col("_best.d") / MICRO).alias("distance"))
    return left.join(best, (left[entity] == best["_me"]) & (left["_t"] == best["_mt"]), "left").drop("_t", "_me", "_mt")
