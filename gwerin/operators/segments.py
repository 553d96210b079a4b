"""Segments in time: overlap, trimming, repeats and islands."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin.operators.carry import last_before, sum_before


def shift_and_trim(df: DataFrame, start: str, end: str, offset: float, low: float, high: float) -> DataFrame:
    """Times moved by ``offset``; rows that reach more than 0.05 s out of [low, high] are left out."""
    out = df.withColumns({start: F.round(F.col(start) + offset, 3), end: F.round(F.col(end) + offset, 3)})
    return out.where((F.col(start) >= low - 0.05) & (F.col(end) <= high + 0.05))


def running_max(df: DataFrame, key: str, start: str, row_id: str, of: dict[str, Column], bucket_seconds: float = 600.0) -> DataFrame:
    """The largest of each column over the key's rows before each row, over buckets of time."""
    df = df.withColumn("_b", F.floor(F.col(start) / bucket_seconds)).withColumns({f"_v_{c}": v for c, v in of.items()})
    w = Window.partitionBy(key, "_b").orderBy(start, row_id).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(key, "_b").agg(*[F.max(f"_v_{c}").alias(f"_top_{c}") for c in of])
    wide = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    tops = tops.select(key, "_b", *[F.max(f"_top_{c}").over(wide).alias(f"_earlier_{c}") for c in of])
    here = df.withColumns({f"_here_{c}": F.max(f"_v_{c}").over(w) for c in of}).join(tops, [key, "_b"], "left")
    return here.withColumns({c: F.greatest(f"_here_{c}", f"_earlier_{c}") for c in of}).drop("_b", *[f"_{x}_{c}" for x in ("v", "here", "earlier") for c in of])


def running_end(df: DataFrame, key: str, start: str, end: str, row_id: str, bucket_seconds: float = 600.0) -> DataFrame:
    """``before``: the largest end of the key's rows before each row."""
    return running_max(df, key, start, row_id, {"before": F.col(end)}, bucket_seconds)


def _groups(df: DataFrame, key: str, start: str, row_id: str, opens: Column) -> DataFrame:
    """``island``: id of the last row, at or before each, of those that open a group."""
    out = df.withColumn("_first", F.when(opens, F.struct(F.col(row_id).alias("i")))).withColumn("_b", F.floor(F.col(start) / 600.0))
    out = last_before(out, [key], "_b", [start, row_id], "_first", "_open")
    return out.withColumn("island", F.coalesce("_first", "_open")["i"]).drop("_first", "_open", "_b")


def islands(df: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """``island``: id of the first row of each maximal group of overlapping rows."""
    out = running_end(df, key, start, end, row_id)
    return _groups(out, key, start, row_id, F.col("before").isNull() | (F.col("before") <= F.col(start))).drop("before")


def _kept(rows: list[dict], threshold: float) -> list[int]:
    """Ids that stay of rows in order of start and id."""
    out: list[dict] = []
    for x in rows:
        last = out[-1] if out else None
        overlap = max(0.0, min(last["e"], x["e"]) - max(last["s"], x["s"])) if last else 0.0
        if last and max(overlap / max(last["e"] - last["s"], 1e-6), overlap / max(x["e"] - x["s"], 1e-6)) >= threshold:
            if x["c"] > last["c"]:
                out[-1] = x
        else:
            out.append(x)
    return [x["i"] for x in out]


def drop_overlaps(df: DataFrame, key: str, start: str, end: str, row_id: str, score: str, threshold: float = 0.8) -> DataFrame:
    """Ids of the rows that stay: against the last row accepted, one that covers it or is covered by ``threshold`` replaces it only if its score is higher.

    A row that no earlier row can replace or be replaced by is accepted whatever came
    before, so it opens a group of its own: the fold runs over chains of rows that cover one
    another by the threshold, not over all that overlap, and equals one fold over the whole
    key. Rows without times are left out.
    """
    s, e, floor = F.col(start), F.col(end), F.lit(1e-6)
    size = F.greatest(e - s, floor)
    # of the earlier rows the one that ends last covers most of a row; the one whose last ``1 - threshold`` begins latest is covered most by it
    rows = running_max(df.where(f"{key} is not null and {start} is not null and {end} is not null"), key, start, row_id, {"_ends": e, "_covered": e - threshold * size})
    alone = F.col("_ends").isNull() | (((F.least("_ends", e) - s) / size < threshold - 1e-9) & (F.col("_covered") < s - 1e-9))
    rows = _groups(rows, key, start, row_id, alone)

    @F.arrow_udf("array<bigint>")
    def kept(groups: pa.Array) -> pa.Array:
        return pa.array([_kept(g, threshold) for g in groups.to_pylist()], pa.list_(pa.int64()))

    item = F.struct(s.cast("double").alias("s"), F.col(row_id).cast("bigint").alias("i"), e.cast("double").alias("e"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("c"))
    groups = rows.groupBy(key, "island").agg(F.array_sort(F.collect_list(item)).alias("_g"), F.count("*").alias("_n"))
    single = groups.where("_n = 1").select(key, F.col("_g")[0]["i"].alias(row_id))
    return single.unionByName(groups.where("_n > 1").select(key, F.explode(kept(F.col("_g"))).alias(row_id)))


def collapse_repeats(df: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """Rows whose value differs from that of the row directly before; null differs from all but null."""
    out = df.where(F.col(key).isNotNull()).withColumn("_b", bucket).withColumn("_v", F.struct(F.col(value).alias("v")))
    out = last_before(out, [key], "_b", order, "_v", "_before")
    return out.where(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))).drop("_b", "_v", "_before")


def equal_runs(df: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """``run``: number of the group of adjacent rows of equal value within the key, from 0; null equals null."""
    out = df.where(F.col(key).isNotNull()).withColumn("_b", bucket).withColumn("_v", F.struct(F.col(value).alias("v")))
    out = last_before(out, [key], "_b", order, "_v", "_before")
    out = out.withColumn("_new", (F.col("_before").isNotNull() & ~F.col("_before.v").eqNullSafe(F.col(value))).cast("long"))
    return sum_before(out, [key], "_b", order, "_new", "_sum").withColumn("run", F.col("_sum") + F.col("_new")).drop("_b", "_v", "_before", "_new", "_sum")


def around(hits: DataFrame, rows: DataFrame, key: str, hit_id: str, order: list[str], row_id: str, n: int, bucket: Column) -> DataFrame:
    """(hit_id, row_id, offset): the rows up to ``n`` before and behind each hit's row in the order of the key; ``hits`` has hit_id and row_id."""
    at = sum_before(rows.where(F.col(key).isNotNull()).select(key, row_id, *order).withColumn("_b", bucket).withColumn("_one", F.lit(1).cast("long")), [key], "_b", [*order, row_id], "_one", "_at")
    mine = hits.join(at.select(key, row_id, "_at"), row_id).select(hit_id, key, F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("offset"), "_at").withColumn("_at", F.col("_at") + F.col("offset"))
    return mine.join(at.select(key, "_at", row_id), [key, "_at"]).select(hit_id, row_id, "offset")
