"""Runs of identical or nearly identical consecutive events (problem 3).

Method: a lag window compares each event with its predecessor, changes are flagged,
flags are summed up to run identifiers and the runs are aggregated. To keep a hot
entity from ending in one task, the windows run over (entity, time bucket) and give each
bucket's own runs; what a bucket needs from those before it, the last event and the number
of runs, is carried over one small row per bucket, itself in blocks of buckets. Only
a bucket's first and last run can go on in another bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin.llm.textform import text_key
from gwerin.operators.carry import carry_blocks, carry_sums
from gwerin.session import written


def _same(a: Column, b: Column) -> Column:
    """Texts repeat each other: equal keys, or one letter apart with four characters and the same digits."""
    digits = lambda c: F.regexp_replace(c, r"[^\p{N}]", "")
    near = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1) & (digits(a) == digits(b))
    return F.coalesce((a == b) | near, F.lit(False))


def aggregate_runs(rows: DataFrame, entity: str, bucket: str, order: list[str], payload: list[str], continues: Callable[[Column, Column], Column], first: Column, measures: dict[str, tuple[Column, str]]) -> DataFrame:
    """Runs of consecutive rows: (entity, first, run_rows, measures).

    Rows are ordered by ``order`` within the entity; ``bucket`` rises with that order and
    cuts an entity into parts that fit a task. ``continues(row, before)`` says of two
    structs of the payload whether the row carries on the run of the one directly before.
    ``first`` is taken from the run's first row; a measure is (column, "min", "max" or "join"),
    the last joining texts in order.
    """
    by = Window.partitionBy(entity, bucket).orderBy(*order)
    me, load = F.struct(*order), F.struct(*payload)
    rows = rows.withColumn("_prev", F.lag(load).over(by)).withColumn("_head", F.row_number().over(by) == 1)
    goes_on = F.coalesce(continues(load, F.col("_prev")), F.lit(False))
    rows = rows.withColumn("_change", (~F.col("_head") & ~goes_on).cast("long"))
    rows = rows.withColumn("_run", F.sum("_change").over(by.rowsBetween(Window.unboundedPreceding, 0)))

    # runs within each bucket, numbered from 0; the first and the last may go on in its neighbours
    fold = {"min": F.min, "max": F.max}
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), " ")
    some = lambda c, how: F.struct(F.min(me).alias("at"), joined(F.struct(me.alias("at"), c.alias("text"))).alias("text")) if how == "join" else fold[how](c)
    parts = rows.groupBy(entity, bucket, "_run").agg(
        F.count(F.lit(1)).alias("run_rows"), F.min(me).alias("_at"), F.min_by(F.struct(first.alias("first")), me).alias("_first"), F.min_by(load, me).alias("_top"), F.max_by(load, me).alias("_tail"), *[some(c, how).alias(name) for name, (c, how) in measures.items()]
    )
    last = F.max("_run").over(Window.partitionBy(entity, bucket))
    parts = parts.withColumn("_last", last).withColumn("_top", F.when(F.col("_run") == 0, F.col("_top"))).withColumn("_tail", F.when(F.col("_run") == F.col("_last"), F.col("_tail")))
    parts = written(parts)  # one row a run, read three times below

    # one row per bucket: does it open a run, and how many runs are open before it
    ends = parts.where("_run = 0 or _run = _last")
    edge = ends.groupBy(entity, bucket).agg(F.max("_top").alias("_top"), F.max("_tail").alias("_tail"), F.max("_last").alias("_last"))
    edge = carry_blocks(edge, [entity], bucket, "_tail", "_before")
    edge = edge.withColumn("_opens", (~F.coalesce(continues(F.col("_top"), F.col("_before")), F.lit(False))).cast("long")).withColumn("_runs", F.col("_last") + F.col("_opens"))
    edge = carry_sums(edge, [entity], bucket, "_runs", "_sum").select(entity, bucket, (F.col("_sum") + F.col("_opens")).alias("_base"))
    ends = ends.join(edge, [entity, bucket]).withColumn("_run", F.col("_base") + F.col("_run"))
    ends = ends.groupBy(entity, "_run").agg(F.min_by("_first", "_at").alias("_first"), F.sum("run_rows").alias("run_rows"), *[(joined(name) if how == "join" else fold[how](name)).alias(name) for name, (_, how) in measures.items()])
    inner = parts.where("_run > 0 and _run < _last").withColumns({name: F.col(f"{name}.text") for name, (_, how) in measures.items() if how == "join"})
    cols = [entity, "_first", "run_rows", *measures]
    return inner.select(*cols).unionByName(ends.select(*cols)).withColumn("first", F.col("_first.first")).select(entity, "first", "run_rows", *measures)


def collapse_runs(df: DataFrame, entity: list[str], start: str, end: str, text: str, row_id: str, max_gap: float = 30.0, bucket_seconds: float = 300.0) -> DataFrame:
    """One row per run: entity columns, first_id, run_rows, run_start, run_end, duration.

    Rows that agree in entity, times and text are deliveries of one event and count once,
    under the lowest id. Events are ordered by (start, id). An event continues the run if
    its text repeats that of the event directly before it and it starts at most ``max_gap``
    seconds after that event's end. Null text repeats nothing; an event with a null entity
    or start can't be placed and is a run of its own; a null end lets nothing follow.
    Empty input gives an empty result; further columns are ignored.
    """
    e, out_of = "_entity", F.struct(*[F.col(c) for c in entity])
    rows = df.select(
        out_of.alias(e), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), F.col(row_id).alias("_id"),
        text_key(F.col(text)).alias("_k"), F.xxhash64(text).alias("_h"), F.xxhash64(text, F.lit(2)).alias("_h2"), F.col(text).isNull().alias("_null"),
    )
    whole = F.lit(True)
    for c in entity:
        whole &= F.col(f"{e}.{c}").isNotNull()
    placed = whole & F.col("_s").isNotNull()
    alone = rows.where(~placed).groupBy(e, "_s", "_e", "_k", "_h", "_h2", "_null").agg(F.min("_id").alias("_id"))
    rows = rows.where(placed).withColumn("_b", F.floor(F.col("_s") / bucket_seconds))

    by = Window.partitionBy(e, "_b")
    same = by.orderBy("_s", "_e", "_null", "_h", "_h2", "_id")
    before = F.lag(F.struct("_s", "_e", "_null", "_k", "_h", "_h2")).over(same)
    rows = rows.withColumn("_copy", before.eqNullSafe(F.struct("_s", "_e", "_null", "_k", "_h", "_h2"))).where(~F.col("_copy")).drop("_copy")

    goes_on = lambda row, before: _same(row["_k"], before["_k"]) & (F.round(row["_s"] - before["_e"], 6) <= max_gap)
    runs = aggregate_runs(rows, e, "_b", ["_s", "_id"], ["_k", "_s", "_e"], goes_on, F.col("_id"), {"run_start": (F.col("_s"), "min"), "run_end": (F.col("_e"), "max")})
    runs = runs.withColumnRenamed("first", "first_id")
    single = alone.select(e, F.col("_id").alias("first_id"), F.lit(1).cast("long").alias("run_rows"), F.col("_s").alias("run_start"), F.col("_e").alias("run_end"))
    every = runs.unionByName(single).withColumn("duration", F.col("run_end") - F.col("run_start"))
    return every.select(*[F.col(f"{e}.{c}").alias(c) for c in entity], "first_id", "run_rows", "run_start", "run_end", "duration")
