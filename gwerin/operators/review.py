"""Re-derivation, keyed differences, guarded upserts and the review queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Full outer join on null-safe keys; each side is first reduced to one row a key."""
    one = lambda df, p: df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*cols)).alias(p))
    o, n = one(old, "o").alias("x"), one(new, "n").alias("y")
    on = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys], F.col("x.o").alias("o"), F.col("y.n").alias("n"))


def _differs(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"o.{c}").cast("string").eqNullSafe(F.col(f"n.{c}").cast("string")) for c in cols])


def diff_classes(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], reviewed: str) -> DataFrame:
    """(keys, class): added, removed, changed, protected (reviewed and different) or same; values compare as text."""
    both = _both(old, new, keys, [reviewed, *cols])
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~_differs(cols), "same").when(F.coalesce(F.col(f"o.{reviewed}").cast("boolean"), F.lit(False)), "protected").otherwise("changed")
    return both.select(*keys, kind.alias("class"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], reviewed: str) -> DataFrame:
    """Old rows with changed ones replaced and added ones put in; reviewed rows and removed ones stay as they are."""
    both = _both(old, new, keys, [reviewed, *cols])
    keep_old = F.col("n").isNull() | F.coalesce(F.col(f"o.{reviewed}").cast("boolean"), F.lit(False))
    row = F.when(F.col("o").isNotNull() & keep_old, F.col("o")).otherwise(F.coalesce("n", "o"))
    return both.select(*keys, row.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def review_queue(facts: DataFrame, statuses: tuple[str, ...] = ("erosion", "wrong_mutation_type"), triggers: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    out = facts.where(F.col("status").isin(*statuses) & ~F.coalesce(F.col("manual_reviewed"), F.lit(False)))
    if triggers:
        out = out.where(F.lower("trigger_word").isin(triggers))
    return out.where(F.col("rule").isin(rules)) if rules else out


def review_summary(queue: DataFrame) -> DataFrame:
    """(trigger_word, rule, status, n): counts by each of the three alone, in one pass."""
    g = queue.groupingSets([["trigger_word"], ["rule"], ["status"]], "trigger_word", "rule", "status")
    return g.agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("set_id"))


def log_fold(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """State after a log of decisions: first and last value, number of entries."""
    at = F.struct(*order)
    return log.groupBy(key).agg(F.min_by(value, at).alias("original"), F.max_by(value, at).alias("current"), F.count("*").alias("review_count"))


def retry_state(attempts: DataFrame, key: str, failed: Column, deferred: Column, most: int = 3) -> DataFrame:
    """(key, attempts, deferrals, state): deferrals don't count; done after a success, else retry up to ``most`` failures."""
    n = attempts.groupBy(key).agg(F.sum(failed.cast("int")).cast("long").alias("attempts"), F.sum(deferred.cast("int")).cast("long").alias("deferrals"), F.max(~failed & ~deferred).alias("ok"))
    return n.select(key, "attempts", "deferrals", F.when(F.col("ok"), "done").when(F.col("attempts") >= most, "given_up").otherwise("retry").alias("state"))


def search(facts: DataFrame, cols: list[str], term: str, row_id: str, limit: int = 20) -> DataFrame:
    """First ``limit`` rows, by id, whose columns hold the term in any case: the feature is a short list."""
    return facts.where(F.lower(F.concat_ws(" ", *cols)).contains(term.lower())).orderBy(row_id).limit(limit)


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a seeded hash: a sampling operator, the same rows each time."""
    return df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(n)


def undiscovered(found: DataFrame, known: list[DataFrame], key: str, order: str, limit: int | None = None) -> DataFrame:
    """One row per key that no known table has, the first by ``order``; the first ``limit`` in order if given."""
    out = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    for k in known:
        out = out.join(k.select(key).distinct(), key, "left_anti")
    return out.orderBy(order, key).limit(limit) if limit else out


def choose(facts: DataFrame, triggers: list[str] | None = None, rules: list[str] | None = None, video: str = "all") -> DataFrame:
    """The facts that a rerun is about: by trigger or rule, of which one is needed, and videos whose address holds ``video``."""
    if not triggers and not rules:
        raise ValueError("a rerun needs a trigger or a rule")
    out = facts.where(F.lower("trigger_word").isin([t.lower() for t in triggers])) if triggers else facts
    out = out.where(F.col("rule").isin(rules)) if rules else out
    return out if video == "all" else out.where(F.contains("video_url", F.lit(video)))


def rerun(old: DataFrame, fresh: DataFrame, keys: list[str], cols: list[str], reviewed: str, triggers: list[str] | None = None, rules: list[str] | None = None, video: str = "all") -> tuple[DataFrame, DataFrame]:
    """(classes, facts): facts derived anew against those there are, for the chosen triggers or rules.

    The classes are those of ``diff_classes``; the facts are all old ones with the chosen
    ones changed or added, reviewed ones as they are. ``fresh`` has the columns of ``old``.
    """
    mine, new = choose(old, triggers, rules, video), choose(fresh, triggers, rules, video)
    meta = [c for c in old.columns if c not in keys and c not in cols and c != reviewed]
    if reviewed not in new.columns:
        new = new.withColumn(reviewed, F.lit(False))
    rest = old.join(mine.select(*keys).distinct(), on=reduce(lambda a, b: a & b, [old[k].eqNullSafe(mine[k]) for k in keys]), how="left_anti")
    put = upsert(mine, new, keys, cols, reviewed)
    return diff_classes(mine, new, keys, cols, reviewed), rest.drop(*meta).select(*keys, *cols).unionByName(put.select(*keys, *cols))


def positions(queue: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``place`` and ``of``: each row's number among the rows of its key, from 1, and how many there are."""
    by = Window.partitionBy(key)
    return queue.withColumns({"place": F.row_number().over(by.orderBy(*order)), "of": F.count("*").over(by)})


def numbers(spec: str) -> list[int]:
    """Indices of '0 3 5-8': single ones and ranges, each once; what is neither is left out."""
    out: set[int] = set()
    for part in spec.replace(",", " ").split():
        ends = part.split("-")
        if all(x.isdigit() for x in ends) and len(ends) <= 2:
            out.update(range(int(ends[0]), int(ends[-1]) + 1))
    return sorted(out)


def without_places(queue: DataFrame, spec: str, place: str = "place") -> DataFrame:
    """The queue without the rows at the given places."""
    return queue.where(~F.col(place).isin(numbers(spec))) if numbers(spec) else queue


def of_sources(queue: DataFrame, sources: list[str], keep: bool) -> DataFrame:
    """Only the rows of the sources (``keep``), or all but those; a null source is of none."""
    mine = F.coalesce(F.col("source").isin(sources), F.lit(False))
    return queue.where(mine if keep else ~mine)


def add_absent(queue: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The queue with those further rows whose key it lacks, one a key."""
    new = more.dropDuplicates([key]).join(queue.select(key), key, "left_anti")
    return queue.unionByName(new, allowMissingColumns=True)


def breakdown(queue: DataFrame) -> DataFrame:
    """(source, channel_register, n, level): counts by source and register, and by register."""
    g = queue.groupingSets([["source", "channel_register"], ["channel_register"]], "source", "channel_register")
    return g.agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
