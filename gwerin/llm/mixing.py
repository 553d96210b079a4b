"""Mixing sources to target shares of all tokens, with capped repeats (problem 9).

Method: iterative proportional fitting of token weights over cells (source, language,
topic), then documents are drawn by the calibrated weights: each is taken floor(weight)
times, and the rest by sequential Poisson sampling, in order of hash / fraction until the
source's tokens are met, so a share misses its target by one document at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gwerin.session import sent, written

CELLS = 500_000  # cells up to which they are raked on the driver; more are raked as a table, with the same weights
SOURCES = 20_000  # sources with targets; the table of targets is small by nature, and checked
STEPS = 1 << 16  # steps of the sampling order


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: np.ndarray, caps: np.ndarray, total: float, rounds: int = 50) -> np.ndarray:
    """Weight of each cell so that the tokens of source s come to shares[s] * total and no weight passes caps[s].

    ``codes`` are the cells' classes by margin, the source first. The other margins are
    pulled to their shares of the corpus as far as the sources allow; the source margin is
    fitted last and exactly.
    """
    w = np.ones(len(tokens))
    goals = [shares * total] + [np.bincount(c, weights=tokens) / tokens.sum() * total for c in codes[1:]]
    cap = caps[codes[0]].astype(float)
    for _ in range(rounds):
        before = w.copy()
        for c, goal in list(zip(codes, goals))[1:]:
            now = np.bincount(c, weights=w * tokens, minlength=len(goal))
            w = np.minimum(cap, w * np.sqrt(goal / np.maximum(now, 1e-12))[c])
        w = _fill(tokens, codes[0], goals[0], cap, w)
        if np.abs(w - before).max(initial=0) < 1e-9:
            break
    return w


def _fill(tokens: np.ndarray, source: np.ndarray, goal: np.ndarray, cap: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scale the weights of each source to its goal, those at their cap standing still."""
    w = np.minimum(cap, np.maximum(w, 1e-9))
    for _ in range(200):
        now = np.bincount(source, weights=w * tokens, minlength=len(goal))
        free = w < cap * (1 - 1e-12)
        loose = np.bincount(source, weights=np.where(free, w * tokens, 0), minlength=len(goal))
        factor = np.where(loose > 0, (goal - now + loose) / np.maximum(loose, 1e-12), 1.0)
        new = np.where(free, np.minimum(cap, w * np.maximum(factor, 0)[source]), w)
        down = (goal < now * (1 - 1e-12)) & (loose == 0)
        new = np.where(down[source], w * (goal / np.maximum(now, 1e-12))[source], new)
        if np.abs(new - w).max(initial=0) < 1e-12:
            break
        w = new
    return w


def rake_table(cells: DataFrame, total: float, rounds: int = 50) -> DataFrame:
    """As ``rake``, over a table of cells: (source, lang, topic, tokens, goal, cap) in, the same with the weight ``w`` out."""
    all_tokens = cells.agg(F.sum("tokens")).first()[0]
    cells = written(cells.withColumn("w", F.lit(1.0)))
    margins = {m: written(cells.groupBy(m).agg((F.sum("tokens") / all_tokens * total).alias("due"))) for m in ("lang", "topic")}
    moved = lambda df, old: df.agg(F.max(F.abs(F.col("w") - F.col(old)))).first()[0] or 0.0
    for _ in range(rounds):
        now = cells.withColumn("before", F.col("w"))
        for m, goal in margins.items():
            have = now.groupBy(m).agg(F.sum(F.col("w") * F.col("tokens")).alias("have")).join(goal, m)
            now = written(now.join(have, m).withColumn("w", F.least("cap", F.col("w") * F.sqrt(F.col("due") / F.greatest("have", F.lit(1e-12))))).drop("due", "have"))
        now = now.withColumn("w", F.least("cap", F.greatest("w", F.lit(1e-9))))
        for _ in range(200):
            free = F.col("w") < F.col("cap") * (1 - 1e-12)
            sums = now.groupBy("source").agg(F.sum(F.col("w") * F.col("tokens")).alias("have"), F.sum(F.when(free, F.col("w") * F.col("tokens")).otherwise(0.0)).alias("loose"))
            factor = F.when(F.col("loose") > 0, F.greatest(F.lit(0.0), (F.col("goal") - F.col("have") + F.col("loose")) / F.greatest("loose", F.lit(1e-12)))).otherwise(1.0)
            new = F.when(free, F.least("cap", F.col("w") * factor)).otherwise(F.col("w"))
            new = F.when((F.col("goal") < F.col("have") * (1 - 1e-12)) & (F.col("loose") == 0), F.col("w") * F.col("goal") / F.greatest("have", F.lit(1e-12))).otherwise(new)
            now = written(now.join(F.broadcast(sums), "source").withColumn("old", F.col("w")).withColumn("w", new).drop("have", "loose"))  # one row a source with target
            if moved(now, "old") < 1e-12:
                break
        cells = now.drop("old")
        if moved(cells, "before") < 1e-9:
            break
        cells = cells.drop("before")
    return cells.select("source", "lang", "topic", "w")


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, float]:
    """Cells with weights (source, lang, topic, w), and the total of tokens.

    ``sizes`` has source, lang, topic and tokens of each document. Targets of sources without
    tokens can't be met; the others' shares are scaled to sum to 1. The default total is
    the largest that all sources reach within their repeats. Every value of a margin is
    raked on its own.
    """
    spark, schema = sizes.sparkSession, "source string, lang string, topic string, w double"
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").limit(SOURCES + 1).collect()}
    if len(wanted) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources have targets")
    listed = spark.createDataFrame([(s, x, n) for s, (x, n) in wanted.items()], "source string, share double, cap int")
    cells = written(sizes.where(F.col("tokens") > 0).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(listed), "source"))
    have = {r["source"]: float(r["n"]) for r in cells.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # at most SOURCES
    if not have:
        return spark.createDataFrame([], schema), 0.0
    whole = sum(wanted[s][0] for s in sorted(have))
    share = {s: wanted[s][0] / whole for s in have}
    total = min(wanted[s][1] * n / share[s] for s, n in have.items())
    if total_tokens is not None:
        total = min(total, float(total_tokens))
    some = cells.limit(CELLS + 1).collect()
    if len(some) > CELLS:
        goals = spark.createDataFrame([(s, x * total) for s, x in share.items()], "source string, goal double")
        return rake_table(cells.join(F.broadcast(goals), "source").select("source", "lang", "topic", F.col("tokens").cast("double").alias("tokens"), "goal", F.col("cap").cast("double").alias("cap")), total), total
    some.sort(key=lambda r: (r["source"], r["lang"], r["topic"]))
    codes, values = [], {}
    for margin in ("source", "lang", "topic"):
        values[margin] = {v: i for i, v in enumerate(sorted({r[margin] for r in some}))}
        codes.append(np.array([values[margin][r[margin]] for r in some]))
    tokens = np.array([float(r["tokens"]) for r in some])
    w = rake(tokens, codes, np.array([share[s] for s in values["source"]]), np.array([wanted[s][1] for s in values["source"]]), total)
    return spark.createDataFrame([(r["source"], r["lang"], r["topic"], float(x)) for r, x in zip(some, w)], schema), total


def _labelled(sizes: DataFrame, key: str) -> DataFrame:
    return sizes.select(key, "source", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("topic", F.lit("none")).alias("topic"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def mix(sizes: DataFrame, targets: DataFrame, key: str, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(key, source, tokens, copies) of all documents: how often each is used.

    ``sizes`` has key, source, lang, topic and tokens. Documents without tokens, with a null
    source or one without target are used 0 times. No document passes max_repeats.
    """
    sizes = _labelled(sizes, key)
    cells, total = plan_mix(sizes, targets, total_tokens)
    weights = sent(cells, CELLS)
    rows = sizes.join(weights, ["source", "lang", "topic"], "left")
    base = F.when(F.col("tokens") > 0, F.floor(F.coalesce("w", F.lit(0.0)) + 1e-9)).otherwise(0)
    part = F.greatest(F.lit(0.0), F.coalesce("w", F.lit(0.0)) - base)
    chance = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = rows.withColumn("base", base).withColumn("x", F.when((part > 1e-9) & (F.col("tokens") > 0), chance / part))
    rows = rows.withColumn("step", F.least(F.lit(STEPS - 1), F.floor(F.col("x") * (STEPS // 2))))

    # tokens still due of each source, and the step of the order where they are met
    shares = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"))
    used = rows.groupBy("source").agg(F.sum(F.col("base") * F.col("tokens")).alias("sure"), F.max(F.col("w").isNotNull()).alias("has"))
    due = used.join(F.broadcast(shares), "source").where("has")
    due = due.withColumn("due", F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(0))) * total - F.col("sure")).select("source", "due")
    steps = rows.where("step is not null").groupBy("source", "step").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(due), "source")
    whole = steps.where(F.col("before") + F.col("n") <= F.col("due")).groupBy("source").agg(F.max("step").alias("whole"))
    cut = steps.where((F.col("before") < F.col("due")) & (F.col("before") + F.col("n") > F.col("due"))).select("source", F.col("step").alias("cut"), (F.col("due") - F.col("before")).alias("left"))
    limits = F.broadcast(due.select("source").join(whole, "source", "left").join(cut, "source", "left"))  # one row a source with target
    rows = rows.join(limits, "source", "left")

    # within the one step where the tokens are met, by order
    edge = rows.where("step = cut").select(key, "source", "tokens", "x", "left")
    line = Window.partitionBy("source").orderBy("x", key).rowsBetween(Window.unboundedPreceding, -1)
    extra = edge.where(F.col("left") > 0).withColumn("sum", F.coalesce(F.sum("tokens").over(line), F.lit(0))).where(F.col("sum") + F.col("tokens") / 2 <= F.col("left")).select(key, F.lit(1).alias("edge"))
    rows = rows.join(extra, key, "left")
    more = F.when(F.col("step") <= F.coalesce("whole", F.lit(-1)), 1).otherwise(F.coalesce("edge", F.lit(0)))
    return rows.select(key, "source", "tokens", (F.col("base") + more).cast("long").alias("copies"))


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source with documents or a target: target and actual share, tokens, documents and copies used."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    t = targets.select(F.col("source").alias("s"), "target_share", "max_repeats")
    both = used.join(t, used["source"].eqNullSafe(t["s"]), "full_outer")
    whole = Window.partitionBy(F.lit(0))  # one row a source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select(
        F.coalesce("source", "s").alias("source"), "target_share", F.when(F.sum("tokens").over(whole) > 0, F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(whole)).otherwise(0.0).alias("actual_share"),
        zero("tokens"), zero("documents"), zero("copies"), zero("most_repeats"), "max_repeats",
    )


def margin_shares(mixed: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(margin, value, corpus_share, actual_share) of each language and topic: shares of tokens of all documents, and of the mix."""
    copies = mixed.select(F.col(key).alias("_k"), "copies").groupBy("_k").agg(F.max("copies").alias("copies"))
    both = _labelled(sizes, key).join(copies, F.col(key) == F.col("_k"), "left")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in ("lang", "topic")])).alias("m"), "tokens", (F.col("tokens") * F.coalesce("copies", F.lit(0))).alias("used"))
    out = long.groupBy("m.margin", "m.value").agg(F.sum("tokens").alias("tokens"), F.sum("used").alias("used"))
    sums = out.groupBy("margin").agg(F.sum("tokens").alias("t"), F.sum("used").alias("u"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.join(F.broadcast(sums), "margin").select("margin", "value", share("tokens", "t").alias("corpus_share"), share("used", "u").alias("actual_share"))  # two rows
