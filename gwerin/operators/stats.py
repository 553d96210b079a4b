"""Every statistic over the facts, as DataFrame -> DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.functions import text

KEY = ["video_url", "timestamp_span", "trigger_word", "following_word"]


def dedup_facts(facts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the lowest mutation_id; null keys compare as equal.

    An aggregation rather than a window: rows are reduced in the map and no key is sorted.
    """
    cols = [c for c in (keep or facts.columns) if c not in KEY]
    first = facts.groupBy(*KEY).agg(F.min_by(F.struct(*cols), "mutation_id").alias("f"))
    return first.select(*KEY, "f.*")


def prepare(facts: DataFrame) -> DataFrame:
    """Booleans and agreement in today's form, status labels."""
    return facts.withColumns({"is_code_switch": text.to_bool(F.col("is_code_switch")), "tagger_agreement": text.agreement(F.col("tagger_agreement")), "status_label": F.coalesce(F.try_element_at(text.literal_map(T.STATUS_LABELS), F.col("status")), F.col("status"))})


def evaluable() -> Column:
    return F.col("status").isin(T.EVALUABLE)


def not_switched() -> Column:
    return ~F.coalesce(F.col("is_code_switch"), F.lit(False))


def rate(flag: str = "is_erosion") -> Column:
    return F.round(F.avg(F.col(flag).cast("int")), 6)


def erosion_by(facts: DataFrame, by: list[str], where: Column, least: int = 0) -> DataFrame:
    """contexts (non-null is_erosion) and rate by group, groups of at least ``least`` contexts."""
    out = facts.where(where).groupBy(*by).agg(F.count("is_erosion").alias("contexts"), F.sum(F.col("is_erosion").cast("int")).cast("long").alias("erosion"), rate().alias("erosion_rate"))
    return out.where(F.col("contexts") >= least)


def erosion_by_channel_type(facts: DataFrame, least: int = 10) -> DataFrame:
    """Rate of each channel by type, types with ``least`` contexts in all, absent pairs 0."""
    base = facts.where(not_switched() & (F.col("trigger_word") != "[OMITTED]") & evaluable()).groupBy("source", "expected_mutation").agg(F.count("is_erosion").alias("n"), F.sum(F.col("is_erosion").cast("int")).alias("e"))
    kept = base.withColumn("total", F.sum("n").over(Window.partitionBy("expected_mutation"))).where(F.col("total") >= least)
    kinds = ["soft", "nasal", "aspirate", "soft_limited", "h-mutation"]
    return kept.groupBy("source").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("expected_mutation") == k, F.col("e"))) / F.sum(F.when(F.col("expected_mutation") == k, F.col("n"))), F.lit(0.0)), 6).alias(k.replace("-", "_")) for k in kinds])


def videos(facts: DataFrame, cols: list[str]) -> DataFrame:
    """One row per video, that of the lowest id."""
    return facts.where("video_url is not null").groupBy("video_url").agg(F.min_by(F.struct(*cols), "mutation_id").alias("v")).select("video_url", "v.*")


def switch_rate(facts: DataFrame) -> DataFrame:
    v = videos(facts, ["source", "video_word_count", "video_codeswitch_word_count"])
    out = v.groupBy("source").agg(F.sum("video_word_count").cast("long").alias("words"), F.sum("video_codeswitch_word_count").cast("long").alias("switched"))
    return out.where("words > 0").withColumn("switch_rate", F.round(F.col("switched") / F.col("words"), 6))


def video_minutes(facts: DataFrame) -> DataFrame:
    """Videos and minutes by register, and over all (null register)."""
    v = videos(facts, ["channel_register", "video_duration_seconds"])
    return v.rollup("channel_register").agg(F.count("*").alias("videos"), F.round(F.sum(F.coalesce("video_duration_seconds", F.lit(0.0)) / 60), 4).alias("minutes"), F.grouping("channel_register").cast("int").alias("all_registers"))


def status_shares(facts: DataFrame, statuses: tuple[str, ...] = ("correct_mutation", "erosion", "wrong_mutation_type")) -> DataFrame:
    """Share in percent of each status by source, zero-filled."""
    counts = facts.where(F.col("status").isin(*statuses)).groupBy("source").agg(F.count("*").alias("n"), *[F.sum((F.col("status") == s).cast("int")).alias(s) for s in statuses])
    return counts.select("source", "n", *[F.round(F.col(s) * 100 / F.col("n"), 6).alias(f"{s}_pct") for s in statuses])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) of a column's non-null values."""
    out = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / df.where(F.col(col).isNotNull()).agg(F.count("*")).scalar(), 6))


def agreement_by_rule(facts: DataFrame) -> DataFrame:
    agree = F.col("tagger_agreement").isin(T.AGREEING).cast("int")
    return facts.where(F.col("tagger_agreement").isin(*T.AGREEING, "disputed")).groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg(agree) * 100, 6).alias("agreement_pct"))


def over_batches(facts: DataFrame) -> DataFrame:
    """Rate by day of loading and register, for registers with at least two days."""
    day = facts.where(not_switched() & evaluable()).withColumn("batch", F.date_format("loaded_at", "yyyyMMdd")).groupBy("channel_register", "batch").agg(F.count("is_erosion").alias("contexts"), rate().alias("erosion_rate"))
    return day.withColumn("_n", F.count("*").over(Window.partitionBy("channel_register"))).where("_n >= 2").drop("_n")


def top_values(df: DataFrame, col: str, by: str, k: int = 20) -> DataFrame:
    """The k most frequent values of ``by`` where ``col`` is set: the report's feature is its top k."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def headline(facts: DataFrame) -> DataFrame:
    own = not_switched()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    erosion = F.col("is_erosion") & evaluable() & own
    return facts.agg(
        F.count("*").alias("total"), n(~own).alias("code_switch"), n(own).alias("own"), n(evaluable() & own).alias("evaluable_n"), n(erosion).alias("erosion_n"), n(F.col("is_high_confidence_erosion") & evaluable() & own).alias("erosion_hc_n"),
        n(F.col("collision_flag").isNotNull() & (F.col("collision_flag") != "")).alias("collisions"), F.round(n(erosion) / n(evaluable() & own), 6).alias("erosion_rate"),
    )


def run_by(facts: DataFrame, by: str, where: Column, low: int = 10) -> DataFrame:
    """Contexts, erosion, high-confidence erosion, rates and a warning for few contexts."""
    out = facts.where(where).groupBy(by).agg(F.count("*").alias("contexts"), F.sum(F.col("is_erosion").cast("int")).cast("long").alias("erosion_all"), F.sum(F.col("is_high_confidence_erosion").cast("int")).cast("long").alias("erosion_hc"))
    return out.withColumns({"rate_all": F.round(F.col("erosion_all") / F.col("contexts"), 6), "rate_hc": F.round(F.col("erosion_hc") / F.col("contexts"), 6), "low_n_warning": F.when(F.col("contexts") < low, "LOW N").otherwise("")})


def kappa(facts: DataFrame, by: str = "source") -> DataFrame:
    """Cohen's kappa of the two taggers by group, over evaluable facts that both have tagged."""
    real = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "none", "n/a")
    a = F.when(F.col("cysill_mutation_type").isNull() | F.col("cysill_mutation_type").isin("", "n/a", "none"), "none").otherwise(F.col("cysill_mutation_type"))
    b = F.coalesce(F.try_element_at(text.literal_map(T.PARSER_TYPES), F.col("spacy_mutation")), F.lit("none"))
    cells = facts.where(evaluable() & real("cysill_pos") & real("spacy_pos")).groupBy(by, a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("ra"), F.lit(0).alias("rb")), F.struct(F.col("b").alias("c"), F.lit(0).alias("ra"), F.col("n").alias("rb")))
    margins = cells.select(by, F.explode(sides).alias("s")).groupBy(by, "s.c").agg(F.sum("s.ra").alias("ra"), F.sum("s.rb").alias("rb")).groupBy(by).agg(F.sum(F.col("ra") * F.col("rb")).alias("chance"))
    parts = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).join(margins, by)
    parts = parts.select(by, "n", (F.col("same") / F.col("n")).alias("po"), (F.col("chance") / F.col("n") / F.col("n")).alias("pe"))
    k = F.when(F.col("pe") >= 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return parts.select(by, "n", F.round(k, 6).alias("kappa"))


def per_video(facts: DataFrame) -> DataFrame:
    ok = evaluable()
    return facts.where("video_url is not null").groupBy("video_url").agg(F.min_by("video_duration_seconds", "mutation_id").alias("duration"), F.count("*").alias("contexts"), F.round(F.avg(F.when(ok, F.col("is_erosion").cast("int"))), 6).alias("erosion_rate"))


def sensitivity(facts: DataFrame) -> DataFrame:
    """Erosion rate by type with and without disputed rows."""
    ok = facts.where(not_switched() & evaluable())
    calm = ~F.coalesce(F.col("tagger_agreement") == "disputed", F.lit(False))
    return ok.groupBy("expected_mutation").agg(F.count("is_erosion").alias("contexts"), rate().alias("rate_all"), F.round(F.avg(F.when(calm, F.col("is_erosion").cast("int"))), 6).alias("rate_undisputed"))


def erosion_plain(facts: DataFrame, by: str, least: int = 0) -> DataFrame:
    """Rows, erosions and rate by one column, over evaluable facts of the home language; groups of at least ``least`` rows."""
    out = facts.where(not_switched() & evaluable()).groupBy(by).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("is_erosion").cast("int"), F.lit(0))).cast("long").alias("erosion"))
    return out.where(F.col("n") >= least).withColumn("erosion_rate", F.round(F.col("erosion") / F.col("n"), 6))


def word_counters(words: DataFrame, key: str, word: Column, switched: Column) -> DataFrame:
    """(key, words, switched): words of each video and those of the other language."""
    return words.where(F.col(key).isNotNull() & (word != "")).groupBy(key).agg(F.count("*").alias("words"), F.sum(switched.cast("int")).cast("long").alias("switched"))


def research_summary(facts: DataFrame) -> DataFrame:
    """One row: contexts, evaluable contexts, erosions and rates, cases by status, and code switching over the words of all videos, or over contexts where no words are counted."""
    v = videos(facts, ["video_word_count", "video_codeswitch_word_count"]).agg(F.coalesce(F.sum("video_word_count"), F.lit(0)).cast("long").alias("total_words"), F.coalesce(F.sum("video_codeswitch_word_count"), F.lit(0)).cast("long").alias("_switched"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    status = lambda s: n(F.col("status") == s)
    out = facts.agg(
        F.count("*").alias("total_analyzed_contexts"), n(F.col("is_code_switch")).alias("code_switch_cases_at_triggers"), n(evaluable()).alias("evaluable_non_code_switch_contexts"),
        n(evaluable() & F.col("is_erosion")).alias("erosion_cases_all"), n(evaluable() & F.col("is_high_confidence_erosion")).alias("erosion_cases_high_confidence"),
        status("correct_mutation").alias("correct_mutation_cases"), status("wrong_mutation_type").alias("wrong_mutation_type_cases"), status("phantom_mutation").alias("phantom_omission_cases"),
        status("selective_invariancy").alias("selective_invariancy_cases"), F.count("collision_flag").alias("collision_flagged_cases"), status("erosion_unverified").alias("erosion_unverified_cases"),
    )
    out = out.withColumns({"total_words": v.select("total_words").scalar(), "_switched": v.select("_switched").scalar()})
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    counted = F.col("total_words") > 0
    return out.withColumns({
        "code_switch_words_total": F.when(counted, F.col("_switched")).otherwise(F.col("code_switch_cases_at_triggers")),
        "code_switch_rate": F.when(counted, rate("_switched", "total_words")).otherwise(rate("code_switch_cases_at_triggers", "total_analyzed_contexts")),
        "code_switch_rate_denominator": F.when(counted, "total_words").otherwise("total_contexts (video_word_count unavailable)"),
        "erosion_rate_all": rate("erosion_cases_all", "evaluable_non_code_switch_contexts"), "erosion_rate_high_confidence": rate("erosion_cases_high_confidence", "evaluable_non_code_switch_contexts"),
    }).drop("_switched")
