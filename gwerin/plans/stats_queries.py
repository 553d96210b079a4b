"""Statistics over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.operators import stats
from gwerin.plans.registry import query
from gwerin.session import table

USED = ["mutation_id", "rule", "expected_mutation", "status", "is_erosion", "is_high_confidence_erosion", "is_code_switch", "collision_flag", "tagger_agreement", "detection_source", "cysill_mutation_type", "cysill_pos", "spacy_pos", "spacy_mutation", "source", "channel_register", "register_class", "video_duration_seconds", "video_word_count", "video_codeswitch_word_count", "loaded_at"]


def facts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Delivered facts, each once; only the columns that a query needs travel."""
    keep = ["mutation_id", *[c for c in USED if c in cols and c != "mutation_id"]]
    return stats.prepare(_with(stats.dedup_facts(table(spark, sf_dir, "mutations"), keep)))


def _with(df: DataFrame) -> DataFrame:
    for c in ("is_code_switch", "tagger_agreement", "status"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


NULLS = ", ".join(f"'{x}'" for x in T.NULLS)
EVAL = ", ".join(f"'{x}'" for x in T.EVALUABLE)
AGREE = ", ".join(f"'{x}'" for x in T.AGREEING)
BASE = f"""
WITH k AS (SELECT min(mutation_id) AS id FROM mutations GROUP BY video_url, timestamp_span, trigger_word, following_word),
f AS (SELECT m.* REPLACE (CASE WHEN tagger_agreement IN ({NULLS}) THEN NULL WHEN lower(trim(tagger_agreement)) = 'true' THEN 'cysill+heuristic' WHEN lower(trim(tagger_agreement)) = 'false' THEN 'disputed' ELSE tagger_agreement END AS tagger_agreement),
  coalesce(is_code_switch, false) AS cs, status IN ({EVAL}) AS ev FROM mutations m JOIN k ON m.mutation_id = k.id)
"""
VIDEO = BASE + ", v AS (SELECT f.* FROM f JOIN (SELECT min(mutation_id) AS id FROM f WHERE video_url IS NOT NULL GROUP BY video_url) x ON f.mutation_id = x.id)\n"


@query(BASE + "SELECT mutation_id, video_url, timestamp_span, trigger_word, following_word, status, tagger_agreement FROM f")
def merge_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "status", "tagger_agreement").select("mutation_id", *stats.KEY, "status", "tagger_agreement")


@query(BASE + """SELECT channel_register, expected_mutation, count(is_erosion) AS contexts, sum(is_erosion::INT)::BIGINT AS erosion, round(avg(is_erosion::INT), 6) AS erosion_rate FROM f
WHERE NOT cs AND trigger_word <> '[OMITTED]' AND ev GROUP BY ALL HAVING count(is_erosion) >= 5""")
def erosion_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir, "channel_register", "expected_mutation", "status", "is_erosion", "is_code_switch")
    return stats.erosion_by(d, ["channel_register", "expected_mutation"], stats.not_switched() & (F.col("trigger_word") != "[OMITTED]") & stats.evaluable(), 5)


@query(BASE + """SELECT channel_register, rule, count(is_erosion) AS contexts, sum(is_erosion::INT)::BIGINT AS erosion, round(avg(is_erosion::INT), 6) AS erosion_rate FROM f
WHERE NOT cs AND rule <> 'phantom_check' AND ev GROUP BY ALL HAVING count(is_erosion) >= 5""")
def erosion_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir, "channel_register", "rule", "status", "is_erosion", "is_code_switch")
    return stats.erosion_by(d, ["channel_register", "rule"], stats.not_switched() & (F.col("rule") != "phantom_check") & stats.evaluable(), 5)


@query(BASE + """, g AS (SELECT source, expected_mutation AS t, count(is_erosion) AS n, sum(is_erosion::INT) AS e FROM f WHERE NOT cs AND trigger_word <> '[OMITTED]' AND ev GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY t) AS total FROM g)
SELECT source, """ + ", ".join(f"round(coalesce(sum(e) FILTER (t = '{k}') / sum(n) FILTER (t = '{k}'), 0), 6) AS {k.replace('-', '_')}" for k in ("soft", "nasal", "aspirate", "soft_limited", "h-mutation")) + " FROM h WHERE total >= 10 GROUP BY source")
def erosion_by_channel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.erosion_by_channel_type(facts(spark, sf_dir, "source", "expected_mutation", "status", "is_erosion", "is_code_switch"))


@query(VIDEO + """SELECT source, sum(video_word_count)::BIGINT AS words, sum(video_codeswitch_word_count)::BIGINT AS switched, round(sum(video_codeswitch_word_count) / sum(video_word_count), 6) AS switch_rate FROM v
GROUP BY source HAVING sum(video_word_count) > 0""")
def code_switch_rate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.switch_rate(facts(spark, sf_dir, "source", "video_word_count", "video_codeswitch_word_count"))


@query(VIDEO + """SELECT channel_register, count(*) AS videos, round(sum(coalesce(video_duration_seconds, 0) / 60), 4) AS minutes, grouping(channel_register)::INT AS all_registers FROM v GROUP BY ROLLUP (channel_register)""")
def video_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.video_minutes(facts(spark, sf_dir, "channel_register", "video_duration_seconds"))


@query(BASE + "SELECT source, count(*) AS n, " + ", ".join(f"round(sum((status = '{s}')::INT) * 100 / count(*), 6) AS {s}_pct" for s in ("correct_mutation", "erosion", "wrong_mutation_type")) + " FROM f WHERE status IN ('correct_mutation', 'erosion', 'wrong_mutation_type') GROUP BY source")
def status_distribution_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.status_shares(facts(spark, sf_dir, "source", "status"))


def _histogram(col: str) -> str:
    return BASE + f"SELECT {col} AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f WHERE {col} IS NOT NULL GROUP BY {col}"


@query(_histogram("tagger_agreement"))
def agreement_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(facts(spark, sf_dir, "tagger_agreement"), "tagger_agreement")


@query(_histogram("detection_source"))
def detection_source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(facts(spark, sf_dir, "detection_source"), "detection_source")


@query(_histogram("status"))
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(facts(spark, sf_dir, "status"), "status")


@query(_histogram("register_class"))
def register_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(facts(spark, sf_dir, "register_class"), "register_class")


@query(_histogram("source"))
def rows_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(facts(spark, sf_dir, "source"), "source")


@query(_histogram("video_url"))
def rows_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(facts(spark, sf_dir), "video_url")


@query(BASE + f"SELECT rule, count(*) AS n, round(avg((tagger_agreement IN ({AGREE}))::INT) * 100, 6) AS agreement_pct FROM f WHERE tagger_agreement IN ({AGREE}, 'disputed') GROUP BY rule")
def agreement_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.agreement_by_rule(facts(spark, sf_dir, "rule", "tagger_agreement"))


@query(BASE + """, b AS (SELECT channel_register, strftime(loaded_at, '%Y%m%d') AS batch, count(is_erosion) AS contexts, round(avg(is_erosion::INT), 6) AS erosion_rate FROM f WHERE NOT cs AND ev GROUP BY ALL)
SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY channel_register) >= 2""")
def erosion_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.over_batches(facts(spark, sf_dir, "channel_register", "loaded_at", "status", "is_erosion", "is_code_switch"))


@query(BASE + "SELECT following_word, count(*) AS n FROM f WHERE collision_flag <> '' GROUP BY following_word ORDER BY n DESC, following_word LIMIT 20")
def collision_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(facts(spark, sf_dir, "collision_flag"), "collision_flag", "following_word")


@query(BASE + """SELECT count(*) AS total, sum(cs::INT)::BIGINT AS code_switch, sum((NOT cs)::INT)::BIGINT AS own, sum((ev AND NOT cs)::INT)::BIGINT AS evaluable_n, sum((is_erosion AND ev AND NOT cs)::INT)::BIGINT AS erosion_n,
sum((is_high_confidence_erosion AND ev AND NOT cs)::INT)::BIGINT AS erosion_hc_n, coalesce(sum((collision_flag <> '')::INT), 0)::BIGINT AS collisions, round(sum((is_erosion AND ev AND NOT cs)::INT) / sum((ev AND NOT cs)::INT), 6) AS erosion_rate FROM f""")
def corpus_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.headline(facts(spark, sf_dir, "status", "is_erosion", "is_high_confidence_erosion", "is_code_switch", "collision_flag"))


RUN = "count(*) AS contexts, sum(is_erosion::INT)::BIGINT AS erosion_all, sum(is_high_confidence_erosion::INT)::BIGINT AS erosion_hc, round(sum(is_erosion::INT) / count(*), 6) AS rate_all, round(sum(is_high_confidence_erosion::INT) / count(*), 6) AS rate_hc, CASE WHEN count(*) < 10 THEN 'LOW N' ELSE '' END AS low_n_warning FROM f"


@query(BASE + f"SELECT expected_mutation, {RUN} WHERE NOT cs AND trigger_word <> '[OMITTED]' AND status <> 'erosion_unverified' GROUP BY expected_mutation")
def run_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir, "expected_mutation", "status", "is_erosion", "is_high_confidence_erosion", "is_code_switch")
    return stats.run_by(d, "expected_mutation", stats.not_switched() & (F.col("trigger_word") != "[OMITTED]") & (F.col("status") != "erosion_unverified"))


@query(BASE + f"SELECT rule, {RUN} WHERE NOT cs AND status <> 'erosion_unverified' GROUP BY rule")
def low_n_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir, "rule", "status", "is_erosion", "is_high_confidence_erosion", "is_code_switch")
    return stats.run_by(d, "rule", stats.not_switched() & (F.col("status") != "erosion_unverified"))


@query(BASE + """, c AS (SELECT source, CASE WHEN cysill_mutation_type IS NULL OR cysill_mutation_type IN ('', 'n/a', 'none') THEN 'none' ELSE cysill_mutation_type END AS a,
  CASE spacy_mutation WHEN 'SM' THEN 'soft' WHEN 'NM' THEN 'nasal' WHEN 'AM' THEN 'aspirate' ELSE 'none' END AS b FROM f WHERE ev AND cysill_pos NOT IN ('', 'none', 'n/a') AND spacy_pos NOT IN ('', 'none', 'n/a')),
t AS (SELECT source, count(*) AS n, avg((a = b)::INT) AS po FROM c GROUP BY source),
ra AS (SELECT source, a, count(*) AS n FROM c GROUP BY ALL), rb AS (SELECT source, b, count(*) AS n FROM c GROUP BY ALL)
SELECT t.source, t.n, round(CASE WHEN q.pe >= 1 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - q.pe) / (1 - q.pe) END, 6) AS kappa FROM t JOIN (
  SELECT t.source, coalesce(sum(x.p), 0) AS pe FROM t LEFT JOIN (SELECT ra.source, ra.n * rb.n / t.n / t.n AS p FROM ra JOIN rb ON ra.source = rb.source AND ra.a = rb.b JOIN t ON t.source = ra.source) x ON x.source = t.source GROUP BY t.source) q ON q.source = t.source""")
def cohens_kappa_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa(facts(spark, sf_dir, "source", "status", "cysill_mutation_type", "cysill_pos", "spacy_pos", "spacy_mutation"))


@query(BASE + "SELECT video_url, arg_min(video_duration_seconds, mutation_id) AS duration, count(*) AS contexts, round(avg(is_erosion::INT) FILTER (ev), 6) AS erosion_rate FROM f WHERE video_url IS NOT NULL GROUP BY video_url")
def per_video_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_video(facts(spark, sf_dir, "video_duration_seconds", "status", "is_erosion"))


@query(BASE + "SELECT expected_mutation, count(is_erosion) AS contexts, round(avg(is_erosion::INT), 6) AS rate_all, round(avg(is_erosion::INT) FILTER (NOT coalesce(tagger_agreement = 'disputed', false)), 6) AS rate_undisputed FROM f WHERE NOT cs AND ev GROUP BY expected_mutation")
def disputed_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sensitivity(facts(spark, sf_dir, "expected_mutation", "status", "is_erosion", "is_code_switch", "tagger_agreement"))


@query(BASE + "SELECT expected_mutation, count(*) AS n, sum(coalesce(is_erosion, false)::INT)::BIGINT AS erosion, round(sum(coalesce(is_erosion, false)::INT) / count(*), 6) AS erosion_rate FROM f WHERE NOT cs AND ev GROUP BY 1 HAVING count(*) >= 5")
def erosion_by_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.erosion_plain(facts(spark, sf_dir, "expected_mutation", "status", "is_erosion", "is_code_switch"), "expected_mutation", 5)


@query(BASE + "SELECT source, count(*) AS n, sum(coalesce(is_erosion, false)::INT)::BIGINT AS erosion, round(sum(coalesce(is_erosion, false)::INT) / count(*), 6) AS erosion_rate FROM f WHERE NOT cs AND ev GROUP BY 1")
def erosion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.erosion_plain(facts(spark, sf_dir, "source", "status", "is_erosion", "is_code_switch"), "source")


@query(BASE + "SELECT channel_register, count(*) AS n, sum(coalesce(is_erosion, false)::INT)::BIGINT AS erosion, round(sum(coalesce(is_erosion, false)::INT) / count(*), 6) AS erosion_rate FROM f WHERE NOT cs AND ev GROUP BY 1")
def erosion_by_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.erosion_plain(facts(spark, sf_dir, "channel_register", "status", "is_erosion", "is_code_switch"), "channel_register")


@query(VIDEO + """, t AS (SELECT coalesce(sum(video_word_count), 0)::BIGINT AS w, coalesce(sum(video_codeswitch_word_count), 0)::BIGINT AS s FROM v),
a AS (SELECT count(*) AS total_analyzed_contexts, sum(cs::INT)::BIGINT AS code_switch_cases_at_triggers, sum(ev::INT)::BIGINT AS evaluable_non_code_switch_contexts, sum((ev AND is_erosion)::INT)::BIGINT AS erosion_cases_all, sum((ev AND is_high_confidence_erosion)::INT)::BIGINT AS erosion_cases_high_confidence,
""" + ", ".join(f"sum((status = '{s}')::INT)::BIGINT AS {n}" for s, n in (("correct_mutation", "correct_mutation_cases"), ("wrong_mutation_type", "wrong_mutation_type_cases"), ("phantom_mutation", "phantom_omission_cases"), ("selective_invariancy", "selective_invariancy_cases"), ("erosion_unverified", "erosion_unverified_cases"))) + """, count(collision_flag) AS collision_flagged_cases FROM f)
SELECT a.*, t.w AS total_words, CASE WHEN t.w > 0 THEN t.s ELSE code_switch_cases_at_triggers END AS code_switch_words_total, round(CASE WHEN t.w > 0 THEN t.s / t.w ELSE code_switch_cases_at_triggers / total_analyzed_contexts END, 6) AS code_switch_rate,
CASE WHEN t.w > 0 THEN 'total_words' ELSE 'total_contexts (video_word_count unavailable)' END AS code_switch_rate_denominator, round(erosion_cases_all / evaluable_non_code_switch_contexts, 6) AS erosion_rate_all, round(erosion_cases_high_confidence / evaluable_non_code_switch_contexts, 6) AS erosion_rate_high_confidence FROM a, t""")
def research_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.research_summary(facts(spark, sf_dir, "status", "is_erosion", "is_high_confidence_erosion", "is_code_switch", "collision_flag", "video_word_count", "video_codeswitch_word_count"))
