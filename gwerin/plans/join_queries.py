"""Joins, alignment, rules, review and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.functions import text
from gwerin.operators import align, joins, lexicon_lines, review, rules, segments, stats, tokens
from gwerin.operators.carry import last_before
from gwerin.plans import files_queries  # noqa: F401 - it registers p7_found's SQL
from gwerin.plans.registry import SQL, query
from gwerin.plans.stats_queries import BASE, facts
from gwerin.plans.text_queries import CLUSTER, ENGLISH, LINES, case, lines, listed, sql_norm
from gwerin.session import table

CUES = "WITH c AS (SELECT min(caption_id) AS caption_id, video_url, segment_start, segment_end, segment_text FROM captions GROUP BY ALL)\n"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered cues, each once."""
    return table(spark, sf_dir, "captions").groupBy("video_url", "segment_start", "segment_end", "segment_text").agg(F.min("caption_id").alias("caption_id"))


@query("WITH RECURSIVE " + CUES[5:] + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_url ORDER BY segment_start, caption_id) AS i, (length(segment_text) % 7)::DOUBLE AS score FROM c WHERE video_url IS NOT NULL),
f AS (SELECT video_url, i, i AS li, caption_id AS lid, segment_start AS ls, segment_end AS le, coalesce(score, 0) AS lc FROM o WHERE i = 1 UNION ALL
SELECT o.video_url, o.i, CASE WHEN d.dup AND NOT coalesce(o.score, 0) > f.lc THEN f.li WHEN d.dup THEN f.li ELSE f.li + 1 END, CASE WHEN d.dup AND NOT coalesce(o.score, 0) > f.lc THEN f.lid ELSE o.caption_id END,
CASE WHEN d.dup AND NOT coalesce(o.score, 0) > f.lc THEN f.ls ELSE o.segment_start END, CASE WHEN d.dup AND NOT coalesce(o.score, 0) > f.lc THEN f.le ELSE o.segment_end END, CASE WHEN d.dup AND NOT coalesce(o.score, 0) > f.lc THEN f.lc ELSE coalesce(o.score, 0) END
FROM f JOIN o ON o.video_url = f.video_url AND o.i = f.i + 1, LATERAL (SELECT greatest(greatest(0, least(f.le, o.segment_end) - greatest(f.ls, o.segment_start)) / greatest(f.le - f.ls, 1e-6), greatest(0, least(f.le, o.segment_end) - greatest(f.ls, o.segment_start)) / greatest(o.segment_end - o.segment_start, 1e-6)) >= 0.8 AS dup) d)
SELECT video_url, arg_max(lid, i) AS caption_id FROM f GROUP BY video_url, li""")
def segment_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues(spark, sf_dir).withColumn("score", (F.length("segment_text") % 7).cast("double"))
    return segments.drop_overlaps(rows, "video_url", "segment_start", "segment_end", "caption_id", "score")


@query("SELECT segment_id, round(segment_start + 10, 3) AS segment_start, round(segment_end + 10, 3) AS segment_end FROM segments WHERE round(segment_start + 10, 3) >= 59.95 AND round(segment_end + 10, 3) <= 600.05")
def window_shift_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.shift_and_trim(table(spark, sf_dir, "segments").select("segment_id", "segment_start", "segment_end"), "segment_start", "segment_end", 10.0, 60.0, 600.0)


@query(CUES + ", l AS (SELECT *, lag(segment_text) OVER w AS p, row_number() OVER w AS i FROM c WHERE video_url IS NOT NULL WINDOW w AS (PARTITION BY video_url ORDER BY segment_start, caption_id)) SELECT caption_id FROM l WHERE i = 1 OR p IS DISTINCT FROM segment_text")
def consecutive_dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.collapse_repeats(cues(spark, sf_dir), "video_url", ["segment_start", "caption_id"], "segment_text", F.floor(F.col("segment_start") / 300)).select("caption_id")


@query(CUES + """, b AS (SELECT *, max(segment_end) OVER (PARTITION BY video_url ORDER BY segment_start, caption_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE video_url IS NOT NULL),
i AS (SELECT *, sum((before IS NULL OR before <= segment_start)::INT) OVER (PARTITION BY video_url ORDER BY segment_start, caption_id) AS g FROM b)
SELECT video_url, arg_min(caption_id, (segment_start, caption_id)) AS island, count(*) AS cues, round(max(segment_end) - min(segment_start), 3) AS seconds FROM i GROUP BY video_url, g""")
def gaps_islands_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.islands(cues(spark, sf_dir).where("video_url is not null"), "video_url", "segment_start", "segment_end", "caption_id")
    return out.groupBy("video_url", "island").agg(F.count("*").alias("cues"), F.round(F.max("segment_end") - F.min("segment_start"), 3).alias("seconds"))


ENTRIES = SQL["p7_found"].partition("SELECT line_no, reason FROM r WHERE")[0].replace("r AS (SELECT line_no, CASE", "r AS (SELECT line_no, f, CASE") + """, x AS (SELECT f[1] AS wordform, lower(f[2]) AS l, f[3] AS tag, f[4] AS morph FROM r WHERE reason IS NULL),
g AS (SELECT wordform, count(*) AS n, CASE WHEN min(l) = max(l) THEN min(l) END AS lemma, CASE WHEN count(*) = 1 THEN min(tag) END AS tag, CASE WHEN count(*) = 1 THEN min(morph) END AS morph FROM x GROUP BY wordform)
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every valid line, quoted fields included."""
    return joins.lexicon(lexicon_lines.parse_lines(table(spark, sf_dir, "lexicon_lines").select("line")).where("reason is null"))


@query(ENTRIES + "SELECT wordform, n, lemma, tag FROM g")
def lexicon_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("wordform", "n", "lemma", "tag")


@query(ENTRIES + """, w AS (SELECT DISTINCT lower(wordform) AS w FROM g)
SELECT w, coalesce(a.wordform, b.wordform) AS form, CASE WHEN a.wordform IS NOT NULL THEN a.lemma ELSE b.lemma END AS lemma, CASE WHEN a.wordform IS NOT NULL THEN a.tag ELSE b.tag END AS tag FROM w LEFT JOIN g a ON a.wordform = w LEFT JOIN g b ON b.wordform = upper(w[1]) || w[2:]""")
def case_recovery_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = entries(spark, sf_dir)
    return joins.look_up(lex.select(F.lower("wordform").alias("w0")).distinct(), "w0", lex).select(F.col("w0").alias("w"), "form", "lemma", "tag")


def _feature(name: str, values: dict[str, str]) -> str:
    return case(values, f"regexp_extract(coalesce(morph, ''), '(?:^|\\|){name}=([^|]*)', 1)")


@query(ENTRIES + f"SELECT wordform, {_feature('Mutation', T.LEXICON_TYPES)} AS mutation_type, {_feature('Gender', T.LEXICON_GENDERS)} AS gender, {_feature('Number', T.LEXICON_NUMBERS)} AS number FROM g WHERE n = 1")
def lexicon_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lexicon says in the tagger's stead of wordforms with a single reading."""
    return joins.resolved(entries(spark, sf_dir)).where("n = 1").select("wordform", "mutation_type", "gender", "number")


@query(ENTRIES + f""", w AS (SELECT DISTINCT {sql_norm('word')} AS n FROM words), c AS (SELECT lower(following_word) AS n, min(lemma) AS lemma FROM mutations WHERE lemma IS NOT NULL GROUP BY 1)
SELECT w.n, CASE WHEN w.n IN ({listed(T.SUPPLETIVE)}) THEN w.n WHEN w.n IN ({listed(ENGLISH)}) THEN NULL ELSE coalesce(c.lemma, CASE WHEN a.wordform IS NOT NULL THEN a.lemma ELSE b.lemma END, w.n) END AS lemma
FROM w LEFT JOIN c ON c.n = w.n LEFT JOIN g a ON a.wordform = w.n LEFT JOIN g b ON b.wordform = upper(w.n[1]) || w.n[2:] WHERE w.n <> ''""")
def lemma_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answer of: suppletive list, none for English, earlier lemmas, the lexicon if its readings agree, the word itself."""
    known = table(spark, sf_dir, "mutations").where("lemma is not null").groupBy(F.lower("following_word").alias("n")).agg(F.min("lemma").alias("known"))
    words = table(spark, sf_dir, "words").select(text.normalize_word(F.col("word")).alias("n")).where("n <> ''").distinct()
    asked = joins.look_up(words, "n", entries(spark, sf_dir)).select("n", F.col("lemma").alias("listed"))
    lemma = F.when(F.col("n").isin(T.SUPPLETIVE), F.col("n")).when(text.is_english(F.col("n")), None).otherwise(F.coalesce("known", "listed", "n"))
    return asked.join(known, "n", "left").select("n", lemma.alias("lemma"))


@query(ENTRIES + ", pk AS (" + SQL["greedy_chunk_budget"] + f"), t AS (SELECT segment_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS raw FROM (SELECT segment_id, string_split_regex(trim(coalesce(segment_text, ''), chr(32) || chr(10) || chr(9) || chr(13)), '[ \\n\\t\\r]+') AS a FROM segments)), u AS (SELECT pk.segment_id, chunk, {sql_norm('raw')} AS w FROM pk JOIN t ON t.segment_id = pk.segment_id AND t.pos = pk.pos) SELECT segment_id, chunk, count(*) AS words, bool_and(w IN ({listed(ENGLISH)}) OR w IN (SELECT wordform FROM g WHERE n = 1)) AS resolved FROM u GROUP BY ALL")
def chunk_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each segment, and whether the lexicon answers for all words of it."""
    said = lines(spark, sf_dir)
    packed = tokens.pack(said, ["segment_id"], "pos", "word", budget=30)
    words = said.join(packed, ["segment_id", "pos"])
    return tokens.local_chunks(words, ["segment_id"], "word", entries(spark, sf_dir).where("n = 1").select(F.col("wordform").alias("n")))


@query(BASE + f""", a AS (SELECT mutation_id, video_url, lower(following_word) AS n, try_cast(regexp_extract(timestamp_span, '-\\s*([\\d.]+)s', 1) AS DOUBLE) AS t1 FROM f),
w AS (SELECT word_id, video_url, {sql_norm('word')} AS n, word_end FROM words WHERE word_end IS NOT NULL)
SELECT mutation_id, (SELECT arg_min(w.word_id, (round(w.word_end * 1000000), w.word_id)) FROM w WHERE w.video_url = a.video_url AND w.n = a.n AND abs(round(w.word_end * 1000000) - round(a.t1 * 1000000)) <= 50000) AS word_id FROM a""")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact with the spoken word that ends within 0.05 s of it and reads the same."""
    left = facts(spark, sf_dir).select("mutation_id", "video_url", F.lower("following_word").alias("n"), text.parse_span(F.col("timestamp_span"))[1].alias("t1"))
    right = table(spark, sf_dir, "words").select("word_id", "video_url", text.normalize_word(F.col("word")).alias("n"), "word_end")
    return joins.tolerance_join(left, right, ["video_url", "n"], "t1", "word_end", "word_id", 0.05).select("mutation_id", "word_id")


@query(BASE + """, a AS (SELECT mutation_id, video_url, try_cast(regexp_extract(timestamp_span, '([\\d.]+)s', 1) AS DOUBLE) AS t0, try_cast(regexp_extract(timestamp_span, '-\\s*([\\d.]+)s', 1) AS DOUBLE) AS t1 FROM f)
SELECT mutation_id, arg_min(segment_id, (segment_start, segment_id)) AS first_span, count(*) AS spans FROM a JOIN segments s ON s.video_url = a.video_url AND s.segment_start <= a.t1 AND s.segment_end >= a.t0 GROUP BY mutation_id""")
def interval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t0, t1 = text.parse_span(F.col("timestamp_span"))
    left = facts(spark, sf_dir).select("mutation_id", "video_url", t0.alias("t0"), t1.alias("t1"))
    spans = table(spark, sf_dir, "segments").select("video_url", F.col("segment_id").alias("span_id"), F.col("segment_start").alias("s0"), F.col("segment_end").alias("s1"))
    return joins.overlap_join(left, spans, "video_url", "mutation_id")


@query("""WITH u AS (SELECT transcript_id, line_no, arg_min(utt_end, utterance_id) AS e FROM (SELECT * REPLACE (coalesce(utt_end, -1) AS utt_end) FROM chat_utterances) GROUP BY ALL)
SELECT transcript_id, line_no, last_value(nullif(e, -1) IGNORE NULLS) OVER (PARTITION BY transcript_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u""")
def carry_forward_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known end before each line."""
    u = table(spark, sf_dir, "chat_utterances").groupBy("transcript_id", "line_no").agg(F.min_by(F.struct("utt_end"), "utterance_id").alias("u")).withColumn("e", F.col("u.utt_end"))
    u = u.withColumn("b", F.floor(F.col("line_no") / 2000))
    return last_before(u, ["transcript_id"], "b", ["line_no"], "e", "before").select("transcript_id", "line_no", "before")


@query(LINES + "SELECT segment_id, pos, string_agg(word, ' ') OVER (PARTITION BY segment_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS context FROM w")
def context_window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    near = Window.partitionBy("segment_id").orderBy("pos").rowsBetween(-6, 6)
    return lines(spark, sf_dir).select("segment_id", "pos", F.array_join(F.collect_list("word").over(near), " ").alias("context"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Delivered words, and what the captions have for each of their tokens."""
    words = table(spark, sf_dir, "words").groupBy("video_url", "word_start", "word_end").agg(F.min_by(F.struct("word_id", "word"), "word_id").alias("w")).select("video_url", "word_start", "word_end", "w.*")
    return words, align.align_streams(align.stream(words, "video_url", "word_start", "word", ["word_id"], "word_end"), align.stream(cues(spark, sf_dir), "video_url", "segment_start", "segment_text", ["caption_id"]))


@query()
def align_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)[1]


@query()
def stream_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level agreement of speech and captions, by video."""
    return align.agreement(_evidence(spark, sf_dir)[1], ["video_url"])


@query()
def gap_tolerant_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "segments").groupBy("video_url", "segment_start").agg(F.min("segment_id").alias("segment_id"))
    words = rules.enrich(table(spark, sf_dir, "words")).join(seg, ["video_url", "segment_start"]).select("segment_id", F.col("i").cast("bigint").alias("i"), F.col("w").alias("word"))
    toks = lines(spark, sf_dir).select("segment_id", F.col("pos").cast("bigint").alias("i"), text.normalize_word(F.col("word")).alias("word")).where("word <> ''")
    return align.align_with_gaps(words, toks)


@query()
def corroborated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact with what the captions say of it."""
    facts = stats.dedup_facts(table(spark, sf_dir, "mutations"), ["mutation_id", "lemma", "mutation_found"])
    words, evidence = _evidence(spark, sf_dir)
    return align.corroborate(facts, words, evidence).select("mutation_id", "word_id", "caption_word", "caption_tag", "match_confidence", "verdict", "flagged")


@query()
def corroboration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of verdicts and match confidence, over all facts."""
    return corroborated_facts(spark, sf_dir).groupBy("verdict", "match_confidence").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))


COLS = ["status", "confidence_score"]
SIDES = BASE + """, o AS (SELECT video_url, timestamp_span, trigger_word, following_word, coalesce(manual_reviewed, false) AS rev, status, confidence_score FROM f WHERE trigger_word <> 'am'),
n AS (SELECT video_url, timestamp_span, trigger_word, following_word, CASE WHEN status = 'erosion' THEN 'correct_mutation' ELSE status END AS status, confidence_score FROM f WHERE trigger_word <> 'dy'),
j AS (SELECT coalesce(o.video_url, n.video_url) AS video_url, coalesce(o.timestamp_span, n.timestamp_span) AS timestamp_span, coalesce(o.trigger_word, n.trigger_word) AS trigger_word, coalesce(o.following_word, n.following_word) AS following_word,
o.rev, o.status AS os, n.status AS ns, o.confidence_score AS oc, n.confidence_score AS nc, o.trigger_word IS NOT NULL AS ho, n.trigger_word IS NOT NULL AS hn
FROM o FULL JOIN n ON o.video_url IS NOT DISTINCT FROM n.video_url AND o.timestamp_span IS NOT DISTINCT FROM n.timestamp_span AND o.trigger_word IS NOT DISTINCT FROM n.trigger_word AND o.following_word IS NOT DISTINCT FROM n.following_word)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The facts before and after a made-up change of rules: one trigger new, one gone, one status read otherwise."""
    d = stats.dedup_facts(table(spark, sf_dir, "mutations"), ["mutation_id", "manual_reviewed", *COLS])
    return d.where("trigger_word <> 'am'"), d.where("trigger_word <> 'dy'").withColumn("status", F.when(F.col("status") == "erosion", "correct_mutation").otherwise(F.col("status")))


@query(SIDES + "SELECT video_url, timestamp_span, trigger_word, following_word, CASE WHEN NOT ho THEN 'added' WHEN NOT hn THEN 'removed' WHEN os IS NOT DISTINCT FROM ns AND oc IS NOT DISTINCT FROM nc THEN 'same' WHEN rev THEN 'protected' ELSE 'changed' END AS class FROM j")
def keyed_diff_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.diff_classes(*_sides(spark, sf_dir), stats.KEY, COLS, "manual_reviewed")


@query(SIDES + "SELECT video_url, timestamp_span, trigger_word, following_word, CASE WHEN ho AND (NOT hn OR rev) THEN os ELSE ns END AS status, CASE WHEN ho AND (NOT hn OR rev) THEN oc ELSE nc END AS confidence_score FROM j")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert(*_sides(spark, sf_dir), stats.KEY, COLS, "manual_reviewed")


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_queue(stats.dedup_facts(table(spark, sf_dir, "mutations"), ["mutation_id", "manual_reviewed", "status", "rule"]))


@query(BASE + "SELECT mutation_id, trigger_word, rule, status FROM f WHERE status IN ('erosion', 'wrong_mutation_type') AND NOT coalesce(manual_reviewed, false)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir).select("mutation_id", "trigger_word", "rule", "status")


@query(BASE + "SELECT trigger_word, rule, status, count(*) AS n, grouping(trigger_word, rule, status)::INT AS set_id FROM f WHERE status IN ('erosion', 'wrong_mutation_type') AND NOT coalesce(manual_reviewed, false) GROUP BY GROUPING SETS ((trigger_word), (rule), (status))")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_summary(_review(spark, sf_dir))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS original, arg_max(event_type, (ts, event_id)) AS current, count(*) AS review_count FROM events GROUP BY user_id")
def review_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.log_fold(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, sum((event_type = 'error')::INT)::BIGINT AS attempts, sum((event_type = 'view')::INT)::BIGINT AS deferrals, CASE WHEN max((event_type NOT IN ('error', 'view'))::INT) = 1 THEN 'done' WHEN sum((event_type = 'error')::INT) >= 3 THEN 'given_up' ELSE 'retry' END AS state FROM events GROUP BY user_id")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.retry_state(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "view")


@query(BASE + "SELECT mutation_id FROM f WHERE contains(lower(concat_ws(' ', trigger_word, following_word, note)), 'gwirio') ORDER BY mutation_id LIMIT 20")
def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.dedup_facts(table(spark, sf_dir, "mutations"), ["mutation_id", "note"])
    return review.search(d, ["trigger_word", "following_word", "note"], "gwirio", "mutation_id").select("mutation_id")


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.seeded_sample(table(spark, sf_dir, "mutations").select("mutation_id", "status"), "mutation_id", 50, seed=7)


@query("SELECT video_url, min(word_id) AS word_id FROM words WHERE video_url IS NOT NULL AND video_url NOT IN (SELECT video_url FROM captions WHERE video_url IS NOT NULL) GROUP BY video_url")
def anti_queue_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.undiscovered(table(spark, sf_dir, "words").select("video_url", "word_id"), [table(spark, sf_dir, "captions")], "video_url", "word_id")


@query("SELECT DISTINCT video_url FROM segments s WHERE NOT EXISTS (SELECT 1 FROM mutations m WHERE m.video_url = s.video_url)")
def orphan_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").select("video_url").distinct().join(table(spark, sf_dir, "mutations").select("video_url").distinct(), "video_url", "left_anti")


@query("SELECT caption_kind, language, count(*) AS n FROM (SELECT caption_kind, NULL AS language FROM captions UNION ALL SELECT NULL, language FROM segments) GROUP BY ALL")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "captions").select("video_url", "caption_kind").unionByName(table(spark, sf_dir, "segments").select("video_url", "language"), allowMissingColumns=True)
    return both.groupBy("caption_kind", "language").agg(F.count("*").alias("n"))


@query(BASE + "SELECT count(*) AS n, count(*) FILTER (strftime(loaded_at, '%Y%m%d') NOT IN ('20250101')) AS kept FROM f")
def batch_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir, "loaded_at")
    return d.agg(F.count("*").alias("n"), F.count(F.when(~F.date_format("loaded_at", "yyyyMMdd").isin("20250101"), 1)).alias("kept"))


@query(BASE + """, x AS (SELECT *, nullif(nullif(mutation_found, 'none'), 'n/a') AS surf, string_split(expected_mutation, '|') AS want, CASE spacy_mutation WHEN 'SM' THEN 'soft' WHEN 'NM' THEN 'nasal' WHEN 'AM' THEN 'aspirate' END AS b, nullif(nullif(cysill_mutation_type, 'n/a'), 'none') AS a, NOT coalesce(locally_resolved, false) AS gen FROM f),
y AS (SELECT *, coalesce(b = surf OR list_contains(want, b), false) AS pc, gen AND coalesce(a = surf OR list_contains(want, a), false) AS cc, surf IS NOT NULL AS heard, coalesce(spacy_dep IN ('obj', 'iobj', 'nsubj', 'obl', 'vocative', 'amod', 'nmod', 'xcomp'), false) AS ctx, gen AND a IS NULL AS rad, surf IS NULL AND expected_mutation IS NOT NULL AS hf,
CASE WHEN gen THEN a IS NOT DISTINCT FROM surf ELSE NULL END AS ca, CASE WHEN spacy_pos IS NOT NULL THEN b IS NOT DISTINCT FROM surf END AS pa FROM x)
SELECT mutation_id, CASE WHEN is_erosion THEN CASE WHEN ctx AND rad AND hf THEN 0.9 WHEN rad AND hf THEN 0.75 WHEN hf THEN 0.5 ELSE 0.1 END ELSE CASE WHEN pc AND cc AND heard THEN 1.0 WHEN pc AND cc THEN 0.95 WHEN pc AND heard THEN 0.8 WHEN cc AND heard THEN 0.65 WHEN pc THEN 0.7 WHEN cc THEN 0.5 ELSE 0.3 END END::DOUBLE AS score,
CASE WHEN is_erosion THEN CASE WHEN ctx AND rad AND hf THEN 'all_three' WHEN rad AND hf THEN 'cysill+heuristic' WHEN hf THEN 'heuristic_only' ELSE 'disputed' END ELSE CASE WHEN pc AND cc AND heard THEN 'all_three' WHEN pc AND cc THEN 'parser+cysill' WHEN pc AND heard THEN 'parser+heuristic' WHEN cc AND heard THEN 'cysill+heuristic' WHEN pc THEN 'parser_only' WHEN cc THEN 'cysill_only' ELSE 'heuristic_only' END END AS score_source,
CASE WHEN ca AND pa THEN 'all_three' WHEN ca THEN 'cysill+heuristic' WHEN pa THEN 'parser+heuristic' WHEN ca IS NULL AND pa IS NULL THEN 'heuristic_only' ELSE 'disputed' END AS agreement FROM y""")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.confidence(stats.dedup_facts(table(spark, sf_dir, "mutations"), ["mutation_id", "mutation_found", "expected_mutation", "spacy_mutation", "cysill_mutation_type", "locally_resolved", "spacy_dep", "spacy_pos", "is_erosion"]))


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gwerin.streaming.incremental import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query(f"WITH s AS (SELECT segment_id, video_url, segment_start, segment_text FROM segments WHERE video_url IS NOT NULL), l AS (SELECT *, lag(segment_text) OVER w IS DISTINCT FROM segment_text AS c, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY video_url ORDER BY segment_start, segment_id)) SELECT segment_id, sum((c AND i > 1)::INT) OVER (PARTITION BY video_url ORDER BY segment_start, segment_id)::BIGINT AS run FROM l")
def equal_text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the number of their group of adjacent equal texts."""
    rows = table(spark, sf_dir, "segments").select("segment_id", "video_url", "segment_start", "segment_text")
    return segments.equal_runs(rows, "video_url", ["segment_start", "segment_id"], "segment_text", F.floor(F.col("segment_start") / 300)).select("segment_id", "run")


@query(BASE + """, a AS (SELECT mutation_id, video_url, try_cast(regexp_extract(timestamp_span, '([\\d.]+)s', 1) AS DOUBLE) AS t0, try_cast(regexp_extract(timestamp_span, '-\\s*([\\d.]+)s', 1) AS DOUBLE) AS t1 FROM f),
h AS (SELECT mutation_id, arg_min(segment_id, (segment_start, segment_id)) AS segment_id FROM a JOIN segments s ON s.video_url = a.video_url AND s.segment_start <= a.t1 AND s.segment_end >= a.t0 GROUP BY mutation_id),
o AS (SELECT segment_id, video_url, row_number() OVER (PARTITION BY video_url ORDER BY segment_start, segment_id) AS i FROM segments WHERE video_url IS NOT NULL)
SELECT h.mutation_id, n.segment_id, (n.i - o.i)::INT AS "offset" FROM h JOIN o USING (segment_id) JOIN o n ON n.video_url = o.video_url AND n.i BETWEEN o.i - 2 AND o.i + 2""")
def context_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of each fact with two before and two behind it."""
    hits = interval_context(spark, sf_dir).select("mutation_id", F.col("first_span").alias("segment_id"))
    rows = table(spark, sf_dir, "segments").select("video_url", "segment_id", "segment_start")
    return segments.around(hits, rows, "video_url", "mutation_id", ["segment_start"], "segment_id", 2, F.floor(F.col("segment_start") / 300))


@query(BASE + ", q AS (SELECT mutation_id, video_url FROM f WHERE status IN ('erosion', 'wrong_mutation_type') AND NOT coalesce(manual_reviewed, false)) SELECT mutation_id, row_number() OVER (PARTITION BY video_url ORDER BY mutation_id)::INT AS place, count(*) OVER (PARTITION BY video_url) AS \"of\" FROM q")
def review_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each fact in the review queue of its video."""
    return review.positions(_review(spark, sf_dir).select("mutation_id", "video_url"), "video_url", ["mutation_id"]).select("mutation_id", "place", "of")


@query(f"WITH w AS (SELECT video_url, {sql_norm('word')} AS n FROM words WHERE video_url IS NOT NULL) SELECT video_url, count(*) AS words, sum((n IN ({listed(ENGLISH)}))::INT)::BIGINT AS switched FROM w WHERE n <> '' GROUP BY video_url")
def video_word_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normalize_word(F.col("word"))
    return stats.word_counters(table(spark, sf_dir, "words"), "video_url", n, text.is_english(n))


@query(f"SELECT following_word, lemma, CASE WHEN w = {{0}} THEN 'aspirate' WHEN w = {{1}} THEN 'nasal' WHEN w = {{2}} THEN 'soft' WHEN w = l THEN 'radical' END AS change FROM (SELECT DISTINCT following_word, lemma, {sql_norm('following_word')} AS w, {sql_norm('lemma')} AS l FROM mutations WHERE lemma IS NOT NULL AND following_word IS NOT NULL)".format(*[case(T.FORWARD[k], CLUSTER.format(w="l")) + f" || l[length({CLUSTER.format(w='l')}) + 1:]" for k in ("aspirate", "nasal", "soft")]))
def changes_of_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which change of its beginning makes each word of its lemma."""
    pairs = table(spark, sf_dir, "mutations").where("lemma is not null and following_word is not null").select("following_word", "lemma").distinct()
    return pairs.select("following_word", "lemma", text.change_of(text.normalize_word(F.col("following_word")), text.normalize_word(F.col("lemma"))).alias("change"))
