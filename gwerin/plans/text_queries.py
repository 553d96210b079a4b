"""Words, tokens and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.functions import text
from gwerin.operators import tokens
from gwerin.plans.registry import query
from gwerin.sources import readers
from gwerin.session import table


def case(values: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_norm(col: str) -> str:
    return f"""replace(replace(trim(nfc_normalize(lower(translate(coalesce({col}, ''), '“”‘’', '""'''''))), '.,!?;:''"()[]'), '''r', ''), '''n', 'yn')"""


CLUSTER = "regexp_extract({w}, '^(" + "|".join(T.CLUSTERS) + "|.)', 1)"
WORDS = f"WITH w AS (SELECT word_id, video_url, segment_start, word, {sql_norm('word')} AS n FROM words), d AS (SELECT n, count(*) AS c FROM w WHERE n <> '' GROUP BY n)\n"
LINES = """WITH t AS (SELECT segment_id, string_split_regex(trim(coalesce(segment_text, ''), chr(32) || chr(10) || chr(9) || chr(13)), '[ \\n\\t\\r]+') AS a FROM segments),
r AS (SELECT segment_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS raw FROM t),
w AS (SELECT segment_id, pos, raw, trim(raw, '.,!?;:"()[]') AS word, regexp_matches(raw, '[,;:.]$') AS boundary FROM r WHERE trim(raw, '.,!?;:"()[]') <> '')
"""


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, c): distinct normalised words with their counts, so that word functions run once a word."""
    return table(spark, sf_dir, "words").select(text.normalize_word(F.col("word")).alias("n")).where("n <> ''").groupBy("n").agg(F.count("*").alias("c"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.words_of(table(spark, sf_dir, "segments"), ["segment_id"], "segment_text")


@query(f"SELECT word_id, {sql_norm('word')} AS n FROM words")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "words").select("word_id", text.normalize_word(F.col("word")).alias("n"))


@query(WORDS + f"SELECT {CLUSTER.format(w='n')} AS cluster, sum(c)::BIGINT AS tokens, count(*) AS types FROM d GROUP BY 1")
def initial_cluster_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).groupBy(text.initial_cluster(F.col("n")).alias("cluster")).agg(F.sum("c").alias("tokens"), F.count("*").alias("types"))


@query(WORDS + f"SELECT {case(T.SURFACE_TYPE, CLUSTER.format(w='n'))} AS surface, sum(c)::BIGINT AS tokens FROM d GROUP BY 1")
def surface_mutation_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).groupBy(text.surface_type(F.col("n")).alias("surface")).agg(F.sum("c").alias("tokens"))


COLLAPSED = "regexp_replace(n, '" + "|".join(sorted(T.SINGLE_CLUSTERS, key=len, reverse=True)) + "', 'V', 'g')"


@query(WORDS + f"""SELECT n, c FROM d WHERE len(list_filter(regexp_extract_all(n, '.'), lambda x: (unicode(x) BETWEEN 192 AND 591 AND NOT contains('{T.LEGAL_MARKED}', x)))) > 0 OR regexp_matches(n, '\\p{{M}}')
OR regexp_matches(n, '{"|".join(T.IMPOSSIBLE_PAIRS)}') OR regexp_matches({COLLAPSED}, '[^{T.VOWELS}V]{{4,}}')""")
def implausible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).where(~(text.plausible_letters(F.col("n")) & text.plausible_word(F.col("n"))))


def sql_forward(kind: str, w: str = "n") -> str:
    rows = sorted(T.FORWARD[kind].items(), key=lambda x: (-len(x[0]), x[0]))
    return "nullif(CASE " + " ".join(f"WHEN starts_with({w}, '{a}') THEN '{b}' || {w}[{len(a) + 1}:]" for a, b in rows) + " END, '')"


@query(WORDS + "SELECT n, " + ", ".join(f"{sql_forward(k)} AS {k}" for k in ("soft", "nasal", "aspirate")) + " FROM d")
def forward_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).select("n", *[text.forward_form(F.col("n"), k).alias(k) for k in ("soft", "nasal", "aspirate")])


REVERSE = " UNION ALL ".join(
    f"SELECT n, '{a}' || n AS radical FROM d WHERE regexp_matches(n, '^[{T.VOWELS}]')" if b == "" else f"SELECT n, '{a}' || n[{len(b) + 1}:] AS radical FROM d WHERE {CLUSTER.format(w='n')} = '{b}'"
    for k in ("soft", "nasal", "aspirate", "colloquial_affricate") for a, b in T.FORWARD[k].items()
)


@query(WORDS + f"SELECT DISTINCT n, radical FROM ({REVERSE}) WHERE n <> radical")
def reverse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).select("n", F.explode(text.reverse_candidates(F.col("n"))).alias("radical"))


@query(LINES + """, x AS (SELECT *, lower(translate(word, '‘’', '''''')) AS lw FROM w),
y AS (SELECT segment_id, pos, CASE WHEN lw = '''n' THEN ['yn'] WHEN ends_with(lw, '''n') AND length(lw) > 2 THEN [word[1:length(word) - 2], 'yn'] """ + " ".join(f"WHEN lw = '{k.replace(chr(39), chr(39) * 2)}' THEN [{listed(v)}]" for k, v in T.CONTRACTIONS.items()) + " ELSE [word] END AS parts, lw IN (" + listed(list(T.CONTRACTIONS)) + """) AS cut FROM x)
SELECT segment_id, pos, (i - 1)::INT AS part_no, parts[i] AS part, cut AND i = 2 AS synthetic FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM y)""")
def contraction_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.expand_clitics(lines(spark, sf_dir)).select("segment_id", "pos", "part_no", "part", "synthetic")


@query(LINES + "SELECT segment_id, count(*) AS words, sum(boundary::INT)::BIGINT AS boundaries FROM w GROUP BY segment_id")
def clause_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("words"), F.sum(F.col("boundary").cast("int")).alias("boundaries"))


@query(LINES + f""", n AS (SELECT segment_id, {sql_norm('word')} AS n FROM w), c AS (SELECT segment_id, n, count(*) AS c FROM n WHERE n <> '' GROUP BY ALL),
s AS (SELECT segment_id, sum(c)::BIGINT AS n, max(c) AS most FROM c GROUP BY segment_id) SELECT segment_id, n, most FROM s WHERE n >= 3 AND most / n > 0.4""")
def repeat_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.hallucinated(lines(spark, sf_dir), ["segment_id"]).where("reason = 'repeats'").select("segment_id", "n", "most")


@query("""WITH RECURSIVE """ + LINES[5:] + """, o AS (SELECT *, length(word) + 1 AS size, row_number() OVER (PARTITION BY segment_id ORDER BY pos) AS i FROM w),
f AS (SELECT segment_id, pos, i, size AS total, 0 AS chunk FROM o WHERE i = 1 UNION ALL
SELECT o.segment_id, o.pos, o.i, CASE WHEN f.total + o.size > 30 THEN o.size ELSE f.total + o.size END, f.chunk + (f.total + o.size > 30)::INT FROM f JOIN o ON o.segment_id = f.segment_id AND o.i = f.i + 1)
SELECT segment_id, pos::BIGINT AS pos, chunk FROM f""")
def greedy_chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(lines(spark, sf_dir), ["segment_id"], "pos", "word", budget=30)


@query(LINES + "SELECT segment_id, sha256(string_agg(word, chr(0) ORDER BY pos) || chr(0)) AS fingerprint FROM w GROUP BY segment_id")
def fingerprint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.fingerprint(lines(spark, sf_dir), ["segment_id"], "pos", "word")


TRIG = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T.TRIGGERS.items()) + ") AS trig(trigger_word, expected)"
ENGLISH = [w for w in T.ENGLISH_FUNCTION_WORDS if w not in T.HOMOGRAPHS]


@query(LINES + f""", n AS (SELECT segment_id, pos, {sql_norm('word')} AS n FROM w), m AS (SELECT * FROM n WHERE length(n) >= 2),
l AS (SELECT segment_id, pos, n, lead(n, 1) OVER o AS n1, lead(n, 2) OVER o AS n2, lead(n, 3) OVER o AS n3 FROM m WINDOW o AS (PARTITION BY segment_id ORDER BY pos)),
tt AS (SELECT *, CASE """ + " ".join(f"WHEN n{k} IS NOT NULL AND n{k} NOT IN ({listed(T.FILLERS)}) AND n{k} <> n THEN n{k}" for k in (1, 2, 3)) + f""" END AS target FROM l),
s AS (SELECT tt.*, trig.expected, {case(T.SURFACE_TYPE, CLUSTER.format(w='target'))} AS surface FROM tt JOIN {TRIG} ON trig.trigger_word = tt.n WHERE target IS NOT NULL)
SELECT n AS trigger_word, CASE WHEN target IN ({listed(ENGLISH)}) THEN 'code_switch' WHEN surface IS NULL THEN 'absent' WHEN list_contains(string_split(replace(expected, 'soft_limited', 'soft'), '|'), surface) THEN 'correct' ELSE 'other' END AS outcome, count(*) AS n FROM s GROUP BY 1, 2""")
def flagship_trigger_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger words, their target among the next three words, and what its beginning looks like."""
    words = lines(spark, sf_dir).select("segment_id", "pos", text.normalize_word(F.col("word")).alias("w")).where("length(w) >= 2")
    hits = tokens.lookahead(words, ["segment_id"], ["pos"], "w").where(F.col("w").isin(list(T.TRIGGERS)) & F.col("target").isNotNull())
    expected = F.split(F.replace(F.try_element_at(text.literal_map(T.TRIGGERS), F.col("w")), F.lit("soft_limited"), F.lit("soft")), r"\|")
    hits = hits.select("w", "target", expected.alias("expected"), text.surface_type(F.col("target")).alias("surface"))
    outcome = F.when(text.is_english(F.col("target")), "code_switch").when(F.col("surface").isNull(), "absent").when(F.expr("array_contains(expected, surface)"), "correct").otherwise("other")
    return hits.groupBy(F.col("w").alias("trigger_word"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT video_url, slug, count(*) AS n FROM (SELECT video_url, coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(video_title, ''), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s-]', '', 'g'), '\\s+', '_', 'g'), '_')[1:60], ''), 'untitled') AS slug FROM segments) GROUP BY ALL")
def video_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").select("video_url", text.slug(F.col("video_title")).alias("slug")).groupBy("video_url", "slug").agg(F.count("*").alias("n"))


POS = """WITH p AS (SELECT cysill_pos, count(*) AS n FROM words GROUP BY 1), e AS (SELECT cysill_pos, n, list_sort(list_distinct(list_transform(string_split_regex(cysill_pos, '[+|]'), lambda x: CASE WHEN starts_with(x, 'PREP') OR starts_with(x, 'CPREP') THEN 'ADP' WHEN starts_with(x, 'VB') OR starts_with(x, 'VERB') THEN 'VERB'
WHEN starts_with(x, 'ADJ') OR starts_with(x, 'ORD') THEN 'ADJ' WHEN starts_with(x, 'ADV') THEN 'ADV' WHEN starts_with(x, 'PRON') THEN 'PRON' WHEN starts_with(x, 'N') OR starts_with(x, 'PLACE') OR starts_with(x, 'PERSON') THEN 'NOUN' WHEN starts_with(x, 'CARD') THEN 'NUM' WHEN starts_with(x, 'CONJ') THEN 'CONJ' ELSE 'other' END))) AS c FROM p)
SELECT cysill_pos, n, CASE WHEN cysill_pos IS NULL OR cysill_pos IN ('', '?', 'none', 'n/a') THEN 'unknown' ELSE array_to_string(c, '|') END AS coarse, CASE regexp_extract(cysill_pos, '^(?:N|PRON|CARD|ORD)(F|M)$', 1) WHEN 'F' THEN 'feminine' WHEN 'M' THEN 'masculine' END AS gender FROM e"""


@query(POS)
def pos_string_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "words").groupBy("cysill_pos").agg(F.count("*").alias("n"))
    return tags.select("cysill_pos", "n", text.coarse_pos(F.col("cysill_pos")).alias("coarse"), text.tag_gender(F.col("cysill_pos")).alias("gender"))


@query("""WITH s AS (SELECT mutation_id, try_cast(regexp_extract(timestamp_span, '([\\d.]+)s\\s*-\\s*([\\d.]+)s', 1) AS DOUBLE) AS a, try_cast(regexp_extract(timestamp_span, '([\\d.]+)s\\s*-\\s*([\\d.]+)s', 2) AS DOUBLE) AS b FROM mutations)
SELECT mutation_id, a AS t0, b AS t1, (floor(a)::BIGINT // 60) || ':' || lpad((floor(a)::BIGINT % 60)::VARCHAR, 2, '0') AS mmss, (floor(b)::BIGINT // 3600) || 'h ' || (floor(b)::BIGINT % 3600 // 60) || 'm ' || (floor(b)::BIGINT % 60) || 's' AS hms FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = text.parse_span(F.col("timestamp_span"))
    return table(spark, sf_dir, "mutations").select("mutation_id", a.alias("t0"), b.alias("t1"), text.mmss(a).alias("mmss"), text.hms(b).alias("hms")).where("t0 is not null and t1 is not null")


@query(f"SELECT utterance_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{readers.CHAT_ASIDE}', ' ', 'g'), '{readers.CHAT_INSIDE}', '', 'g'), '\\s+', ' ', 'g'), ' ') AS clean FROM chat_utterances WHERE text IS NOT NULL")
def parse_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines without their markup."""
    return table(spark, sf_dir, "chat_utterances").where("text is not null").select("utterance_id", readers.clean_chat(F.col("text")).alias("clean"))


@query(WORDS + f"SELECT word_id, n IN ({listed(ENGLISH)}) OR (n IN (SELECT lower(word) FROM known_words WHERE lang = 'en') AND n NOT IN (SELECT lower(word) FROM known_words WHERE lang = 'cy') AND NOT starts_with(n, 'ts') AND NOT starts_with(n, 'j')) AS switched FROM w WHERE n <> ''")
def code_switch_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "known_words").groupBy(F.lower("word").alias("n")).agg(F.max(F.col("lang") == "en").alias("en"), F.max(F.col("lang") == "cy").alias("cy"))
    words = table(spark, sf_dir, "words").select("word_id", text.normalize_word(F.col("word")).alias("n")).where("n <> ''")
    no = F.lit(False)
    return words.join(known, "n", "left").select("word_id", text.is_english(F.col("n"), F.coalesce("en", no), F.coalesce("cy", no)).alias("switched"))


@query()
def highlight_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole words y, yn and the in every text, whatever its script: a word ends where no letter, digit or mark of any script follows. DuckDB's \\b knows ASCII only, so there is no SQL."""
    texts = table(spark, sf_dir, "chat_utterances").where("text is not null")
    marked = F.col("text")
    for word in ("y", "yn", "the"):
        marked = text.highlight(marked, F.lit(word))
    return texts.select("utterance_id", marked.alias("marked"))


@query("""WITH c AS (SELECT mutation_id, following_word AS a, lemma AS b FROM mutations WHERE lemma IS NOT NULL AND following_word IS NOT NULL)
SELECT mutation_id, a <> b AND a[length(""" + CLUSTER.format(w="a") + ") + 1:] = b[length(" + CLUSTER.format(w="b") + ") + 1:] AS initial_only FROM c")
def differs_in_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "mutations").where("lemma is not null and following_word is not null")
    return m.select("mutation_id", text.differs_only_in_initial(F.col("following_word"), F.col("lemma")).alias("initial_only"))
