"""The rule engine's queries: each layer, and the whole scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.operators import rules
from gwerin.plans.registry import query
from gwerin.plans.text_queries import CLUSTER, ENGLISH, case, listed, sql_forward, sql_norm
from gwerin.session import table

TRIG = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T.TRIGGERS.items()) + ") AS trig(tw, listed)"
FIELDS = ["n", "word", "confidence", "cysill_pos", "spacy_pos", "spacy_dep", "gender", "lemma", "genuine", "word_end"]
FITS = [f"(s{k} IS NOT NULL AND s{k}.n NOT IN ({listed(T.FILLERS)}) AND s{k}.n <> me.n)" for k in (1, 2, 3)]
TABLES = ("soft", "soft_limited", "nasal", "aspirate")


def _letters(x: str) -> str:
    """SQL: every marked letter of the word is one of the language's."""
    return f"(len(list_filter(regexp_extract_all({x}.n, '.'), lambda z: unicode(z) BETWEEN 192 AND 591 AND NOT contains('{T.LEGAL_MARKED}', z))) = 0 AND NOT regexp_matches({x}.n, '\\p{{M}}'))"


def _seen(x: str) -> str:
    """SQL: nothing keeps the word from being evaluated."""
    collapsed = f"regexp_replace({x}.n, '" + "|".join(sorted(T.SINGLE_CLUSTERS, key=len, reverse=True)) + "', 'V', 'g')"
    return f"""({_letters(x)} AND NOT regexp_matches({x}.n, '{"|".join(T.IMPOSSIBLE_PAIRS)}') AND NOT regexp_matches({collapsed}, '[^{T.VOWELS}V]{{4,}}') AND {x}.n NOT IN ({listed(T.BOD_FORMS)})
AND NOT (coalesce({x}.cysill_pos, '') IN ('', '?', 'none', 'n/a') AND {x}.spacy_pos IS NULL) AND NOT regexp_matches(coalesce({x}.lemma, {x}.n), '^[{T.VOWELS}]'))"""


def _cluster(x: str) -> str:
    return CLUSTER.format(w=f"coalesce({x}.lemma, {x}.n)")


def _noun(x: str) -> str:
    return f"(coalesce({x}.spacy_pos IN ('NOUN', 'PROPN'), false) OR coalesce(starts_with({x}.cysill_pos, 'N'), false))"


def _fem(x: str) -> str:
    return f"coalesce(starts_with({x}.gender, 'fem'), false)"


def _fact(rule: str, trigger: str, exp: str, target: str, step: str | int, settled: str | None = None) -> str:
    settled = f"'{settled}'" if settled else "NULL::VARCHAR"
    return f"struct_pack(rule := '{rule}', trigger_word := {trigger}, exp := {exp}, target := {target}, step := {step}::INT, settled := {settled})"


def _exempt(label: str, x: str, exp: str) -> str:
    return f"(list_has_any({exp}, ['soft', 'soft_limited']) AND {_cluster(x)} IN ('ll', 'rh') AND ({label} IN ({listed(T.LL_RH_EXEMPT)}) OR ({label} IN ({listed(T.LL_RH_EXEMPT_NOUNS)}) AND coalesce({x}.spacy_pos, '') <> 'ADJ')))"


def _option(when: str, rule: str, kind: str, gate: str = "true") -> str:
    exp = f"['{kind}']"
    return f"CASE WHEN ({when}) AND s1 IS NOT NULL AND NOT coalesce(regexp_matches(me.word, '[,;:.]$'), false) AND coalesce(s1.confidence >= 0.65, false) THEN CASE WHEN s1.n IN ({listed(ENGLISH)}) THEN {_fact(rule, 'me.n', exp, 's1', 2, 'code_switch')} WHEN ({gate}) AND NOT {_exempt('me.n', 's1', exp)} AND {_seen('s1')} THEN {_fact(rule, 'me.n', exp, 's1', 2)} END END"


def _itself(when: str, rule: str, label: str) -> str:
    return f"CASE WHEN {when} AND me.n NOT IN ({listed(ENGLISH)}) AND {_seen('me')} THEN {_fact(rule, repr(label), '''['soft']''', 'me', 1)} END"


ADJ = "(coalesce(s1.spacy_pos = 'ADJ', false) OR coalesce(starts_with(s1.cysill_pos, 'ADJ'), false))"
FEM_NOUN = f"({_fem('me')} AND {_noun('me')})"
SECOND = case(T.COMPOUND_SECOND, "me.n")
NEIGHBOURS = "coalesce(" + ",\n".join([
    _option(f"me.n IN ({listed(T.ARTICLES)})", "definite_article+fem_noun", "soft_limited", f"{_fem('s1')} AND {_noun('s1')}"),
    _option(f"{FEM_NOUN} AND {ADJ}", "fem_noun+adjective", "soft", f"NOT (ends_with(me.n, 's') AND {_cluster('s1')} = 'd')"),
    _option(f"{FEM_NOUN} AND {_noun('s1')} AND coalesce(s1.spacy_dep = 'nmod', false)", "fem_noun+genitive_noun", "soft"),
    _option("me.n = 'un'", "numeral+fem_noun", "soft_limited", f"{_fem('s1')} AND {_noun('s1')}"),
    _option(f"me.n IN ('dau', 'dwy') AND {_noun('s1')}", "numeral_general+noun", "soft"),
    _option(f"me.n IN ({listed(T.NASAL_NUMERALS)})", "restricted_nasal_numeral", "nasal", f"coalesce(s1.lemma, s1.n) IN ({listed(T.NASAL_NUMERAL_TARGETS)})"),
    _option(f"coalesce(starts_with(me.cysill_pos, 'ORDF'), false) OR (coalesce(me.spacy_pos = 'ADJ', false) AND {_fem('me')})", "feminine_ordinal+noun", "soft", _noun("s1")),
    _option(f"coalesce({SECOND} = s1.n OR {SECOND} = s1.lemma, false)", "decompounded_noun", "soft"),
    _itself(f"coalesce(me.spacy_dep IN ({listed(T.OBJ_DEPS)}), false)", "spacy_obj_soft_unheaded", "[SHORT_FORM_VERB]"),
    _itself(f"coalesce(me.spacy_dep IN ({listed(T.VOCATIVE_DEPS)}), false)", "spacy_vocative_soft", "[VOCATIVE]"),
]) + ")"
MUTABLE = "(NOT list_has_any(exp, ['soft', 'soft_limited', 'nasal', 'aspirate']) OR " + " OR ".join(f"(list_contains(exp, '{k}') AND {_cluster('tt')} IN ({listed(list(T.FORWARD[k]))}))" for k in TABLES) + ")"
TRIGGER = f"""CASE WHEN tt IS NULL OR NOT coalesce(tt.confidence >= 0.65, false) THEN NULL WHEN tt.n IN ({listed(ENGLISH)}) THEN {_fact('word_trigger', 'me.n', 'exp', 'tt', 'ahead', 'code_switch')}
WHEN (me.n IN ('mae', 'ydy', 'oes') AND (tt.n IN ({listed(list(T.TRIGGERS))}) OR coalesce(tt.spacy_dep, '') = 'nsubj')) OR (me.n = 'yn' AND (coalesce(tt.spacy_pos, '') = 'VERB' OR starts_with(coalesce(tt.cysill_pos, ''), 'VB'))) OR coalesce({_exempt('me.n', 'tt', 'exp')}, false) THEN NULL
WHEN me.n = 'ei' AND {_fem('me')} THEN CASE WHEN {_seen('tt')} AND exp IS NOT NULL THEN {_fact('feminine_ei', 'me.n', 'exp', 'tt', 'ahead')} END
WHEN me.n IN ({listed(T.MIXED)}) THEN CASE WHEN {_seen('tt')} THEN {_fact('mixed_mutation', 'me.n', 'exp', 'tt', 'ahead')} END
WHEN me.n IN ({listed(T.H_TRIGGERS)}) THEN CASE WHEN regexp_matches(coalesce(tt.lemma, regexp_replace(tt.n, '^h', '')), '^[{T.VOWELS}]') THEN CASE WHEN starts_with(tt.n, 'h') AND NOT coalesce(starts_with(tt.lemma, 'h'), false)
  THEN {_fact('h_mutation', 'me.n', 'exp', 'tt', 'ahead', 'correct_mutation')} ELSE {_fact('h_mutation', 'me.n', 'exp', 'tt', 'ahead', 'erosion')} END END
WHEN {_seen('tt')} AND {MUTABLE} THEN {_fact('word_trigger', 'me.n', 'exp', 'tt', 'ahead')} END"""
FORMS = lambda z, of: " OR ".join(f"(list_contains(exp, '{k}') AND {sql_forward(k, z)} = {of})" for k in TABLES)
REVERSE = "list_filter([" + ", ".join(
    f"CASE WHEN list_contains(exp, '{k}') AND " + (f"regexp_matches(x.n, '^[{T.VOWELS}]') THEN '{a}' || x.n" if b == "" else f"{CLUSTER.format(w='x.n')} = '{b}' THEN '{a}' || x.n[{len(b) + 1}:]") + " END"
    for k in TABLES for a, b in T.FORWARD[k].items()
) + f", CASE WHEN list_contains(exp, 'h-mutation') AND regexp_matches(x.n, '^h[{T.VOWELS}]') THEN x.n[2:] END], lambda z: z IS NOT NULL AND z <> x.n)"
ASKS = "list_has_any(exp, ['soft', 'soft_limited', 'nasal', 'aspirate'])"
SCAN = f"""k AS (SELECT min(word_id) AS id FROM words WHERE video_url IS NOT NULL AND segment_start IS NOT NULL GROUP BY video_url, segment_start, word_start, word_end),
lem AS (SELECT {sql_norm('following_word')} AS ln, min(lemma) AS lm, max((NOT coalesce(locally_resolved, false))::INT) = 1 AS genuine FROM mutations WHERE lemma IS NOT NULL AND following_word IS NOT NULL GROUP BY 1),
w0 AS (SELECT * FROM (SELECT x.*, {sql_norm('word')} AS n FROM words x JOIN k ON x.word_id = k.id) LEFT JOIN lem ON ln = n WHERE length(n) >= 2),
w AS (SELECT *, CASE WHEN n IN ({listed(T.SUPPLETIVE)}) THEN n WHEN n NOT IN ({listed(ENGLISH)}) THEN nullif({sql_norm('lm')}, '') END AS lemma FROM w0),
m AS (SELECT video_url, segment_start, word_start, word_id, struct_pack({', '.join(f'{c} := {c}' for c in FIELDS)}) AS me FROM w),
i AS (SELECT *, row_number() OVER (PARTITION BY video_url, segment_start ORDER BY word_start, word_id) - 1 AS i, row_number() OVER o AS place, lead(me, 1) OVER o AS s1, lead(me, 2) OVER o AS s2, lead(me, 3) OVER o AS s3 FROM m WINDOW o AS (PARTITION BY video_url ORDER BY segment_start, word_start, word_id)),
p AS (SELECT *, CASE """ + " ".join(f"WHEN {f} THEN s{k}" for k, f in enumerate(FITS, 1)) + " END AS tt, CASE " + " ".join(f"WHEN {f} THEN {k}" for k, f in enumerate(FITS, 1)) + f""" ELSE 1 + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT END AS ahead,
coalesce(me.confidence >= 0.65, false) AND {_letters('me')} AND (me.n NOT IN ({listed(T.BOD_FORMS)}) OR me.n IN ({listed(list(T.TRIGGERS))})) AS guarded FROM i),
e AS (SELECT p.*, listed IS NOT NULL AND NOT (me.n = 'oes' AND {_noun('me')}) AS trig, string_split(listed, '|') AS l FROM p LEFT JOIN {TRIG} ON tw = me.n),
x AS (SELECT *, CASE WHEN me.n = 'yn' THEN CASE WHEN regexp_matches(coalesce(me.cysill_pos, ''), '^(PREP|CPREP)') OR coalesce(me.spacy_dep, '') = 'case' THEN ['nasal'] WHEN regexp_matches(coalesce(me.cysill_pos, ''), 'VERBADJ|PREDYN|VB|ADV') OR coalesce(me.spacy_dep, '') IN ('aux', 'mark') THEN ['soft_limited'] ELSE l END
WHEN me.n = 'ei' THEN CASE WHEN starts_with(me.gender, 'fem') THEN CASE WHEN regexp_matches(tt.n, '^[{T.VOWELS}]') THEN ['h-mutation'] WHEN regexp_matches(tt.n, '^[ptc]') THEN ['aspirate'] END WHEN starts_with(me.gender, 'masc') THEN ['soft'] ELSE l END
WHEN me.n IN ({listed(T.MIXED)}) THEN CASE WHEN regexp_matches(tt.n, '^[ptc]') THEN ['aspirate'] ELSE ['soft'] END ELSE l END AS exp FROM e),
h AS (SELECT video_url, segment_start, i, place, ahead, guarded, trig, CASE WHEN guarded THEN CASE WHEN trig THEN {TRIGGER} ELSE {NEIGHBOURS} END END AS h FROM x),
f0 AS (SELECT video_url, segment_start, i, place, trig, h.rule AS rule, h.trigger_word AS trigger_word, h.exp AS exp, h.target AS x, h.settled AS settled FROM h WHERE h IS NOT NULL),
f1 AS (SELECT *, (x.cysill_pos IS NOT NULL AND coalesce(x.genuine OR x.n IN ({listed(T.SUPPLETIVE)}), false) AND coalesce(x.lemma = x.n OR {CLUSTER.format(w='x.lemma')} = {CLUSTER.format(w='x.n')}, false)) OR (starts_with(x.n, 'h') AND NOT list_contains(exp, 'h-mutation') AND {ASKS}) AS unchanged,
CASE WHEN starts_with(x.lemma, 'g') AND NOT starts_with(x.n, 'g') AND 'g' || x.n = x.lemma THEN 'soft' ELSE {case(T.SURFACE_TYPE, CLUSTER.format(w='x.n'))} END AS shown,
list_concat(CASE WHEN x.lemma = x.n OR {FORMS('x.lemma', 'x.n')} THEN [x.lemma] ELSE []::VARCHAR[] END, list_concat(list_sort(list_distinct({REVERSE})), [x.n])) AS cands,
(coalesce(x.cysill_pos, '') NOT IN ('', 'unknown', '?', 'none', 'n/a') OR coalesce(x.spacy_pos, '') NOT IN ('', 'unknown', 'PUNCT', 'SPACE', 'X')) AS tagged,
CASE WHEN starts_with(x.n, 'j') AND length(x.n) > 1 THEN 'colloquial_affricate' END AS casual FROM f0),
f2 AS (SELECT *, CASE WHEN NOT unchanged THEN list_filter(cands, lambda z: {FORMS('z', 'x.n')})[1] END AS matched, CASE WHEN NOT unchanged THEN shown END AS surf,
len(list_filter(cands, lambda z: """ + " OR ".join(f"(list_contains(exp, '{k}') AND z[1] IN ({listed([v for v in vs if len(v) == 1])}))" for k, vs in T.INVARIANT.items()) + f""")) > 0 AS inv FROM f1),
facts AS (SELECT video_url, segment_start, i, place, trig, rule, trigger_word, x.n AS following_word, array_to_string(exp, '|') AS expected,
CASE WHEN settled = 'correct_mutation' THEN 'h-mutation' WHEN settled IS NULL THEN coalesce(surf, CASE WHEN matched IS NOT NULL THEN exp[1] END, casual) END AS surface,
CASE WHEN settled IS NOT NULL THEN settled WHEN matched IS NOT NULL OR coalesce(list_contains(exp, surf), false) OR coalesce(list_contains(exp, casual), false) THEN 'correct_mutation' WHEN inv AND unchanged THEN 'selective_invariancy'
WHEN unchanged AND {ASKS} THEN CASE WHEN tagged THEN 'erosion' ELSE 'erosion_unverified' END WHEN unchanged THEN 'mutation_absent_expected_none' WHEN surf IS NOT NULL THEN CASE WHEN tagged THEN 'wrong_mutation_type' ELSE 'erosion_unverified' END ELSE 'mutation_mismatch' END AS status,
CASE WHEN settled IS NULL THEN CASE WHEN coalesce(shown IN ('nasal', 'aspirate'), false) OR (shown IS NULL AND list_has_any(exp, ['nasal', 'aspirate'])) THEN 'colloquial_variant' ELSE 'standard' END ELSE 'n/a' END AS register_class, CASE WHEN settled IS NULL THEN matched END AS matched_radical FROM f2)
"""
COLUMNS = ["video_url", "segment_start", "i", "rule", "trigger_word", "following_word", "expected", "surface", "status", "register_class", "matched_radical"]
VISITED = """, u AS (SELECT video_url, place, CASE WHEN NOT guarded THEN 1 WHEN trig THEN ahead ELSE coalesce(h.step, 1) END AS step FROM h),
v AS (SELECT video_url, place FROM u WHERE place = 1 UNION ALL SELECT u.video_url, u.place + u.step FROM v JOIN u ON u.video_url = v.video_url AND u.place = v.place)
"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.enrich(table(spark, sf_dir, "words"), rules.lemma_table(table(spark, sf_dir, "mutations")))


def _columns(facts: DataFrame) -> DataFrame:
    return facts.withColumn("i", F.col("i").cast("bigint")).select(*COLUMNS)


@query("WITH " + SCAN + f"SELECT {', '.join(COLUMNS)} FROM facts WHERE trig")
def rule_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that trigger words and their targets make, by the whole decision list, wherever the scan stops."""
    return _columns(rules.word_trigger_facts(_words(spark, sf_dir)))


@query("WITH " + SCAN + f"SELECT {', '.join(COLUMNS)} FROM facts WHERE NOT trig")
def neighbour_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the layers behind the trigger layer, wherever the scan stops."""
    return _columns(rules.neighbour_facts(_words(spark, sf_dir)))


@query("WITH RECURSIVE " + SCAN + VISITED + "SELECT h.video_url, h.segment_start, h.i FROM v JOIN h ON h.video_url = v.video_url AND h.place = v.place")
def cursor_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words at which the scan of each video stops: a trigger consumes all up to its target, another fact what it needs."""
    return rules.scan(_words(spark, sf_dir)).select("video_url", "segment_start", F.col("i").cast("bigint").alias("i"))


@query("WITH RECURSIVE " + SCAN + VISITED + f"SELECT {', '.join('facts.' + c for c in COLUMNS)} FROM v JOIN facts ON facts.video_url = v.video_url AND facts.place = v.place")
def scan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the whole engine, no two from overlapping words."""
    return _columns(rules.scan_facts(_words(spark, sf_dir)))
