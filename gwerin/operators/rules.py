"""The rule engine: trigger words, their targets, outcome and confidence, as one chain of expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.functions import text
from gwerin.session import sent, written

AHEAD = 3
GATE = 0.65
HIGH = 0.85
LEMMAS = 200_000  # known lemmas up to which they are sent to the words; beyond, both are shuffled
BUCKET = 300.0  # seconds of a video whose words are looked through at a time
TAGS = ["word", "confidence", "cysill_pos", "spacy_pos", "spacy_dep", "spacy_mutation", "gender"]
# what a parser or tagger may say besides; layers that need it are silent where a table lacks it
MORE = ["head", "head_dep", "head_verbform", "cysill_mutation_type", "number"]
# what the layers ask of a word, told once for each word rather than for each that looks at it
TOLD = ["sure", "english", "seen", "lead", "noun", "feminine", "adjective", "pause", "tagged", "shown", "own", "trigger"]
NODE = ["w", *TAGS[1:], *MORE, "lemma", "word_end", *TOLD]


def node(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}.{c}") for c in NODE}


def lemma_table(facts: DataFrame) -> DataFrame:
    """(n, lemma, genuine) of the words that earlier facts hold: the first lemma in order, and whether a tagger gave it rather than the lexicon."""
    known = facts.where("lemma is not null and following_word is not null")
    return known.groupBy(text.normalize_word(F.col("following_word")).alias("n")).agg(F.min("lemma").alias("lemma"), F.max(~F.coalesce(F.col("locally_resolved"), F.lit(False))).alias("genuine"))


def enrich(words: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(video_url, segment_start, i, node): delivered words once, in order within their segment, with what the taggers said and the lemma.

    The order is by segment, so no video, however long, is sorted in one task. Suppletive
    forms are their own lemma, words of the other language have none. Columns of MORE that
    the table lacks are null.
    """
    kept = [c for c in MORE if c in words.columns]
    rows = words.where("video_url is not null and segment_start is not null").select("video_url", "segment_start", "word_start", "word_end", "word_id", *TAGS, *kept)
    # one exchange for deliveries, order and neighbours: a bucket of a video holds whole segments
    rows = rows.withColumn("_b", F.floor(F.col("segment_start") / BUCKET)).repartition("video_url", "_b")
    w = rows.groupBy("video_url", "_b", "segment_start", "word_start", "word_end").agg(F.min_by(F.struct("word_id", *TAGS, *kept), "word_id").alias("r")).select("video_url", "_b", "segment_start", "word_start", "word_end", "r.*")
    w = w.withColumn("w", text.normalize_word(F.col("word"))).where(F.length("w") >= 2)
    w = w.withColumns({c: F.lit(None).cast("string") for c in MORE if c not in kept})
    if lemmas is None:
        w = w.withColumns({"lemma": F.lit(None).cast("string"), "genuine": F.lit(None).cast("boolean")})
    else:
        w = w.join(sent(lemmas, LEMMAS), w["w"] == lemmas["n"], "left").drop("n")
    w = w.withColumn("lemma", F.when(F.col("w").isin(T.SUPPLETIVE), F.col("w")).when(~text.is_english(F.col("w")), F.nullif(text.normalize_word(F.col("lemma")), F.lit(""))))
    by = Window.partitionBy("video_url", "_b", "segment_start").orderBy("word_start", "word_id")
    return w.withColumn("i", F.row_number().over(by) - 1)


def with_next(words: DataFrame, steps: int) -> DataFrame:
    """The words of each video with those that follow as next1, next2, ..., and their bucket ``_b`` and place ``_at`` in it.

    Words lie in buckets of ``BUCKET`` seconds; a bucket gets the first words of those after it.
    """
    if "_b" not in words.columns:
        words = words.withColumn("_b", F.floor(F.col("segment_start") / BUCKET))
    bucket = Window.partitionBy("video_url", "_b")
    by = bucket.orderBy("segment_start", "i")
    here = words.withColumns({f"_lead{k}": F.lead("me", k).over(by) for k in range(1, steps + 1)} | {"_at": F.row_number().over(by)}).withColumn("_left", F.count("*").over(bucket) - F.col("_at"))
    first = here.where(F.col("_at") <= steps).groupBy("video_url", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "me"))), lambda x: x["me"]).alias("_first"))
    later = Window.partitionBy("video_url").orderBy("_b")
    none = F.slice("_first", 1, 0)
    then = first.select("video_url", "_b", F.concat(*[F.coalesce(F.lead("_first", k).over(later), none) for k in range(1, steps + 1)]).alias("_then"))
    here = here.join(then, ["video_url", "_b"])
    after = lambda k: F.when(F.col("_left") >= k, F.col(f"_lead{k}")).otherwise(F.try_element_at("_then", F.greatest(F.lit(1), F.lit(k) - F.col("_left")).cast("int")))
    return here.withColumns({f"next{k}": after(k) for k in range(1, steps + 1)}).drop("_left", "_then", *[f"_lead{k}" for k in range(1, steps + 1)])


def tell(words: DataFrame) -> DataFrame:
    """The words with the columns of TOLD."""
    x = {c: F.col(c) for c in ("w", "lemma", "genuine", *TAGS, *MORE)}
    no = F.lit(False)
    begins = lambda c, p: F.coalesce(x[c].startswith(p), no)
    noun = F.coalesce(x["spacy_pos"].isin("NOUN", "PROPN"), no) | begins("cysill_pos", "N")
    return words.withColumns({
        "sure": F.coalesce(x["confidence"] >= GATE, no), "english": text.is_english(x["w"]), "seen": skip_reason(x).isNull(), "lead": text.initial_cluster(F.coalesce(x["lemma"], x["w"])),
        "noun": noun, "feminine": begins("gender", "fem"), "adjective": F.coalesce(x["spacy_pos"] == "ADJ", no) | begins("cysill_pos", "ADJ"), "pause": F.coalesce(x["word"].rlike("[,;:.]$"), no),
        "tagged": tagged(x), "shown": surface_change(x), "own": own_lemma(x), "trigger": x["w"].isin(list(T.TRIGGERS)),
    })


def expected_types(t: dict[str, Column], target: dict[str, Column]) -> Column:
    """Array of the types that a trigger asks for, given its own tags and, for mixed triggers, the target's beginning."""
    listed = F.split(F.try_element_at(text.literal_map(T.TRIGGERS), t["w"]), r"\|")
    one = lambda x: F.array(F.lit(x))
    pos, dep = F.coalesce(t["cysill_pos"], F.lit("")), F.coalesce(t["spacy_dep"], F.lit(""))
    yn = F.when(pos.rlike("^(PREP|CPREP)") | (dep == "case"), one("nasal")).when(pos.rlike("VERBADJ|PREDYN|VB|ADV") | dep.isin("aux", "mark"), one("soft_limited")).otherwise(listed)
    mixed = F.when(target["w"].rlike("^[ptc]"), one("aspirate")).otherwise(one("soft"))
    ei = F.when(t["gender"].startswith("fem"), F.when(target["w"].rlike(f"^[{T.VOWELS}]"), one("h-mutation")).when(target["w"].rlike("^[ptc]"), one("aspirate"))).when(t["gender"].startswith("masc"), one("soft")).otherwise(listed)
    return F.when(t["w"] == "yn", yn).when(t["w"] == "ei", ei).when(t["w"].isin(T.MIXED), mixed).otherwise(listed)


def skip_reason(x: dict[str, Column]) -> Column:
    """Why a target isn't evaluated, the first that applies; null if it is."""
    return (
        F.when(~text.plausible_letters(x["w"]), "implausible_letters").when(~text.plausible_word(x["w"]), "impossible_word").when(x["w"].isin(T.BOD_FORMS), "bod_inflection")
        .when(F.coalesce(x["cysill_pos"], F.lit("")).isin("", "?", "none", "n/a") & x["spacy_pos"].isNull(), "taggers_failed").when(F.coalesce(x["lemma"], x["w"]).rlike(f"^[{T.VOWELS}]"), "vowel_initial")
    )


def surface_change(x: dict[str, Column]) -> Column:
    """Type of change that the word shows: by its beginning, or soft where it is its lemma without g."""
    dropped = F.coalesce(x["lemma"].startswith("g") & ~x["w"].startswith("g") & (F.concat(F.lit("g"), x["w"]) == x["lemma"]), F.lit(False))
    return F.when(dropped, "soft").otherwise(text.surface_type(x["w"]))


def own_lemma(x: dict[str, Column]) -> Column:
    """A tagger's own lemma is the word or begins like it."""
    same = (x["lemma"] == x["w"]) | (text.initial_cluster(x["lemma"]) == text.initial_cluster(x["w"]))
    return F.coalesce(x["cysill_pos"].isNotNull() & (F.coalesce(x["genuine"], F.lit(False)) | x["w"].isin(T.SUPPLETIVE)) & same, F.lit(False))


def _asks(expected: Column) -> Column:
    return F.arrays_overlap(expected, F.array(*[F.lit(k) for k in ("soft", "soft_limited", "nasal", "aspirate")]))


def radical_candidates(expected: Column, x: dict[str, Column]) -> Column:
    """Array of what the word may be a changed form of: the lemma, if the expected types make the word of it, what they reverse to, in order, and the word."""
    fits = F.coalesce((x["lemma"] == x["w"]) | F.array_contains(text.surface_forms(x["lemma"], expected), x["w"]), F.lit(False))
    lemma = F.when(fits, F.array(x["lemma"])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(lemma, text.reverse_candidates(x["w"], expected), F.array(x["w"])))


def tagged(x: dict[str, Column]) -> Column:
    """At least one tagger gave a real class, without which a lost change can't be told."""
    real = lambda c, *no: x[c].isNotNull() & ~x[c].isin("", "unknown", *no)
    return real("cysill_pos", "?", "none", "n/a") | real("spacy_pos", "PUNCT", "SPACE", "X")


def register(expected: Column, surface: Column) -> Column:
    """Nasal and aspirate change recede in the colloquial register, where shown or missing."""
    receding = F.array(F.lit("nasal"), F.lit("aspirate"))
    return F.when(surface.isin("nasal", "aspirate") | (surface.isNull() & F.arrays_overlap(expected, receding)), "colloquial_variant").otherwise("standard")


def outcome(rows: DataFrame) -> DataFrame:
    """Rows with expected and target, and status, found, is_erosion, register_class and matched_radical of the target, step by step.

    The word is unchanged if a tagger's own lemma begins alike, or if it begins with h,
    which none but h-mutation makes. In order: a candidate that the expected types turn
    into the word, or a fitting beginning, is correct; an unchanged word is invariant,
    eroded or needs no change; any other change is of the wrong type; the rest doesn't match.
    """
    x, expected, no = node("target"), F.col("expected"), F.lit(False)
    h = x["w"].startswith("h") & ~F.array_contains(expected, "h-mutation") & _asks(expected)
    rows = rows.withColumns({"_unchanged": x["own"] | h, "_candidates": radical_candidates(expected, x)})
    match = F.try_element_at(F.filter("_candidates", lambda c: F.array_contains(text.surface_forms(c, expected), x["w"])), F.lit(1))
    invariant = F.exists("_candidates", lambda c: _any([F.array_contains(expected, k) & F.substring(c, 1, 1).isin([v for v in vs if len(v) == 1]) for k, vs in T.INVARIANT.items()]))
    rows = rows.withColumns({
        "matched_radical": F.when(~F.col("_unchanged"), match), "_invariant": invariant, "_surface": F.when(~F.col("_unchanged"), x["shown"]),
        "_casual": F.when(x["w"].startswith("j") & (F.length(x["w"]) > 1), F.lit("colloquial_affricate")),
    })
    fits = F.coalesce(F.array_contains(expected, F.col("_surface")), no) | F.coalesce(F.array_contains(expected, F.col("_casual")), no)
    status = (
        F.when(F.col("matched_radical").isNotNull() | fits, "correct_mutation").when(F.col("_invariant") & F.col("_unchanged"), "selective_invariancy")
        .when(F.col("_unchanged") & _asks(expected), F.when(x["tagged"], "erosion").otherwise("erosion_unverified")).when(F.col("_unchanged"), "mutation_absent_expected_none")
        .when(F.col("_surface").isNotNull(), F.when(x["tagged"], "wrong_mutation_type").otherwise("erosion_unverified")).otherwise("mutation_mismatch")
    )
    found = F.coalesce("_surface", F.when(F.col("matched_radical").isNotNull(), F.try_element_at(expected, F.lit(1))), "_casual")
    return rows.withColumns({"status": status, "found": found, "register_class": register(expected, x["shown"])})


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _fact(rule: str, trigger: Column, expected: Column, target: str, step: int | Column, status: str | None = None) -> Column:
    """A fact to come; ``status`` if it is settled without looking at the target's change."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.struct(F.lit(rule).alias("rule"), trigger.alias("trigger_word"), expected.alias("expected"), F.col(target).alias("target"), step.cast("int").alias("step"), F.lit(status).cast("string").alias("settled"))


def _exempt(label: Column, x: dict[str, Column], expected: Column) -> Column:
    """Words in ll and rh keep them behind some triggers where only soft change is asked for."""
    asked = F.array_contains(expected, "soft") | F.array_contains(expected, "soft_limited")
    behind = label.isin(T.LL_RH_EXEMPT) | (label.isin(T.LL_RH_EXEMPT_NOUNS) & (F.coalesce(x["spacy_pos"], F.lit("")) != "ADJ"))
    return asked & x["lead"].isin("ll", "rh") & behind


def _word_trigger() -> Column:
    """Fact of a trigger word and its target ``to``; null if the gates let none through."""
    t, x = node("me"), node("to")
    expected = expected_types(t, x)
    expected_or_none = F.coalesce(expected, F.array().cast("array<string>"))
    bod = t["w"].isin(T.BOD_TRIGGERS) & (x["trigger"] | (F.coalesce(x["spacy_dep"], F.lit("")) == "nsubj"))
    verb = (t["w"] == "yn") & ((F.coalesce(x["spacy_pos"], F.lit("")) == "VERB") | F.coalesce(x["cysill_pos"], F.lit("")).startswith("VB"))
    base = F.coalesce(x["lemma"], F.regexp_replace(x["w"], "^h", ""))
    applied = x["w"].startswith("h") & ~F.coalesce(x["lemma"].startswith("h"), F.lit(False))
    mutable = ~_asks(expected) | _any([F.array_contains(expected, k) & x["lead"].isin(list(v)) for k, v in T.FORWARD.items() if k != "colloquial_affricate"])
    ei, mixed, h = (t["w"] == "ei") & t["feminine"], t["w"].isin(T.MIXED), t["w"].isin(T.H_TRIGGERS)
    seen = x["seen"]
    make = lambda rule, status=None: _fact(rule, t["w"], expected, "to", F.col("ahead"), status)
    return (
        F.when(x["w"].isNull() | ~x["sure"], None).when(x["english"], make("word_trigger", "code_switch")).when(bod | verb | _exempt(t["w"], x, expected_or_none), None)
        .when(ei, F.when(seen & expected.isNotNull(), make("feminine_ei"))).when(mixed, F.when(seen, make("mixed_mutation")))
        .when(h, F.when(base.rlike(f"^[{T.VOWELS}]"), F.when(applied, make("h_mutation", "correct_mutation")).otherwise(make("h_mutation", "erosion"))))
        .when(seen & mutable, make("word_trigger"))
    )


def _neighbours() -> Column:
    """Fact of the first layer that gives one, of a word that is no trigger: what it does to the next word, or shows itself."""
    me, x = node("me"), node("next1")
    no = F.lit(False)
    is_ = lambda c, *values: F.coalesce(c.isin(*values), no)
    close = x["w"].isNotNull() & x["sure"] & ~me["pause"]

    def option(when: Column, rule: str, kind: str, gate: Column = F.lit(True)) -> Column:
        expected = F.array(F.lit(kind))
        fact = lambda status=None: _fact(rule, me["w"], expected, "next1", 2, status)
        return F.when(when & close, F.when(x["english"], fact("code_switch")).when(gate & ~_exempt(me["w"], x, expected) & x["seen"], fact()))

    noun, fem_noun = x["noun"], me["feminine"] & me["noun"] & (F.coalesce(me["number"], F.lit("")) != "plural")
    adjective, hard_s = x["adjective"], me["w"].endswith("s") & (x["lead"] == "d")
    ordinal = F.coalesce(me["cysill_pos"].startswith("ORDF"), no) | (is_(me["spacy_pos"], "ADJ") & me["feminine"])
    second = F.try_element_at(text.literal_map(T.COMPOUND_SECOND), me["w"])
    years = F.coalesce(x["lemma"], x["w"]).isin(T.NASAL_NUMERAL_TARGETS)
    itself = lambda when, rule, label: F.when(F.coalesce(when, no) & ~me["english"] & me["seen"], _fact(rule, F.lit(label), F.array(F.lit("soft")), "me", 1))
    governed = is_(me["spacy_dep"], *T.OBJ_DEPS)
    # a table without the parser's heads can't tell finite verbs from verb-nouns: such facts have a rule of their own
    headed = is_(me["head_dep"], "ROOT", "ccomp", "xcomp") & (F.coalesce(me["head_verbform"], F.lit("")) != "Vnoun")
    phantom = (me["confidence"] > HIGH) & (me["shown"] == "soft") & me["cysill_mutation_type"].isNotNull() & me["cysill_pos"].rlike("^(" + "|".join(k.replace("+", r"\+") for k in T.PHANTOM_TAGS) + ")") & me["seen"] & ~me["english"]
    return F.coalesce(
        option(me["w"].isin(T.ARTICLES), "definite_article+fem_noun", "soft_limited", x["feminine"] & (F.coalesce(x["number"], F.lit("")) != "plural") & noun),
        option(fem_noun & adjective, "fem_noun+adjective", "soft", ~hard_s),
        option(fem_noun & noun & is_(x["spacy_dep"], "nmod"), "fem_noun+genitive_noun", "soft"),
        option(me["w"] == "un", "numeral+fem_noun", "soft_limited", x["feminine"] & noun),
        option(me["w"].isin("dau", "dwy") & noun, "numeral_general+noun", "soft"),
        option(me["w"].isin(T.NASAL_NUMERALS), "restricted_nasal_numeral", "nasal", years),
        option(ordinal, "feminine_ordinal+noun", "soft", noun),
        option(me["w"].isin(T.PREPOSED_ADJECTIVES) & is_(me["spacy_pos"], "ADJ") & is_(me["spacy_dep"], "amod") & F.coalesce(text.normalize_word(me["head"]) == x["w"], no), "preposed_adjective+noun", "soft", noun),
        option(F.coalesce((second == x["w"]) | (second == x["lemma"]), no), "decompounded_noun", "soft"),
        itself(governed & headed, "spacy_obj_soft", "[SHORT_FORM_VERB]"),
        itself(governed & me["head_dep"].isNull(), "spacy_obj_soft_unheaded", "[SHORT_FORM_VERB]"),
        itself(is_(me["spacy_dep"], *T.VOCATIVE_DEPS), "spacy_vocative_soft", "[VOCATIVE]"),
        F.when(F.coalesce(phantom, no), _fact("phantom_check", F.lit("[OMITTED]"), F.array(F.lit("soft")), "me", 1, "phantom_mutation")),
    )


def candidates(words: DataFrame) -> DataFrame:
    """Every word of ``enrich`` with the fact it would give if the scan stopped there (``hit``, null if none) and how many words it would go on (``step``).

    A trigger word consumes all words up to its target, fact or none: the target is the
    first of the next three that is neither a filler nor the trigger again.
    """
    rows = with_next(tell(words).withColumn("me", F.struct(*NODE)), AHEAD)
    target, ahead = F.lit(None), F.lit(AHEAD + 1)
    for k in range(AHEAD, 0, -1):
        nxt = F.col(f"next{k}")
        fits = nxt.isNotNull() & ~nxt["w"].isin(T.FILLERS) & (nxt["w"] != F.col("w"))
        target, ahead = F.when(fits, nxt).otherwise(target), F.when(fits, k).otherwise(ahead)
    left = sum((F.col(f"next{k}").isNotNull().cast("int") for k in range(1, AHEAD + 1)), F.lit(1))  # a scan stops looking at the video's end
    rows = rows.withColumns({"to": target, "ahead": F.least(ahead, left)})
    me = node("me")
    guarded = me["sure"] & text.plausible_letters(me["w"]) & (~me["w"].isin(T.BOD_FORMS) | me["trigger"])
    trigger = me["trigger"] & ~((me["w"] == "oes") & me["noun"])
    hit = F.when(guarded, F.when(trigger, _word_trigger()).otherwise(_neighbours()))
    rows = rows.withColumns({"hit": hit, "guarded": guarded, "fires": guarded & trigger})
    return rows.select("video_url", "_b", "_at", "segment_start", "i", "word_start", "hit", F.when(F.col("fires"), F.col("ahead")).otherwise(F.coalesce("hit.step", F.lit(1))).alias("step"), "guarded", "fires")


def evaluate(rows: DataFrame) -> DataFrame:
    """The facts of rows with a ``hit``: (video_url, segment_start, i, rule, trigger_word, following_word, lemma, expected, surface, status, is_erosion, register_class, matched_radical, word_start, target_end)."""
    rows = outcome(rows.where("hit is not null").select("video_url", "segment_start", "i", "word_start", "hit.*"))
    settled, plain = F.col("settled"), F.col("settled").isNull()
    status = F.coalesce(settled, F.col("status"))
    found = F.when(plain, F.col("found")).when(settled == "correct_mutation", "h-mutation").when(settled == "phantom_mutation", "soft")
    register_class = F.when(plain, F.col("register_class")).when(settled == "phantom_mutation", "colloquial_variant").otherwise("n/a")
    return rows.select(
        "video_url", "segment_start", "i", "rule", "trigger_word", F.col("target.w").alias("following_word"), F.col("target.lemma").alias("lemma"), F.array_join("expected", "|").alias("expected"), found.alias("surface"),
        status.alias("status"), status.isin("erosion", "wrong_mutation_type").alias("is_erosion"), register_class.alias("register_class"), F.when(plain, F.col("matched_radical")).alias("matched_radical"), "word_start", F.col("target.word_end").alias("target_end"),
    )


def word_trigger_facts(words: DataFrame) -> DataFrame:
    """Facts of every trigger word, wherever the scan stops."""
    return evaluate(candidates(words).where("fires"))


def neighbour_facts(words: DataFrame) -> DataFrame:
    """Facts of the layers that look at the next word or the word alone, wherever the scan stops."""
    return evaluate(candidates(words).where("guarded and not fires"))


def _walk(steps: list[int], skip: int) -> tuple[list[bool], int]:
    """Where a scan stops that first skips some words, and how many it still skips behind the last."""
    out = []
    for n in steps:
        out.append(skip == 0)
        skip = (skip or n) - 1
    return out, skip


def _ways(steps: Column) -> Column:
    """Words that remain to be skipped behind a bucket, for each number of words skipped at its beginning."""

    @F.arrow_udf("array<int>")
    def ways(batch: pa.Array) -> pa.Array:
        return pa.array([[_walk(s, k)[1] for k in range(AHEAD + 1)] for s in batch.to_pylist()], pa.list_(pa.int32()))

    return ways(steps)


def _stops(steps: Column, skip: Column) -> Column:
    @F.arrow_udf("array<boolean>")
    def stops(batch: pa.Array, skips: pa.Array) -> pa.Array:
        return pa.array([_walk(s, k)[0] for s, k in zip(batch.to_pylist(), skips.to_pylist())], pa.list_(pa.bool_()))

    return stops(steps, skip)


def _entries(ways: DataFrame, fanout: int = 256) -> DataFrame:
    """(video_url, _b, skip): words to skip at each bucket's beginning: the buckets' ways are composed, first within blocks of buckets, then over the blocks."""
    follow = lambda col, start: F.aggregate(col, start, lambda at, x: F.element_at(x["way"], at + 1))
    blocks = ways.withColumn("_c", F.floor(F.col("_b") / fanout)).groupBy("video_url", "_c").agg(F.array_sort(F.collect_list(F.struct("_b", "way"))).alias("l"))  # at most ``fanout`` small rows
    blocks = blocks.withColumn("way", F.array(*[follow(F.col("l"), F.lit(k)) for k in range(AHEAD + 1)]))
    before = Window.partitionBy("video_url").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per block: with 300 s a bucket, 21 hours of a video
    at = blocks.withColumn("skip", F.aggregate(F.coalesce(F.collect_list(F.struct("way")).over(before), F.array().cast("array<struct<way:array<int>>>")), F.lit(0), lambda a, x: F.element_at(x["way"], a + 1)))
    grown = F.aggregate("l", F.struct(F.col("skip").alias("at"), F.array().cast("array<struct<b:bigint,skip:int>>").alias("out")), lambda a, x: F.struct(F.element_at(x["way"], a["at"] + 1).alias("at"), F.concat(a["out"], F.array(F.struct(x["_b"].alias("b"), a["at"].alias("skip")))).alias("out")), lambda a: a["out"])
    return at.select("video_url", F.explode(grown).alias("e")).select("video_url", F.col("e.b").alias("_b"), F.col("e.skip").alias("skip"))


def scan(words: DataFrame) -> DataFrame:
    """The words at which the scan of each video stops, with their ``hit``.

    The scan goes on by each word's ``step``. What a bucket of the video does to it is a map from
    words to skip at its beginning to words to skip behind it; the maps are composed over
    the buckets, so no video is walked in one task.
    """
    rows = written(candidates(words).select("video_url", "_b", "_at", "segment_start", "i", "word_start", "hit", "step"))  # most hits are null; read twice
    steps = rows.groupBy("video_url", "_b").agg(F.array_sort(F.collect_list(F.struct("_at", "step"))).alias("l"))  # the words of ``BUCKET`` seconds
    steps = written(steps.select("video_url", "_b", F.transform("l", lambda x: x["step"]).alias("steps")))
    entries = _entries(steps.select("video_url", "_b", _ways(F.col("steps")).alias("way")))
    stops = steps.join(entries, ["video_url", "_b"]).select("video_url", "_b", F.posexplode(_stops(F.col("steps"), F.col("skip"))).alias("p", "stop"))
    stops = stops.where("stop").select("video_url", "_b", (F.col("p") + 1).alias("_at"))
    return rows.join(stops, ["video_url", "_b", "_at"]).select("video_url", "segment_start", "i", "word_start", "hit")


def scan_facts(words: DataFrame) -> DataFrame:
    """The facts of the whole engine: those of the words at which the scan stops."""
    return evaluate(scan(words).where("hit is not null"))


def confidence(df: DataFrame) -> DataFrame:
    """Score and source of facts from which taggers share the surface type."""
    surface = F.nullif(F.nullif(F.col("mutation_found"), F.lit("none")), F.lit("n/a"))
    wanted = F.split("expected_mutation", r"\|")
    b = F.try_element_at(text.literal_map(T.PARSER_TYPES), F.col("spacy_mutation"))
    a = F.nullif(F.nullif(F.col("cysill_mutation_type"), F.lit("n/a")), F.lit("none"))
    genuine = ~F.coalesce(F.col("locally_resolved"), F.lit(False))
    no = F.lit(False)
    pc = F.coalesce((b == surface) | F.array_contains(wanted, b), no)
    cc = genuine & F.coalesce((a == surface) | F.array_contains(wanted, a), no)
    heard = surface.isNotNull()
    ctx = F.coalesce(F.col("spacy_dep").isin("obj", "iobj", "nsubj", "obl", "vocative", "amod", "nmod", "xcomp"), no)
    rad, hf = genuine & a.isNull(), surface.isNull() & F.col("expected_mutation").isNotNull()
    pick = lambda score, name: F.struct(F.lit(score).alias("score"), F.lit(name).alias("source"))
    calm = (
        F.when(pc & cc & heard, pick(1.0, "all_three")).when(pc & cc, pick(0.95, "parser+cysill")).when(pc & heard, pick(0.8, "parser+heuristic")).when(cc & heard, pick(0.65, "cysill+heuristic"))
        .when(pc, pick(0.7, "parser_only")).when(cc, pick(0.5, "cysill_only")).otherwise(pick(0.3, "heuristic_only"))
    )
    worn = F.when(ctx & rad & hf, pick(0.9, "all_three")).when(rad & hf, pick(0.75, "cysill+heuristic")).when(hf, pick(0.5, "heuristic_only")).otherwise(pick(0.1, "disputed"))
    ca, pa = F.when(genuine, a.eqNullSafe(surface)), F.when(F.col("spacy_pos").isNotNull(), b.eqNullSafe(surface))
    agreed = F.when(F.coalesce(ca, no) & F.coalesce(pa, no), "all_three").when(F.coalesce(ca, no), "cysill+heuristic").when(F.coalesce(pa, no), "parser+heuristic").when(ca.isNull() & pa.isNull(), "heuristic_only").otherwise("disputed")
    out = df.withColumn("_c", F.when(F.coalesce(F.col("is_erosion"), no), worn).otherwise(calm)).withColumn("agreement", agreed)
    return out.select("mutation_id", F.col("_c.score").alias("score"), F.col("_c.source").alias("score_source"), "agreement")
