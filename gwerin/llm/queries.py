"""The pN_ queries of this package, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gwerin.llm import bpe, langid, mixing, nearest, runs, sentences, textform, turns
from gwerin.session import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        textform.changed_rows(table(spark, sf_dir, tab), key, text).select(F.lit(tab).alias("tab"), "row_id")
        for tab, key, text in (("words", "word_id", "word"), ("captions", "caption_id", "segment_text"))
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.speaker_turns(table(spark, sf_dir, "chat_utterances"), table(spark, sf_dir, "chat_participants"))
    return found.select("transcript_id", "speaker_code", "first_utterance_id", "turn_lines")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for tab, key in (("segments", "segment_id"), ("captions", "caption_id")):
        one = table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), "video_url", F.col(key).alias("row_id"), "segment_start", "segment_end", "segment_text")
        rows = one if rows is None else rows.unionByName(one)
    found = runs.collapse_runs(rows, ["tab", "video_url"], "segment_start", "segment_end", "segment_text", "row_id")
    return found.where("run_rows >= 2").select("tab", "first_id", "run_rows")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = table(spark, sf_dir, "captions").select("caption_id", "video_url", "segment_start")
    words = table(spark, sf_dir, "words").select("video_url", "word_end", "word_id")
    found = nearest.nearest_match(captions, words, "video_url", "segment_start", "word_end", "word_id", tolerance=0.2)
    return found.where("word_id is not null").select("caption_id", "word_id")


def _language_models(spark: SparkSession, sf_dir: str) -> tuple[langid.Model, langid.Model]:
    """Machines fitted on a bounded sample of labelled document lines and the word list; and those for single words, which must not have seen the list that they are weighed by."""
    sample = langid.sample_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "lang", "doc_id")
    return langid.fit(sample + langid.listed_words(table(spark, sf_dir, "known_words"))), langid.fit([x for x in sample if langid.FAMILY_OF[x[0]] in ("celtic", "germanic")])


def _context_words(spark: SparkSession, sf_dir: str, model: langid.Model) -> tuple[DataFrame, DataFrame]:
    """Delivered facts with a following word, and the language of each of these words."""
    key = ["video_url", "timestamp_span", "trigger_word", "following_word"]
    facts = table(spark, sf_dir, "mutations").select("mutation_id", *key, "is_code_switch").where("following_word is not null").groupBy(*key).agg(F.min_by(F.struct("mutation_id", "is_code_switch"), "mutation_id").alias("f")).select("following_word", "f.*")
    return facts, langid.label_words(facts, model, table(spark, sf_dir, "known_words"), "following_word", "is_code_switch")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, word_model = _language_models(spark, sf_dir)
    unit = lambda name, key, part="0", lang="lang": [F.lit(name).alias("unit"), F.col(key).cast("long").alias("unit_id"), F.expr(part).cast("long").alias("part_no"), F.col(lang).alias("lang")]

    docs = langid.label_documents(table(spark, sf_dir, "documents"), model, "doc_id", "text", "lang").where("lang is not null")
    cases = docs.select("doc_id", "lang", F.coalesce(langid.base_code(F.col("label")) != F.col("lang"), F.lit(True)).alias("wrong"), F.filter("lines", lambda x: x["lang"] != F.col("lang")).alias("others"))
    whole = F.when(F.col("wrong"), F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).cast("long").alias("part_no"), F.col("lang").alias("lang"))))
    lines = F.transform("others", lambda x: F.struct(F.lit("line").alias("unit"), x["part_no"].alias("part_no"), x["lang"].alias("lang")))
    documents = cases.select("doc_id", F.explode(F.concat(F.coalesce(whole, F.array().cast("array<struct<unit:string,part_no:bigint,lang:string>>")), lines)).alias("c"))
    documents = documents.select(F.col("c.unit").alias("unit"), F.col("doc_id").alias("unit_id"), F.col("c.part_no").alias("part_no"), F.col("c.lang").alias("lang"))

    segments = langid.label_segments(table(spark, sf_dir, "segments"), table(spark, sf_dir, "words"), model, "segment_id", "video_url", "segment_start", "segment_text", "language")
    segments = segments.where("lang is not null and not (label <=> lang)").select(*unit("segment", "segment_id"))

    facts, words = _context_words(spark, sf_dir, word_model)
    contexts = facts.withColumn("w", F.lower(textform.consistent_form(F.col("following_word")))).join(words, "w")
    contexts = contexts.where("(lang = 'en' and not (is_code_switch <=> true)) or (lang = 'cy' and is_code_switch <=> true)").select(*unit("context", "mutation_id"))
    return documents.unionByName(segments).unionByName(contexts)


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, unit_id, part_no, lang, confidence) of every document with text, every non-blank line, every segment and every following word."""
    model, word_model = _language_models(spark, sf_dir)
    docs = langid.label_documents(table(spark, sf_dir, "documents"), model, "doc_id", "text", "lang")
    parts = F.concat(F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).cast("long").alias("part_no"), "lang", "confidence")), F.transform("lines", lambda x: F.struct(F.lit("line").alias("unit"), x["part_no"].alias("part_no"), x["lang"].alias("lang"), x["confidence"].alias("confidence"))))
    documents = docs.select(F.col("doc_id").cast("long").alias("unit_id"), F.explode(parts).alias("p")).select("p.unit", "unit_id", "p.part_no", "p.lang", "p.confidence")
    segments = table(spark, sf_dir, "segments").select(F.col("segment_id").alias("unit_id"), langid.identify(F.col("segment_text"), model).alias("p"))
    facts, words = _context_words(spark, sf_dir, word_model)
    contexts = facts.withColumn("w", F.lower(textform.consistent_form(F.col("following_word")))).join(words, "w").select(F.col("mutation_id").alias("unit_id"), F.struct("lang", "confidence").alias("p"))
    flat = lambda df, name: df.select(F.lit(name).alias("unit"), F.col("unit_id").cast("long").alias("unit_id"), F.lit(0).cast("long").alias("part_no"), "p.lang", "p.confidence")
    return documents.unionByName(flat(segments, "segment")).unionByName(flat(contexts, "context"))


def p5_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word_id, lang, confidence) of every row of words: the language of its segment, or English for an English word in Welsh speech; null for a null word."""
    model, word_model = _language_models(spark, sf_dir)
    words = table(spark, sf_dir, "words").select("word_id", "video_url", "segment_start", "word", "language")
    return langid.label_spoken(words, table(spark, sf_dir, "segments"), table(spark, sf_dir, "known_words"), model, word_model)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def _document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sizes = documents.select("doc_id", "source", F.coalesce(langid.base_code(F.col("lang")), F.lit("und")).alias("lang"), F.col("doc_kind").alias("topic"), bpe.token_count(F.col("text")).alias("tokens"))
    return written(sizes)  # five small columns, read several times


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_document_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id").select("doc_id", "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.actual_shares(mixing.mix(_document_sizes(spark, sf_dir), targets, "doc_id"), targets)


def p9_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _document_sizes(spark, sf_dir)
    return mixing.margin_shares(mixing.mix(sizes, table(spark, sf_dir, "mix_targets"), "doc_id"), sizes, "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.split_sentences(documents, "doc_id", "text").select("doc_id", "sent_start", "sent_end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k.split("_")[0][1:].isdigit() and callable(f)}
