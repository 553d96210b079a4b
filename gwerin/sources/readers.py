"""Sources: WebVTT, CHAT, lexicon, tagger strings, segment JSON and fact CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.operators import lexicon_lines

SEGMENTS = "video_id string, seg_id int, start double, end double, text string, no_speech_prob double, avg_logprob double, words array<struct<word:string,start:double,end:double,probability:double>>"


def clock(stamp: Column) -> Column:
    """Seconds of H:MM:SS.mmm or MM:SS.mmm, comma or point."""
    part = lambda i: F.regexp_extract(stamp, r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2}[.,]\d+)\s*$", i)
    return F.coalesce(F.nullif(part(1), F.lit("")).try_cast("double"), F.lit(0.0)) * 3600 + part(2).try_cast("double") * 60 + F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, cue_no, segment_start, segment_end, segment_text) of WebVTT files; a cue that repeats the one before is left out.

    A file is one value: cue files are small. Settings on the timing line and tags are dropped.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*\n")).alias("block_no", "block"))
    timing = r"(?m)^[ \t]*((?:\d+:)?\d{1,2}:\d{1,2}[.,]\d+)[ \t]*-->[ \t]*((?:\d+:)?\d{1,2}:\d{1,2}[.,]\d+)[^\n]*$"
    body = F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*", ""), "<[^<>]*>", "")
    cues = blocks.where(F.col("block").rlike(timing)).select("file_name", "block_no", clock(F.regexp_extract("block", timing, 1)).alias("segment_start"), clock(F.regexp_extract("block", timing, 2)).alias("segment_end"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("segment_text")).where("segment_text <> ''")
    by = Window.partitionBy("file_name").orderBy("block_no")
    kept = cues.withColumn("_p", F.lag("segment_text").over(by)).where(F.col("_p").isNull() | (F.col("_p") != F.col("segment_text")))
    return kept.select("file_name", F.row_number().over(by).alias("cue_no"), "segment_start", "segment_end", "segment_text")


# What CHAT lines hold besides speech: annotations in square brackets, events, pauses, unclear words, and linkers and terminators that begin with a plus sign.
CHAT_ASIDE = r"\[[^\]]*\]|&=\S+|\(\.+\)|\(\d*\.\d*\)|\b(?:xxx|yyy|www)\b|(?:^|\s)\+\S+"
# What they add to words: scope and omission brackets, form markers behind a word, signs before fillers and fragments.
CHAT_INSIDE = r"[()<>]|@[\w:+&]+|&[-~+]"


def clean_chat(col: Column) -> Column:
    """The spoken words of a CHAT line: asides become a blank, what is added to words is cut off, blanks are single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col, CHAT_ASIDE, " "), CHAT_INSIDE, ""), r"\s+", " "))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, speaker, text, utt_start, utt_end) of CHAT files: continuation lines joined, dependent tiers left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("n", "line"))
    by = Window.partitionBy("file_name").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    tiers = rows.withColumn("tier", F.sum(F.col("line").rlike(r"^[*%@]").cast("int")).over(by)).groupBy("file_name", "tier").agg(F.min("n").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.trim(x["line"])), " ").alias("line"))
    said = tiers.where(F.col("line").rlike(r"^\*[^:]+:"))
    bullet = r"\x15?(\d+)_(\d+)\x15?"
    ms = lambda i: F.regexp_extract("line", bullet, i).try_cast("double") / 1000
    out = said.select("file_name", "line_no", F.regexp_extract("line", r"^\*([^:]+):", 1).alias("speaker"), clean_chat(F.regexp_replace(F.regexp_replace("line", r"^\*[^:]+:", ""), bullet, "")).alias("text"), ms(1).alias("utt_start"), ms(2).alias("utt_end"))
    return out.where("text <> ''")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(wordform, lemma, tag, morph, features, reason, offset) of lexicon lines, those that fail with their reason."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lexicon_lines.parse_lines(lines).withColumn("features", lexicon_lines.features(F.col("morph")))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Recognised segments with their words, from JSON; broken records are null rows and left out."""
    return spark.read.schema(SEGMENTS).json(path).where("video_id is not null")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact CSV files below a folder, joined by name, with batch and file.

    Backups, deleted runs and candidates are left out; texts that stand for null are null.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "mutations_*.csv").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    name = F.col("_metadata.file_name")
    p = r"mutations_(\d{8}_\d{6})(?:_(.+))?\.csv$"
    df = df.withColumns({"batch": F.nullif(F.regexp_extract(name, p, 1), F.lit("")), "video_file": F.nullif(F.regexp_extract(name, p, 2), F.lit("")), "_path": F.col("_metadata.file_path")})
    df = df.where(~F.col("_path").contains("_deleted") & ~F.col("_path").rlike(r"_(precaption_backup|rerun_candidate)\.csv$")).drop("_path")
    return df.select(*[F.when(F.col(c).isin(T.NULLS), None).otherwise(F.col(c)).alias(c) for c in df.columns])


def parse_tagged(col: Column) -> Column:
    """Array of (token, pos, mutation, gender) of a tagger's 'token/POS/MUT' string; punctuation and short items are left out."""
    types = F.create_map(*[F.lit(x) for p in T.TAG_TYPES.items() for x in p])
    items = F.filter(F.transform(F.split(F.trim(F.coalesce(col, F.lit(""))), r"\s+"), lambda x: F.split(x, "/")), lambda p: (F.size(p) >= 2) & ~F.lower(p[1]).isin("punct", "eos", "space") & (p[0] != ""))
    gender = lambda pos: F.when(pos.rlike("^(N|PRON|CARD|ORD)F$"), "feminine").when(pos.rlike("^(N|PRON|CARD|ORD)M$"), "masculine")
    return F.transform(items, lambda p: F.struct(p[0].alias("token"), p[1].alias("pos"), F.try_element_at(types, F.try_element_at(p, F.lit(3))).alias("mutation"), gender(p[1]).alias("gender")))


def phrase(spark: SparkSession, text: str) -> DataFrame:
    """(i, word, word_start, word_end, confidence): the words of a typed phrase at made-up times."""
    one = spark.createDataFrame([(text,)], "t string")
    return one.select(F.posexplode(F.regexp_extract_all("t", F.lit(r"(?U)(\b[\w'’\-]+\b)"), F.lit(1))).alias("i", "word")).select("i", "word", F.col("i").cast("double").alias("word_start"), (F.col("i") + 0.5).alias("word_end"), F.lit(1.0).alias("confidence"))
