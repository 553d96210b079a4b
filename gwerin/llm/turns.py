"""Speaker turns from the lines of transcripts (problem 2).

Labels are normalised against the rosters: exact by code, name or role of the own
transcript, then by code or name of all transcripts; labels that still match nothing are
blocked by a phonetic key and settled by optimal assignment within the block. Annotations,
hesitations and time marks are stripped, lines without a spoken word are left out, the rest
is ordered by time and runs of one speaker become turns. Whatever is carried from line to
line goes over buckets of lines, so one long transcript does not end in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin.llm.runs import aggregate_runs
from gwerin.llm.textform import consistent_form
from gwerin.operators.assignment import assign
from gwerin.operators.carry import carry_blocks
from gwerin.session import written

# What is not speech in angle brackets, and marks for what can't be understood.
SOUNDS = ["music", "laughter", "laughs", "laugh", "laughing", "applause", "noise", "silence", "pause", "singing", "song", "cough", "coughs", "coughing", "sigh", "sighs", "breath", "inaudible", "unintelligible", "crosstalk", "beep", "cerddoriaeth", "chwerthin", "sŵn", "tawelwch", "canu", "cymeradwyaeth", "peswch", "saib"]
UNCLEAR = "xxx|yyy|www|xx|yy"
HESITATION = r"(?:y+m+|e+r+m*|u+m+|u+h+|a+h+|e+h+|h*m+|m+h+m+|h+m+)"
# First time mark of a text: •start_end• in ms, [h:m:s] or (s).
MARKS = [r"•?\b(\d{1,12})_(\d{1,12})\b•?", r"[\[(<](\d{1,3}):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)[\])>]", r"[\[(<](\d{1,3}):(\d{1,2}(?:[.,]\d+)?)[\])>]", r"[\[(](\d+(?:[.,]\d+)?) ?s(?:ec)?[\])]"]
LINES = 2000  # lines of a transcript that are walked in one task
SECONDS = 3600.0


def _text(col: Column) -> Column:
    """Consistent form, with the control mark of time bullets kept as a bullet."""
    return consistent_form(F.translate(F.coalesce(col, F.lit("")), "\x15", "•"))


def mark_time(text: Column) -> Column:
    """Start in seconds of the first kind of time mark that the text has, else null."""
    num = lambda p, i: F.expr("try_cast(null as double)") if p is None else F.regexp_replace(F.regexp_extract(text, p, i), ",", ".").try_cast("double")
    ms, hms, m_s, sec = MARKS
    return F.coalesce(num(ms, 1) / 1000, num(hms, 1) * 3600 + num(hms, 2) * 60 + num(hms, 3), num(m_s, 1) * 60 + num(m_s, 2), num(sec, 1))


def drop_marks(text: Column) -> Column:
    for p in MARKS:
        text = F.regexp_replace(text, p, " ")
    return text


def label_key(label: Column) -> Column:
    """Letters and digits of a label in lower case, without 'Speaker' and '(cont.)'."""
    s = F.lower(F.coalesce(label, F.lit("")))
    s = F.regexp_replace(s, r"[(\[]\s*cont(?:inued|\.)?\s*[)\]]|\bcont\.", " ")
    s = F.regexp_replace(s, r"^\W*(?:speaker|siaradwr|spk)\b[ .:_-]*(?=\w)", "")
    return F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]", "")


HEAD = r"^\s*[-–—•>]*\s*(?:\[([^\[\]:]{1,40})\]\s*[-–—:>]?\s*|\*?([\p{L}][\p{L}\p{M}\p{N}.' _-]{0,40}?)\s*(?:\(cont\.?\)\s*)?(?::|>+)\s*)"


def clean_text(text: Column) -> Column:
    """Spoken words only: no annotations, pauses, unclear marks or hesitations; shortened words completed."""
    s = F.regexp_replace(text, r"@[\p{L}]+(?::[\p{L}+&]+)*", "")
    s = F.regexp_replace(s, r"\(\([^()]*\)\)|\{[^{}]*\}|\[[^\[\]]*\]", " ")
    s = F.regexp_replace(s, r"(?i)<\s*(?:" + "|".join(SOUNDS) + r")\b[^<>]*>", " ")
    s = F.regexp_replace(s, r"\*[^*]{1,40}\*|[♪♫♬♩]", " ")
    s = F.regexp_replace(s, r"&[=~+-]?[^\s]+", " ")
    s = F.regexp_replace(s, r"\+[^\s\p{L}\p{N}]+", " ")
    s = F.regexp_replace(s, r"\(\.+\)|\(\d*\.\d*\)", " ")
    s = F.regexp_replace(s, r"[<>]|(?<=\p{L})[()]|[()](?=\p{L})", "")
    s = F.regexp_replace(s, r"(?i)(?<![\p{L}\p{M}\p{N}'-])(?:" + UNCLEAR + r")(?![\p{L}\p{M}\p{N}'-])", " ")
    joined = r"(?:(?:[yemh]-)+)?" + HESITATION
    s = F.regexp_replace(s, r"(?i)(?<![\p{L}\p{M}\p{N}'-])" + joined + r"(?![\p{L}\p{M}\p{N}'-])[.,…]*", " ")
    s = F.regexp_replace(s, r"\s+([.,!?;:…])", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def phonetic_key(key: Column) -> Column:
    """Rough sound of a label: mutated and doubled consonants as one, no vowels but a first one."""
    for pattern, to in ((r"ph|ff", "f"), (r"th|dd", "t"), (r"ch|kh", "c"), (r"ngh|ng", "g"), (r"ll|rh|l", "l"), (r"[ckq]", "c"), (r"[sz]", "s"), (r"[bp]", "b"), (r"[dt]", "t"), (r"[mn]", "n"), (r"[vf]", "f")):
        key = F.regexp_replace(key, pattern, to)
    key = F.concat(F.substring(key, 1, 1), F.regexp_replace(F.substring(key, 2, 1000), r"[aeiouwyhâêîôûŵŷáéíóúàèìòùäëïöü]", ""))
    return F.substring(F.regexp_replace(key, r"(.)\1+", "$1"), 1, 2)


def _distance(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def _settle(block: pd.DataFrame) -> pd.DataFrame:
    """Labels of one block against its participants: one to one first, what is left over to its nearest."""
    labels = sorted(block["key"].unique())
    forms = block.drop_duplicates(["form", "code"]).sort_values(["code", "form"])
    codes = sorted(forms["code"].unique())
    cost = np.array([[min(_distance(x, f) for f in forms.loc[forms["code"] == c, "form"]) for c in codes] for x in labels])
    to = assign(cost)
    to = np.where(to < 0, cost.argmin(1), to)
    rows = [(block["t"].iat[0], x, codes[j]) for x, j, i in zip(labels, to, range(len(labels))) if cost[i, j] <= 0.34]
    return pd.DataFrame(rows, columns=["t", "key", "code"])


def roster(participants: DataFrame, transcript: str, code: str, name: str, role: str) -> DataFrame:
    """(t, key, code) of each transcript: codes count before names before roles; a name or role of two participants names none."""
    forms = F.array(*[F.struct(F.lit(i).alias("rank"), label_key(consistent_form(F.col(c))).alias("key")) for i, c in enumerate((code, name, role))])
    long = participants.where(F.col(code).isNotNull()).select(F.col(transcript).alias("t"), F.col(code).alias("code"), F.explode(forms).alias("f")).select("t", "code", "f.*").where("key <> ''")
    best = long.groupBy("t", "key", "rank").agg(F.min("code").alias("code"), F.max("code").alias("other")).where("code = other").groupBy("t", "key").agg(F.min_by("code", "rank").alias("code"))
    return best


def resolve_labels(labels: DataFrame, participants: DataFrame, transcript: str, code: str, name: str, role: str) -> DataFrame:
    """(t, key) -> (t, key, code) for all distinct labels that name a participant."""
    own = written(roster(participants, transcript, code, name, role))
    exact = written(labels.join(own, ["t", "key"], "left"))
    rest = exact.where("code is null").select("t", "key")
    everywhere = own.groupBy("key").agg(F.min("code").alias("code"), F.max("code").alias("other")).where("code = other").select("key", "code")
    listed = participants.select(F.col(transcript).alias("t"), F.col(code).alias("code")).distinct()
    known = rest.join(everywhere, "key").join(listed, ["t", "code"], "left_semi").select("t", "key", "code")
    rest = rest.join(known, ["t", "key"], "left_anti")
    blocks = rest.where(F.length("key") >= 2).withColumn("p", phonetic_key(F.col("key"))).join(own.select("t", F.col("key").alias("form"), "code", phonetic_key(F.col("key")).alias("p")), ["t", "p"])
    near = blocks.groupBy("t", "p").applyInPandas(lambda b: _settle(b), "t bigint, key string, code string")
    return exact.where("code is not null").select("t", "key", "code").unionByName(known).unionByName(near)


def speaker_turns(lines: DataFrame, participants: DataFrame) -> DataFrame:
    """Turns: (transcript_id, speaker_code, first_utterance_id, turn_lines, turn_start, turn_end, text).

    ``text`` is the clean text of the turn's lines in order.

    Lines that agree in (transcript_id, line_no) count once, under the lowest utterance_id;
    a line without transcript or line number can't be placed and is left out. Null and
    empty texts hold no spoken word. A label that names no participant gives a null code,
    and such lines make turns of their own kind. Further columns are ignored.
    """
    text = _text(F.col("text"))
    rows = (
        lines.where("transcript_id is not null and line_no is not null")
        .groupBy("transcript_id", "line_no").agg(F.min_by(F.struct("utterance_id", "speaker", "text", "utt_start", "utt_end"), "utterance_id").alias("u"))
        .select(F.col("transcript_id").cast("bigint").alias("t"), F.col("line_no").cast("bigint").alias("n"), "u.*")
        .withColumn("text", text).withColumn("label", label_key(_text(F.col("speaker"))))
        .withColumn("at", F.coalesce(F.col("utt_start").cast("double"), mark_time(F.col("text")))).withColumn("body", drop_marks(F.col("text")))
    )
    head = F.coalesce(F.nullif(F.regexp_extract("body", HEAD, 1), F.lit("")), F.regexp_extract("body", HEAD, 2))
    rows = written(rows.withColumn("head", label_key(head)).select("t", "n", "utterance_id", "utt_end", "label", "head", "at", "body"))  # put into form once, read three times
    asked = rows.select("t", F.explode(F.array("label", "head")).alias("key")).where("key <> ''").distinct()
    codes = written(resolve_labels(asked, participants, "transcript_id", "speaker_code", "speaker_name", "speaker_role"))
    rows = rows.join(codes.select("t", F.col("key").alias("label"), F.col("code").alias("by_label")), ["t", "label"], "left")
    rows = rows.join(codes.select("t", F.col("key").alias("head"), F.col("code").alias("by_head")), ["t", "head"], "left")
    body = F.when(F.col("by_head").isNotNull(), F.regexp_replace("body", HEAD, "")).otherwise(F.col("body"))
    rows = rows.withColumn("clean", clean_text(body)).withColumn("kept", F.col("clean").rlike(r"[\p{L}\p{N}]"))
    # a label of its own, even one that names nobody, ends the speaker before
    own = F.when(F.col("by_label").isNotNull() | F.col("by_head").isNotNull() | (F.col("label") != ""), F.struct(F.coalesce("by_label", "by_head").alias("c")))
    rows = rows.select("t", "n", "utterance_id", "at", F.col("utt_end").cast("double").alias("till"), "clean", "kept", own.alias("own"), F.when(F.col("kept") & F.col("at").isNotNull(), F.struct(F.col("at").alias("a"), F.col("n").alias("n"))).alias("anchor"))

    rows = written(rows)  # compact, and read several times below

    # carry speaker and time down the lines
    rows = rows.withColumn("b", F.floor(F.col("n") / LINES))
    by = Window.partitionBy("t", "b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_own", F.last("own", ignorenulls=True).over(by)).withColumn("_anchor", F.last("anchor", ignorenulls=True).over(by))
    ends = rows.groupBy("t", "b").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("n"))).alias("own"), F.max_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("n"))).alias("anchor"))
    ends = carry_blocks(carry_blocks(ends, ["t"], "b", "own", "own_before"), ["t"], "b", "anchor", "anchor_before").select("t", "b", "own_before", "anchor_before")
    rows = here.join(ends, ["t", "b"]).where("kept").select(
        "t", "n", "utterance_id", "at", "till", "clean", F.coalesce("_own", "own_before")["c"].alias("code"), F.coalesce("_anchor", "anchor_before", F.struct(F.lit(float("-inf")).alias("a"), F.lit(-1).cast("bigint").alias("n"))).alias("anchor")
    )
    rows = rows.select("*", F.col("anchor.a").alias("a"), F.col("anchor.n").alias("an")).withColumn("w", F.greatest(F.lit(-1.0), F.floor(F.col("a") / SECONDS)))
    runs = aggregate_runs(
        rows, "t", "w", ["a", "an", "n"], ["code"], lambda row, before: before.isNotNull() & row["code"].eqNullSafe(before["code"]), F.struct("utterance_id", "code"),
        {"turn_start": (F.col("at"), "min"), "turn_end": (F.coalesce("till", "at"), "max"), "text": (F.col("clean"), "join")},
    )
    return runs.select(F.col("t").alias("transcript_id"), F.col("first.code").alias("speaker_code"), F.col("first.utterance_id").alias("first_utterance_id"), F.col("run_rows").alias("turn_lines"), "turn_start", "turn_end", "text")
