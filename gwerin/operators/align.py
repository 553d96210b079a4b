"""Alignment of two token streams of a video, and what it says of a fact."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin.functions import text
from gwerin.operators.carry import last_before
from gwerin.operators.joins import tolerance_join
from gwerin.session import written

BLOCK = 480.0  # seconds of a video that are aligned at a time
MARGIN = 120.0  # seconds on either side that are aligned along with them, and left to the neighbours
PIECES = "video_url string, block bigint, w_idx bigint, word_id bigint, word string, caption_word string, tag string, timing_ok boolean, run_len bigint, c_idx bigint, run bigint"


def stream(df: DataFrame, key: str, time: str, col: str, order: list[str], at: str | None = None) -> DataFrame:
    """(video_url, home, o, t, at, id, word): normalised tokens of a text column, those of a row at the row's time; ``at`` is the time to compare, if another."""
    when = F.coalesce(F.col(at or time), F.col(time)).cast("double")
    cut = df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(col).isNotNull()).select(F.col(key).alias("video_url"), F.col(time).cast("double").alias("t"), when.alias("at"), F.col(order[0]).alias("id"), F.struct(*order).alias("o"), F.posexplode(F.split(F.col(col), r"[ \n\t\r]+")).alias("p", "raw"))
    return cut.select("video_url", F.floor(F.col("t") / BLOCK).alias("home"), F.struct("t", "o", "p").alias("o"), "t", "at", "id", text.normalize_word(F.col("raw")).alias("word")).where("word <> ''")


def _numbered(s: DataFrame) -> DataFrame:
    """The stream with each token's number in its video, from 0: blocks are counted, then added up, one row a block."""
    before = Window.partitionBy("video_url").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    base = s.groupBy("video_url", "home").agg(F.count("*").alias("n")).select("video_url", "home", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = F.row_number().over(Window.partitionBy("video_url", "home").orderBy("o"))
    return s.withColumn("here", here).join(base, ["video_url", "home"]).withColumn("rank", F.col("base") + F.col("here") - 1)


def _windows(s: DataFrame) -> DataFrame:
    """Each token once for every block within ``MARGIN`` of it; ``core`` in its own."""
    reach = F.sequence(F.floor((F.col("t") - MARGIN) / BLOCK), F.floor((F.col("t") + MARGIN) / BLOCK))
    return s.select("video_url", F.explode(reach).alias("block"), "home", "rank", "id", "word", F.col("at").alias("t")).withColumn("core", F.col("block") == F.col("home"))


def _one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Evidence for the core tokens of a block; ``run`` and ``run_len`` number and measure the runs within it."""
    left = left.sort_values("rank")
    right = right.sort_values("rank")
    cols = [x.split()[0] for x in PIECES.split(", ")]
    core = left["core"].tolist() if "core" in left else [True] * len(left)
    if not any(core):
        return pd.DataFrame(columns=cols)
    a, b, ta, tb = left["word"].tolist(), right["word"].tolist(), left["t"].tolist(), right["t"].tolist()
    no = left["rank"].tolist() if "core" in left else list(range(len(left)))
    ids = left["id"].tolist() if "id" in left else [None] * len(left)
    nos = right["rank"].tolist() if "core" in right else list(range(len(right)))
    rows, sizes, last = [], [], None
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for i in range(i1, i2):
            if not core[i]:
                continue
            j = j1 + i - i1
            if last != i1:
                last = i1
                sizes.append(0)
            sizes[-1] += 1
            if tag == "delete" or j >= j2:
                rows.append((no[i], ids[i], a[i], None, tag if tag == "delete" else "replace_unmatched_length", None, None, len(sizes) - 1))
            else:
                rows.append((no[i], ids[i], a[i], b[j], tag, abs(ta[i] - tb[j]) <= 15.0, nos[j], len(sizes) - 1))
    out = pd.DataFrame(rows, columns=["w_idx", "word_id", "word", "caption_word", "tag", "timing_ok", "c_idx", "run"])
    out["c_idx"] = out["c_idx"].astype("Int64")
    out["run_len"] = [sizes[r] for r in out["run"]]
    out.insert(0, "block", left["block"].iat[0])
    out.insert(0, "video_url", left["video_url"].iat[0])
    return out[cols]


def _whole_runs(pieces: DataFrame) -> DataFrame:
    """Runs measured over the whole video: a block's first run goes on from the block before if both are unmatched or their counterparts adjoin."""
    end = F.struct((F.col("tag") == "equal").alias("eq"), "c_idx", "run_len")
    per = pieces.groupBy("video_url", "block").agg(F.min_by(end, "w_idx").alias("first"), F.max_by(end, "w_idx").alias("last"), F.max("run").alias("runs"))
    prev = F.lag("last").over(Window.partitionBy("video_url").orderBy("block"))
    joined = F.coalesce((~prev["eq"] & ~F.col("first.eq")) | (prev["eq"] & F.col("first.eq") & (F.col("first.c_idx") == prev["c_idx"] + 1)), F.lit(False))
    head = F.struct(F.lit(0).alias("side"), (~joined).cast("long").alias("new"), F.col("first.run_len").alias("len"))
    tail = F.struct(F.lit(1).alias("side"), F.lit(1).cast("long").alias("new"), F.col("last.run_len").alias("len"))
    parts = per.withColumn("x", F.array(head, tail)).select("video_url", "block", "runs", F.explode(F.when(F.col("runs") > 0, F.col("x")).otherwise(F.slice("x", 1, 1))).alias("x"))
    parts = parts.select("video_url", "block", "runs", "x.*").withColumn("g", F.sum("new").over(Window.partitionBy("video_url").orderBy("block", "side")))
    parts = parts.withColumn("whole", F.sum("len").over(Window.partitionBy("video_url", "g")))
    ends = parts.groupBy("video_url", "block").agg(F.max("runs").alias("runs"), F.max(F.when(F.col("side") == 0, F.col("whole"))).alias("head"), F.max(F.when(F.col("side") == 1, F.col("whole"))).alias("tail"))
    size = F.when(F.col("run") == 0, F.col("head")).when(F.col("run") == F.col("runs"), F.col("tail")).otherwise(F.col("run_len"))
    return pieces.join(ends, ["video_url", "block"]).withColumn("run_len", size)


def align_streams(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Evidence for each spoken token of a video: its counterpart in the other stream, if any.

    The longest-matching-block alignment is sequential, so it runs as a grouped map, over
    blocks of ``BLOCK`` seconds of a video: a long video isn't one group. A block is aligned
    with its surroundings, so that none of its words lies at an edge.
    """
    sides = [_windows(_numbered(s)) for s in (words, cues)]
    left = sides[0].select("video_url", "block", "core", "rank", "id", "word", "t")
    right = sides[1].select("video_url", "block", "core", "rank", "word", "t")
    pieces = written(left.groupBy("video_url", "block").cogroup(right.groupBy("video_url", "block")).applyInPandas(_one, PIECES))  # read twice
    return _whole_runs(pieces).select("video_url", "block", "w_idx", "word_id", "word", "caption_word", "tag", "timing_ok", "run_len")


def _forward(words: list[str], tokens: list[str]) -> list[int | None]:
    """Number of each word's token, going only forward and five tokens ahead at most."""
    at, out = 0, []
    for w in words:
        hit = next((k for k in range(at, min(at + 5, len(tokens))) if tokens[k] == w or tokens[k] in w or w in tokens[k]), None)
        out.append(hit)
        at = at if hit is None else hit + 1
    return out


def align_with_gaps(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(segment_id, i, word, token, token_no): exactly one row per word, null where nothing near matches.

    One row per segment, which bounds both lists; many segments share an Arrow batch, as
    a grouped map would pay its overhead once a segment.
    """

    @F.arrow_udf("array<int>")
    def pairs(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_forward(a or [], b or []) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.list_(pa.int32()))

    lists = lambda df, name: df.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias(name))
    both = lists(words, "a").join(lists(tokens, "b"), "segment_id", "left").withColumn("hit", pairs(F.col("a.word"), F.col("b.word")))
    each = both.select("segment_id", "b", F.explode(F.arrays_zip("a", "hit")).alias("x"))
    return each.select("segment_id", F.col("x.a.i").alias("i"), F.col("x.a.word").alias("word"), F.try_element_at("b", F.col("x.hit") + 1)["word"].alias("token"), F.col("x.hit").cast("bigint").alias("token_no"))


def match_confidence(caption_word: Column, timing_ok: Column, run_len: Column) -> Column:
    return F.when(caption_word.isNull(), None).when(~F.coalesce(timing_ok, F.lit(True)), "rejected").when(run_len >= 3, "high").otherwise("low")


def verdict(word: Column, caption_word: Column, change: Column, initial: Column, found: Column, tag: Column, timing_ok: Column) -> Column:
    """What the other transcript says of a fact, the first that applies.

    ``change`` says which change makes the caption's word of the fact's lemma, ``initial``
    that the two words differ in their beginning only, ``found`` which change the fact's
    word shows, none or null if none.
    """
    theirs, ours = change != "radical", F.coalesce(found, F.lit("none")) != "none"
    return (
        F.when(word.isNull(), "no_alignment").when(caption_word.isNull(), F.when(tag == "delete", "caption_omits_word").otherwise("no_alignment")).when(~F.coalesce(timing_ok, F.lit(True)), "alignment_timing_implausible")
        .when(word == caption_word, "confirmed_match").when(change.isNull(), "caption_word_not_lemma_candidate")
        .when(initial, F.when(theirs & ~ours, "confirms_erosion").when(~theirs & ours, "caption_disputes_mutation").when(theirs, "confirms_mutation_present").otherwise("confirms_no_mutation"))
        .otherwise("caption_disagrees_non_initial")
    )


FLAGGED = ["alignment_timing_implausible", "caption_disputes_mutation", "caption_disagrees_non_initial"]


def corroborate(facts: DataFrame, words: DataFrame, evidence: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The facts with caption_word, caption_tag, match_confidence, verdict and flagged, from the aligned transcripts.

    ``facts`` has mutation_id, video_url, timestamp_span, following_word, lemma and
    mutation_found; ``words`` video_url, word_id, word and word_end; ``evidence`` is that of
    ``align_streams``. A fact is that of the first spoken word that reads the same and ends
    within the tolerance of its end. Without a time there is no_timestamp, without a
    word no_alignment.
    """
    end = text.parse_span(F.col("timestamp_span"))[1]
    n = text.normalize_word(F.col("following_word"))
    asked = facts.withColumns({"_end": end, "_n": n})
    said = words.select("video_url", "word_id", text.normalize_word(F.col("word")).alias("_n"), "word_end")
    hit = tolerance_join(asked, said, ["video_url", "_n"], "_end", "word_end", "word_id", tolerance)
    first = evidence.where("word_id is not null").groupBy("video_url", "word_id").agg(F.min_by(F.struct(F.col("word").alias("w"), "caption_word", "tag", "timing_ok", "run_len"), "w_idx").alias("_e"))
    out = hit.join(first, ["video_url", "word_id"], "left")
    out = out.withColumns({"caption_word": F.col("_e.caption_word"), "_lemma": F.coalesce(F.nullif(text.normalize_word(F.col("lemma")), F.lit("")), F.col("_n"))})
    out = out.withColumns({"_change": text.change_of(F.col("caption_word"), F.col("_lemma")), "_initial": text.differs_only_in_initial(F.col("_n"), F.col("caption_word"))})
    e = lambda c: F.col(f"_e.{c}")
    kind = verdict(F.when(F.col("_e").isNotNull(), F.col("_n")), F.col("caption_word"), F.col("_change"), F.col("_initial"), F.col("mutation_found"), e("tag"), e("timing_ok"))
    out = out.withColumns({"verdict": F.when(F.col("_end").isNull(), "no_timestamp").otherwise(kind), "caption_tag": e("tag"), "match_confidence": match_confidence(F.col("caption_word"), e("timing_ok"), e("run_len"))})
    return out.withColumn("flagged", F.col("verdict").isin(FLAGGED)).drop("_end", "_n", "_e", "_lemma", "_change", "_initial")


def agreement(evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, tokens, agreeing, share, and a count of each tag): word-level agreement of two aligned transcripts, equal and plausible in time."""
    tags = ["equal", "replace", "delete", "replace_unmatched_length"]
    agrees = (F.col("tag") == "equal") & F.coalesce(F.col("timing_ok"), F.lit(True))
    out = evidence.groupBy(*by).agg(F.count("*").alias("tokens"), F.count_if(agrees).alias("agreeing"), *[F.count_if(F.col("tag") == t).alias(t) for t in tags])
    return out.withColumn("share", F.round(F.col("agreeing") / F.col("tokens"), 6))


def chat_stream(lines: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Tokens of CHAT lines as a stream to align; a line without a time has the last end before it, else 0. The order is that of the lines."""
    rows = lines.where(F.col(key).isNotNull() & F.col("line_no").isNotNull()).select(F.col(key).cast("string").alias(key), F.col("line_no").cast("bigint").alias("line_no"), "text", F.col("utt_start").cast("double").alias("s"), F.col("utt_end").cast("double").alias("e"))
    rows = last_before(rows.withColumn("_b", F.floor(F.col("line_no") / 2000)).withColumn("e2", F.coalesce("e", "s")), [key], "_b", ["line_no"], "e2", "before")
    rows = rows.withColumn("t", F.coalesce("s", "before", F.lit(0.0)))
    return stream(rows, key, "t", "text", ["line_no"])
