"""Words from texts and segments: cutting, clitics, packing and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.functions import text

EDGES = ".,!?;:\"()[]"


def words_of(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, pos, raw, word, boundary): words of a text in order, edges stripped, empty ones left out.

    ``boundary`` says that the word ended with , ; : or a full stop.
    """
    cut = df.select(*keys, F.posexplode(F.split(F.btrim(F.coalesce(F.col(col), F.lit("")), F.lit(" \n\t\r")), "[ \n\t\r]+")).alias("pos", "raw"))
    return cut.withColumns({"word": F.btrim("raw", F.lit(EDGES)), "boundary": F.col("raw").rlike("[,;:.]$")}).where("word <> ''")


def expand_clitics(words: DataFrame, col: str = "word") -> DataFrame:
    """Contractions cut in two, the second part synthetic; X'n becomes X and yn, a bare 'n becomes yn."""
    w = F.lower(F.translate(F.col(col), "‘’", "''"))
    part = lambda x, synthetic: F.struct(x.alias("part"), F.lit(synthetic).alias("synthetic"))
    out = F.when(w == "'n", F.array(part(F.lit("yn"), False))).when(w.endswith("'n") & (F.length(w) > 2), F.array(part(F.expr(f"substring({col}, 1, length({col}) - 2)"), False), part(F.lit("yn"), False)))
    for short, (a, b) in T.CONTRACTIONS.items():
        out = out.when(w == short, F.array(part(F.lit(a), False), part(F.lit(b), True)))
    return words.withColumn("_p", out.otherwise(F.array(part(F.col(col), False)))).select(*words.columns, F.posexplode("_p").alias("part_no", "_q")).select(*words.columns, "part_no", "_q.part", "_q.synthetic")


def drop_reason(n: Column, most: Column, odd: Column, no_speech: Column | None = None, logprob: Column | None = None) -> Column:
    """Why a segment is taken for a hallucination, in order: likely no speech (over 0.6), improbable text (mean log probability under -1), no word,
    one word that fills more than 0.4 of it, or more than 0.3 of it implausible; null keeps it. Unknown probabilities count as 0, and so few as two words are kept.
    """
    zero = F.lit(0.0)
    return (
        F.when(F.coalesce(no_speech if no_speech is not None else zero, zero) > 0.6, "no_speech").when(F.coalesce(logprob if logprob is not None else zero, zero) < -1.0, "improbable")
        .when(n == 0, "no_words").when(n < 3, None).when(most / n > 0.4, "repeats").when(odd / n > 0.3, "implausible")
    )


def hallucinated(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, most, odd, reason) of each segment's words; counted in two steps, so no segment is collected."""
    norm = text.normalize_word(F.col("word"))
    counts = words.select(*keys, norm.alias("w")).where("w <> ''").groupBy(*keys, "w").agg(F.count("*").alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.sum(F.when(text.plausible_letters(F.col("w")) & text.plausible_word(F.col("w")), 0).otherwise(F.col("c"))).alias("odd"))
    return out.withColumn("reason", drop_reason(F.col("n"), F.col("most"), F.col("odd")))


def pack(words: DataFrame, keys: list[str], order: str, col: str, budget: int) -> DataFrame:
    """(keys, order, chunk): greedy chunks of at most ``budget`` characters, each word counting one more, within a segment.

    A fold over one segment's word lengths, which a segment bounds; a longer word has a chunk of its own.
    """
    size = F.struct(F.col(order).alias("o"), (F.length(col) + 1).cast("int").alias("n"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("chunk"), F.expr("cast(array() as array<struct<o:bigint,chunk:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["sum"] > 0) & (acc["sum"] + x["n"] > budget)
        chunk = acc["chunk"] + fresh.cast("int")
        return F.struct(F.when(fresh, x["n"]).otherwise(acc["sum"] + x["n"]).alias("sum"), chunk.alias("chunk"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), chunk.alias("chunk")))).alias("out"))

    folded = words.groupBy(*keys).agg(F.array_sort(F.collect_list(size)).alias("l")).select(*keys, F.explode(F.aggregate("l", start, step, lambda a: a["out"])).alias("x"))
    return folded.select(*keys, F.col("x.o").alias(order), F.col("x.chunk").alias("chunk"))


def lookahead(words: DataFrame, keys: list[str], order: list[str], norm: str, steps: int = 3) -> DataFrame:
    """``target`` and ``ahead``: the next word that is neither a filler nor the same, among the next ``steps``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    target, ahead = F.lit(None).cast("string"), F.lit(steps + 1)
    for k in range(steps, 0, -1):
        nxt = F.lead(norm, k).over(by)
        fits = nxt.isNotNull() & ~nxt.isin(T.FILLERS) & (nxt != F.col(norm))
        target, ahead = F.when(fits, nxt).otherwise(target), F.when(fits, k).otherwise(ahead)
    return words.withColumns({"target": target, "ahead": ahead})


def fingerprint(words: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """sha256 of a segment's words, each followed by a zero character."""
    return words.groupBy(*keys).agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("w")))), lambda x: x["w"]), "\0"), F.lit("\0")), 256).alias("fingerprint"))


def judge_segments(segments: DataFrame, keys: list[str], col: str, no_speech: str | None = None, logprob: str | None = None) -> DataFrame:
    """The segments with ``drop``, why each is taken for a hallucination; null keeps it."""
    counts = hallucinated(words_of(segments, keys, col), keys).drop("reason")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = segments.join(counts, keys, "left")
    reason = drop_reason(n("n"), n("most"), n("odd"), F.col(no_speech) if no_speech else None, F.col(logprob) if logprob else None)
    return out.withColumn("drop", reason).drop("n", "most", "odd")


def local_chunks(words: DataFrame, keys: list[str], word: str, single: DataFrame) -> DataFrame:
    """(keys, chunk, words, resolved): whether the lexicon answers for a whole chunk, each word being of the other language or having a single reading.

    ``words`` has keys and chunk, ``single`` the wordforms (n) of a single reading. A chunk
    with one word more to ask goes to the tagger as a whole.
    """
    norm = text.normalize_word(F.col(word))
    rows = words.withColumn("_n", norm).join(single.select(F.col("n").alias("_n"), F.lit(True).alias("_known")).distinct(), "_n", "left")
    return rows.groupBy(*keys, "chunk").agg(F.count("*").alias("words"), F.bool_and(F.coalesce("_known", F.lit(False)) | text.is_english(F.col("_n"))).alias("resolved"))
