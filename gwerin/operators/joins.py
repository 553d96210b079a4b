"""Lookups and joins in time: tolerance, overlap, nearest, ambiguity-aware lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gwerin import tables as T
from gwerin.functions import text


def lexicon(entries: DataFrame) -> DataFrame:
    """(wordform, n, lemma, tag, morph): one row per wordform; the lemma only if all entries agree on it, tag and morph only of a single entry."""
    out = entries.groupBy("wordform").agg(F.count("*").alias("n"), F.min(F.lower("lemma")).alias("lo"), F.max(F.lower("lemma")).alias("hi"), F.min("tag").alias("tag"), F.min("morph").alias("morph"))
    return out.select("wordform", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("lemma"), F.when(F.col("n") == 1, F.col("tag")).alias("tag"), F.when(F.col("n") == 1, F.col("morph")).alias("morph"))


def resolved(lex: DataFrame) -> DataFrame:
    """The lexicon with mutation_type, gender and number of wordforms of a single reading; a reading of both genders has none."""
    of = lambda name, values: F.try_element_at(text.literal_map(values), F.regexp_extract(F.coalesce("morph", F.lit("")), rf"(?:^|\|){name}=([^|]*)", 1))
    return lex.withColumns({"mutation_type": of("Mutation", T.LEXICON_TYPES), "gender": of("Gender", T.LEXICON_GENDERS), "number": of("Number", T.LEXICON_NUMBERS)})


def look_up(words: DataFrame, col: str, lex: DataFrame) -> DataFrame:
    """The words with lemma and tag: by the word as it is, else with its first letter in upper case.

    The lexicon is joined once, on both spellings; the optimizer broadcasts it only if its measured size allows.
    """
    asked = words.select(F.col(col).alias("w")).where("w is not null").distinct()
    tries = asked.select("w", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("w").alias("form")), F.struct(F.lit(1).alias("rank"), F.when(F.expr("substring(w, 1, 1) <> upper(substring(w, 1, 1))"), F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)"))).alias("form")))).alias("t")).select("w", "t.rank", "t.form")
    found = tries.join(lex, tries["form"] == lex["wordform"]).groupBy("w").agg(F.min_by(F.struct("form", "n", "lemma", "tag", "morph"), "rank").alias("hit"))
    return words.join(found, words[col] == found["w"], "left").drop("w").select(*words.columns, F.col("hit.form").alias("form"), F.col("hit.lemma").alias("lemma"), F.col("hit.tag").alias("tag"))


def _micro(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 1_000_000).cast("long")


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_id: str, tolerance: float) -> DataFrame:
    """First right row, in time and id, of equal keys within the tolerance; (left columns, right_id), nulls where none.

    Equi-join on the keys and a bucket as wide as twice the tolerance: a left row asks two buckets.
    """
    width = max(1, round(2 * tolerance * 1_000_000))
    t = left.withColumn("_t", _micro(left_time))
    probe = t.where("_t is not null").select(*keys, "_t").distinct().withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("_t") - width // 2) / width), F.floor((F.col("_t") + width // 2) / width)))))
    other = right.select(*keys, _micro(right_time).alias("_r"), F.col(right_id)).where("_r is not null").withColumn("_b", F.floor(F.col("_r") / width))
    hit = probe.join(other, [*keys, "_b"]).where(F.abs(F.col("_r") - F.col("_t")) <= width // 2).groupBy(*keys, "_t").agg(F.min_by(right_id, F.struct("_r", right_id)).alias(right_id))
    return t.join(hit, [*keys, "_t"], "left").drop("_t")


def overlap_join(facts: DataFrame, spans: DataFrame, key: str, fact_id: str, width: float = 10.0) -> DataFrame:
    """(fact_id, first_span, spans): spans of the key that overlap each fact's [t0, t1].

    Both sides are cut into buckets; a pair counts in the first bucket that it shares.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    f = facts.where("t0 is not null and t1 is not null").select(key, fact_id, "t0", "t1").withColumn("_b", cells("t0", "t1"))
    s = spans.where("s0 is not null and s1 is not null").select(key, "span_id", "s0", "s1").withColumn("_b", cells("s0", "s1"))
    pairs = f.join(s, [key, "_b"]).where("s0 <= t1 and s1 >= t0").where(F.col("_b") == F.floor(F.greatest("t0", "s0") / width))
    return pairs.groupBy(fact_id).agg(F.min_by("span_id", F.struct("s0", "span_id")).alias("first_span"), F.count("*").alias("spans"))
