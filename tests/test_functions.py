"""Scalar functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from gwerin.functions import text


def run(spark, fn, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("word, want", [("“Mae'n”", "maeyn"), ("'n", "n"), ("i’r", "i"), (None, ""), ("", ""), ("Hwyl!", "hwyl")])
def test_normalize(spark, word, want):
    assert run(spark, text.normalize_word, word) == want


@pytest.mark.parametrize("word, want", [("nghath", "ngh"), ("ffrind", "ff"), ("tsips", "ts"), ("jam", "j"), ("afal", "a"), ("", "")])
def test_cluster(spark, word, want):
    assert run(spark, text.initial_cluster, word) == want


@pytest.mark.parametrize("word, want", [("gath", "soft"), ("mhlant", "nasal"), ("phlant", "aspirate"), ("mawr", "nasal"), ("cath", None), (None, None)])
def test_surface(spark, word, want):
    assert run(spark, text.surface_type, word) == want


@pytest.mark.parametrize("radical, kind, want", [("cath", "soft", "gath"), ("gardd", "soft", "ardd"), ("llaw", "soft_limited", None), ("pen", "nasal", "mhen"), ("g", "soft", None)])
def test_forward(spark, radical, kind, want):
    assert run(spark, lambda c: text.forward_form(c, kind), radical) == want


def test_reverse_is_cluster_aware(spark):
    assert run(spark, text.reverse_candidates, "ffrind") == []
    assert "pen" in run(spark, text.reverse_candidates, "ben")
    assert "gardd" in run(spark, text.reverse_candidates, "ardd")


@pytest.mark.parametrize("word, ok", [("töii", False), ("tõii", False), ("děkuji", False), ("ţară", False), ("tŷ", True), ("llên", True), ("café", True), ("cwmnïau", True)])
def test_letters(spark, word, ok):
    assert run(spark, text.plausible_letters, word) is ok


@pytest.mark.parametrize("word, ok", [("bhan", False), ("qwer", False), ("gerioed", True), ("bennol", True)])
def test_words(spark, word, ok):
    assert run(spark, text.plausible_word, word) is ok


@pytest.mark.parametrize("value, want", [("yes", True), ("1", True), ("True", True), ("no", False), ("0", False), ("", None), (None, None)])
def test_booleans(spark, value, want):
    assert run(spark, text.to_bool, value) is want


def test_agreement_names(spark):
    assert [run(spark, text.agreement, v) for v in ("True", "False", "n/a", "all_three", None)] == ["cysill+heuristic", "disputed", None, "all_three", None]


def test_slug(spark):
    assert run(spark, text.slug, "Llif byw: tŷ mawr!") == "Llif_byw_tŷ_mawr"
    assert run(spark, text.slug, None) == "untitled"


def test_highlight(spark):
    assert run(spark, text.highlight, "Mae y tŷ yma", "TŶ") == "Mae y [tŷ] yma"
    assert run(spark, text.highlight, "Mae y tŷ", None) == "Mae y tŷ"


def test_highlight_words_marks_every_text(spark, sf, tmp_path):
    import re
    import unicodedata

    import __spark_entry__ as entry

    part = lambda c: c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"

    def want(s):
        free = lambda k: not 0 <= k < len(s) or not part(s[k])
        return re.sub(r"(?i)yn|y|the", lambda m: f"[{m[0]}]" if free(m.start() - 1) and free(m.end()) else m[0], s)

    texts = ["Mae y tŷ yn ŵyn", "ŷ y â", "‘y’ • YN, y\u0302 yŷ ŷyn", "\x15y\x15 the-y ynâ âyn", "y y yn", "", None]
    made = spark.createDataFrame(list(enumerate(texts)), "utterance_id long, text string")
    given = spark.read.parquet(f"{sf}/chat_utterances.parquet").where("text is not null").select(F.col("utterance_id") + 100, "text")
    made.union(given).write.parquet(str(tmp_path / "chat_utterances.parquet"))
    rows = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "chat_utterances.parquet")).where("text is not null").collect()}
    got = {r["utterance_id"]: r["marked"] for r in entry.queries()["highlight_words"](spark, str(tmp_path)).collect()}
    assert got == {k: want(v) for k, v in rows.items()}
