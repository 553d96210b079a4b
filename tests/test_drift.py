"""Schema drift against a plain reading of the same files."""

import json

from gwerin.operators import drift

SCHEMA = "rec_id long, series string, file_name string, arrived_at timestamp, row_no int, record string"


def table(spark, files):
    rows, n = [], 0
    for series, stamp, records in files:
        for k, r in enumerate(records, 1):
            n += 1
            rows.append((n, series, f"mutations_{stamp}_{series}.json", None, k, r if isinstance(r, str) or r is None else json.dumps(r)))
    return spark.createDataFrame(rows, SCHEMA)


def fact(i, **more):
    return {"video_url": "u", "timestamp": f"{i}s", **more}


def changes(spark, files):
    return sorted((r["file_name"][10:18], r["change"], r["old_name"], r["new_name"]) for r in drift.changes(table(spark, files)).collect())


def test_changes_of_each_kind(spark):
    files = [
        ("s", "20250101_000000", [fact(1, words=5, ok=True, gone=1), fact(2, words=7, ok=False, gone=1)]),
        ("s", "20250102_000000", [fact(1, word_count=5, ok="true", new=None), fact(2, word_count=7, ok=None, new=None)]),
        ("s", "20250104_000000", [fact(1, word_count=5.5, ok=None, new=3), fact(3, word_count=7, ok=None, new=None)]),
        ("s", "20250103_000000", [fact(1, word_count=None, ok="x", new=None)]),
        ("t", "20250102_000000", [fact(1, other=1)]),
    ]
    assert changes(spark, files) == [("20250102", "added", "", "new"), ("20250102", "removed", "gone", ""), ("20250102", "renamed", "words", "word_count"), ("20250102", "type", "ok", "ok"), ("20250104", "type", "word_count", "word_count")]


def test_two_candidates_are_told_apart(spark):
    a = [fact(i, a=i, b=i % 2 == 0) for i in range(6)]
    b = [fact(i, x=i % 2 == 0, y=i) for i in range(6)]
    assert changes(spark, [("s", "20250101_000000", a), ("s", "20250102_000000", b)]) == [("20250102", "renamed", "a", "y"), ("20250102", "renamed", "b", "x")]


def test_broken_null_and_repeated_records(spark):
    files = [("s", "20250101_000000", [fact(1, a=1), None, "{broken", "[1]"]), ("s", "20250102_000000", [fact(1, a=1, n={"x": 1})])]
    df = table(spark, files)
    again = df.withColumn("rec_id", df["rec_id"] + 100)
    got = sorted((r["change"], r["new_name"]) for r in drift.changes(df.unionByName(again)).collect())
    assert got == [("added", "n")]
    rows = {r["rec_id"]: r for r in drift.unify(df.unionByName(again)).collect()}
    assert len(rows) == 5 and rows[1]["a"] == 1 and [rows[k]["broken"] for k in (1, 2, 3, 4, 5)] == [False, True, True, True, False]


def test_rename_chains_reach_the_first_name(spark):
    files = [("s", f"2025010{k}_000000", [fact(i, **{name: i}) for i in range(3)]) for k, name in enumerate(("words", "wordCount", "n_words", "n_words"), 1)]
    df = drift.unify(table(spark, files))
    assert df.columns == ["rec_id", "series", "file_name", "row_no", "broken", "timestamp", "video_url", "words", "rest"]
    assert sorted(r["words"] for r in df.collect()) == sorted([0, 1, 2] * 4)


def test_a_name_that_comes_back_is_another_field(spark):
    """a becomes b, then a new a appears, then that one becomes c."""
    files = [
        ("s", "20250101_000000", [fact(i, a=i) for i in range(3)]),
        ("s", "20250102_000000", [fact(i, b=i) for i in range(3)]),
        ("s", "20250103_000000", [fact(i, b=i, a=f"x{i}") for i in range(3)]),
        ("s", "20250104_000000", [fact(i, b=i, c=f"x{i}") for i in range(3)]),
    ]
    rows = drift.unify(table(spark, files)).collect()
    assert sorted(r["a"] for r in rows) == sorted([0, 1, 2] * 4)
    assert [r["a#2"] for r in sorted(rows, key=lambda r: r["rec_id"])] == [None] * 6 + ["x0", "x1", "x2"] * 2


def test_a_key_named_twice_breaks_its_record_only(spark):
    df = drift.unify(table(spark, [("s", "20250101_000000", [fact(1, a=1), '{"video_url":"u","timestamp":"2s","a":1,"a":2}'])]))
    assert sorted((r["rec_id"], r["broken"], r["a"]) for r in df.collect()) == [(1, False, 1), (2, True, None)]


def test_columns_are_typed_and_misfits_kept(spark):
    said = [True, 1, "yes", "False", 0, "no", "perhaps"]
    counts = [12, 12.0, "12", 7, None, "about 3", -1]
    rows = [fact(i, ok=a, n=b, share=i + 0.5, note=f"t{i}", Note=1) for i, (a, b) in enumerate(zip(said, counts))]
    got = sorted(drift.unify(table(spark, [("s", "20250101_000000", rows)])).collect(), key=lambda r: r["rec_id"])
    assert [r["ok"] for r in got] == [True, True, True, False, False, False, None]
    assert [r["n"] for r in got] == [12, 12, 12, 7, None, None, -1]
    assert got[0]["share"] == 0.5 and got[0]["note_"] == "t0" and got[0]["Note"] == 1
    assert [r["rest"] for r in got] == [None] * 5 + [{"n": "about 3"}, {"ok": "perhaps"}]


def test_series_that_begin_under_a_later_name_share_the_column(spark):
    files = [
        ("s", "20250101_000000", [fact(i, words=i) for i in range(3)]), ("s", "20250102_000000", [fact(i, word_count=i) for i in range(3)]),
        ("t", "20250103_000000", [fact(i + 9, word_count=i) for i in range(3)]),
    ]
    df = drift.unify(table(spark, files))
    assert "word_count" not in df.columns and sorted(r["words"] for r in df.collect()) == sorted([0, 1, 2] * 3)


def test_fields_of_one_file_are_never_merged_over_series(spark):
    files = [
        ("s", "20250101_000000", [fact(i, words=i) for i in range(3)]), ("s", "20250102_000000", [fact(i, word_count=i) for i in range(3)]),
        ("t", "20250103_000000", [fact(i + 9, word_count=i, words=7) for i in range(3)]),
    ]
    rows = [r for r in drift.unify(table(spark, files)).collect() if r["series"] == "t"]
    assert sorted((r["words"], r["word_count"]) for r in rows) == [(7, 0), (7, 1), (7, 2)]


def test_rivals_are_told_apart_by_evidence_however_many_facts_agree(spark):
    """Both old fields may be x by their 1,001 or 1,003 equal facts; the one with more wins against its name."""
    old = [fact(i, x_old=1 if i < 1001 else None, other=1 if i < 1003 else None) for i in range(1100)]
    new = [fact(i, x=1 if i < 1003 else None) for i in range(1100)]
    got = changes(spark, [("s", "20250101_000000", old), ("s", "20250102_000000", new)])
    assert got == [("20250102", "removed", "x_old", ""), ("20250102", "renamed", "other", "x")]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.changes(empty).count() == 0 and drift.unify(empty).count() == 0
