"""Turns, runs, nearest times and mixing: edge cases and brute force."""

import random

import numpy as np

import pytest

runs = pytest.importorskip("gwerin.llm.runs")
from gwerin.llm import mixing, nearest, turns  # noqa: E402


def one_letter(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return False
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) > 1:
        return False
    i = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    return short[i + 1 :] == long[i + 1 :] if len(a) == len(b) else short[i:] == long[i + 1 :]


def brute_runs(rows, gap=30.0):
    out = []
    kept = {}
    for v, s, e, t, i in rows:
        kept[v, s, e, t] = min(i, kept.get((v, s, e, t), i))
    events = sorted(((v, s, i, e, t) for (v, s, e, t), i in kept.items()), key=lambda r: (r[0], r[1], r[2]))
    before = None
    for v, s, i, e, t in events:
        k = None if t is None else "".join(c for c in t.lower() if c.isalnum())
        if before and before[0] == v and k is not None and before[1] is not None and one_letter(k, before[1]) and round(s - before[2], 6) <= gap:
            out[-1][1] += 1
        else:
            out.append([i, 1])
        before = (v, k, e)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("bucket", [7.0, 300.0, 100000.0])
def test_runs_equal_brute_force_at_any_bucket(spark, bucket):
    rng = random.Random(3)
    words = ["mae hi", "mae  hi!", "mae hii", "ie", "is", "a1bcd", "a2bcd", None, "", "♪"]
    rows = [(rng.choice("vw"), float(rng.randint(0, 900)), 0.0, rng.choice(words), i) for i in range(400)]
    rows = [(v, s, s + rng.choice([0.5, 2.0, 40.0]), t, i) for v, s, _, t, i in rows]
    rows += [(v, s, e, t, i + 1000) for v, s, e, t, i in rows[:60]]
    df = spark.createDataFrame(rows, "v string, s double, e double, t string, i long")
    out = runs.collapse_runs(df, ["v"], "s", "e", "t", "i", bucket_seconds=bucket)
    assert sorted((r["first_id"], r["run_rows"]) for r in out.collect()) == brute_runs(rows)


def test_runs_without_place(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, "a", 1, 0), ("v", None, 2.0, "a", 2, 0), ("v", 1.0, None, "a", 3, 0), ("v", 2.0, 3.0, "a", 4, 0)], "v string, s double, e double, t string, i long, first_id int")
    assert sorted((r["first_id"], r["run_rows"]) for r in runs.collapse_runs(df, ["v"], "s", "e", "t", "i").collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert runs.collapse_runs(df.where("false"), ["v"], "s", "e", "t", "i").count() == 0


@pytest.mark.parametrize("first", [None, 0.003, 0.2, 9.0])
def test_nearest_equals_brute_force(spark, first):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *[round(rng.uniform(0, 9), 3) for _ in range(9)]])) for i in range(200)] + [(1, "a", 2.0), (1, "a", 2.0)]
    right = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *[round(rng.uniform(0, 9), 2) for _ in range(9)]])) for i in range(60)] + [(900, "a", 2.2), (901, "a", 2.2), (902, "a", 1.8)]
    out = nearest.nearest_match(spark.createDataFrame(left, "i long, k string, t double"), spark.createDataFrame(right, "rid long, k string, u double"), "k", "t", "u", "rid", 0.2, first)

    def want(k, t):
        if k is None or t is None:
            return None
        best = min(((abs(round(u * 1e6) - round(t * 1e6)), round(u * 1e6), i) for i, rk, u in right if rk == k and u is not None), default=None)
        return best[2] if best and best[0] <= 200_000 else None

    got = sorted(((r["i"], r["k"], r["t"], r["rid"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, k, t, want(k, t)) for i, k, t in left), key=repr)


def test_nearest_rings_and_clashes(spark):
    assert nearest.rings(0.2, 0.05) == [50_000, 100_000, 200_000] and nearest.rings(0.2, 9) == [200_000]
    df = spark.createDataFrame([(1, "a", 1.0)], "rid long, k string, t double")
    with pytest.raises(ValueError):
        nearest.nearest_match(df, df, "k", "t", "t", "rid", 0.2)
    none = df.where("false")
    assert nearest.nearest_match(df.withColumnRenamed("rid", "i"), none, "k", "t", "t", "rid", 0.2).first()["rid"] is None


# ------------------------------------------------------------ turns

U = "utterance_id long, transcript_id long, line_no int, speaker string, text string, utt_start double, utt_end double"
P = "transcript_id long, speaker_code string, speaker_name string, speaker_role string"


def turned(spark, lines, roster=((1, "ABC", "Abeth", "Teacher"), (1, "DEF", "Defyn", "Observer"))):
    df = spark.createDataFrame([(i, 1, *x) for i, x in enumerate(lines, 1)], U)
    out = turns.speaker_turns(df, spark.createDataFrame(list(roster), P)).orderBy("turn_start", "first_utterance_id")
    return [(r["speaker_code"], r["first_utterance_id"], r["turn_lines"], r["text"]) for r in out.collect()]


def test_labels_marks_and_noise(spark):
    lines = [
        (1, "*ABC:", "mae &=laughs hi'n (o)er@s:eng 1000_2000", None, None), (2, " ＡＢＣ ", "er ym... (.) xxx ♪ [x] <music>", 3.0, 4.0), (3, None, "[def] - <ydy> [/] ydy [00:00:05.500]", None, None),
        (4, "Speaker DEF", "ie ((x)) (7.5s)", None, None), (5, "teacher", "na +...", 9.0, None), (6, "", "dyna fo", None, None), (7, "A.B.C. (cont.)", "*chuckles* wel", 12.0, None), (8, "Defin", "hwyl", 13.0, None), (9, "DEF>", None, 14.0, None),
    ]
    assert turned(spark, lines) == [("ABC", 1, 1, "mae hi'n oer"), ("DEF", 3, 2, "ydy ydy ie"), ("ABC", 5, 3, "na dyna fo wel"), ("DEF", 8, 1, "hwyl")]


def test_order_of_time_and_lines_without(spark):
    lines = [(1, "ABC", "a b", 5.0, 6.0), (2, "DEF", "c d", 2.0, 3.0), (3, "DEF", "e f", None, None), (4, "ABC", "g h", 9.0, 10.0)]
    assert turned(spark, lines) == [("DEF", 2, 2, "c d e f"), ("ABC", 1, 2, "a b g h")]


def test_deliveries_unknown_labels_and_nothing(spark):
    lines = [(1, "ABC", "a b", 1.0, 2.0), (1, "ABC", "a b", 1.0, 2.0), (2, "ZZZZZ", "c", 3.0, 4.0), (3, None, "d", 5.0, 6.0), (None, "ABC", "e", 7.0, 8.0)]
    assert turned(spark, lines) == [("ABC", 1, 1, "a b"), (None, 3, 2, "c d")]
    assert turned(spark, [(1, "ABC", None, 1.0, 2.0), (2, "ABC", "", 1.0, 2.0)]) == []
    assert turns.speaker_turns(spark.createDataFrame([], U), spark.createDataFrame([], P)).count() == 0


def test_long_transcripts_are_walked_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    lines = [(i, rng.choice(["ABC", "DEF", None]), rng.choice(["gair", "ym"]), rng.choice([None, i * 10.0]), None) for i in range(1, 120)]
    want = turned(spark, lines)
    monkeypatch.setattr(turns, "LINES", 7)
    monkeypatch.setattr(turns, "SECONDS", 55.0)
    assert turned(spark, lines) == want


# ------------------------------------------------------------ mixing


def sizes(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, lang string, topic string, tokens long, extra int")


def test_shares_are_met_within_a_document(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None, "z"]), rng.choice(["cy", "en", None]), rng.choice(["x", "y", None]), rng.choice([0, None, *range(1, 300)]), 0) for i in range(3000)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.3, 2), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes(spark, rows), targets, "id")
    assert mixed.count() == 3000
    share = {r["source"]: r for r in mixing.actual_shares(mixed, targets).collect()}
    total = sum(r["tokens"] for r in share.values())
    for s in "abc":
        assert abs(share[s]["tokens"] - total / 3) <= 320 and share[s]["most_repeats"] <= share[s]["max_repeats"]
    assert share["gone"]["actual_share"] == 0 and share["z"]["copies"] == 0 and share[None]["copies"] == 0
    again = mixing.mix(sizes(spark, rows).repartition(3), targets, "id")
    assert mixed.exceptAll(again).count() == 0


def test_smaller_totals_and_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows = [(i, "ab"[i % 2], "cy", "x", 10, 0) for i in range(200)]
    used = mixing.mix(sizes(spark, rows), targets, "id", total_tokens=600).where("copies > 0").groupBy("source").sum("tokens").collect()
    assert sorted(r[1] for r in used) == [300, 300]
    assert mixing.mix(sizes(spark, []), targets, "id").count() == 0
    assert sum(r["copies"] for r in mixing.mix(sizes(spark, [(1, "q", "cy", "x", 5, 0)]), targets, "id").collect()) == 0


def test_every_value_of_a_margin_is_raked_on_its_own(spark):
    """300 languages, one of them named other: their shares of the mix follow the corpus."""
    rows = [(i, "ab"[i % 2], "other" if i % 300 == 7 else f"l{i % 300}", "x", 10 + i % 300, 0) for i in range(6000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    df = sizes(spark, rows)
    assert mixing.plan_mix(df, targets)[0].count() == 300
    out = mixing.margin_shares(mixing.mix(df, targets, "id"), df, "id").where("margin = 'lang'").collect()
    assert len(out) == 300 and all(abs(r["corpus_share"] - r["actual_share"]) < 0.002 for r in out)


def test_cells_are_raked_alike_on_the_driver_and_as_a_table(spark):
    rng = np.random.default_rng(3)
    cells = [(s, lang, t, float(rng.integers(10, 500)), g, c) for s, g, c in (("a", 900.0, 1.0), ("b", 1500.0, 3.0)) for lang in ("cy", "en", "fr") for t in ("x", "y") if rng.random() < 0.9]
    codes = [np.array([sorted({r[k] for r in cells}).index(r[k]) for r in cells]) for k in range(3)]
    want = mixing.rake(np.array([r[3] for r in cells]), codes, np.array([900.0, 1500.0]) / 2400, np.array([1, 3]), 2400.0, rounds=2)
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double, goal double, cap double")
    got = {(r["source"], r["lang"], r["topic"]): r["w"] for r in mixing.rake_table(df, 2400.0, rounds=2).collect()}
    assert len(got) == len(cells) and all(abs(got[r[:3]] - x) < 1e-9 for r, x in zip(cells, want))


def test_more_cells_than_the_driver_takes(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], "cy" if i % 3 else "en", "x", 10, 0) for i in range(60)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    want = sorted((r["id"], r["copies"]) for r in mixing.mix(sizes(spark, rows), targets, "id").collect())
    monkeypatch.setattr(mixing, "CELLS", 2)
    assert sorted((r["id"], r["copies"]) for r in mixing.mix(sizes(spark, rows), targets, "id").collect()) == want
