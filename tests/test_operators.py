"""Operators on small tables, with nulls, ties, repeats and empty input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gwerin.operators import assignment, carry, joins, lexicon_lines, review, segments, stats, tokens


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 6)):
        cost = rng.random((n, m))
        got = assignment.assign(cost)
        total = sum(cost[i, j] for i, j in enumerate(got) if j >= 0)
        small, large = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small.shape[0]))
        assert abs(total - best) < 1e-9


def test_last_before_equals_window(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), int(t), None if rng.random() < 0.5 else int(rng.integers(100))) for t in rng.permutation(400)]
    df = spark.createDataFrame(rows, "k int, t long, v int").withColumn("b", F.floor(F.col("t") / 5))
    got = {(r["k"], r["t"]): r["o"] for r in carry.last_before(df, ["k"], "b", ["t"], "v", "o").collect()}
    want, last = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        want[k, t] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


def test_overlap_fold(spark):
    rows = [("v", 1, 0.0, 10.0, 0.5), ("v", 2, 1.0, 10.0, 0.9), ("w", 3, 0.0, 10.0, 0.5), ("w", 4, 1.0, 10.0, 0.5), ("x", 5, 0.0, 10.0, 0.1), ("x", 6, 2.1, 12.1, 0.9), (None, 7, 0.0, 1.0, 0.1), ("y", 8, None, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "k string, i long, s double, e double, c double")
    assert sorted(r["i"] for r in segments.drop_overlaps(df, "k", "s", "e", "i", "c").collect()) == [2, 3, 5, 6]


def test_collapse_repeats_with_nulls(spark):
    df = spark.createDataFrame([("v", 1, "a"), ("v", 2, "a"), ("v", 3, None), ("v", 4, None), ("v", 5, "a"), ("w", 6, "a")], "k string, i long, t string")
    out = segments.collapse_repeats(df, "k", ["i"], "t", F.floor(F.col("i") / 2))
    assert sorted(r["i"] for r in out.collect()) == [1, 3, 5, 6]


def test_clitics(spark):
    df = spark.createDataFrame([(1, "i'r"), (2, "mae'n"), (3, "'n"), (4, "cath")], "i int, word string")
    out = [(r["i"], r["part"], r["synthetic"]) for r in tokens.expand_clitics(df).orderBy("i", "part_no").collect()]
    assert out == [(1, "i", False), (1, "'r", True), (2, "mae", False), (2, "yn", False), (3, "yn", False), (4, "cath", False)]


@pytest.mark.parametrize("words, reason", [("a a b c d", None), ("a a a b c", "repeats"), ("a a", None)])
def test_repeat_filter_is_strict(spark, words, reason):
    df = spark.createDataFrame([(1, w) for w in words.split()], "s int, word string")
    assert tokens.hallucinated(df, ["s"]).first()["reason"] == reason


def test_lookahead_skips_three_fillers_at_most(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate("i er ym cath i er ym te cath".split())], "s int, i int, w string")
    rows = {r["i"]: (r["target"], r["ahead"]) for r in tokens.lookahead(df, ["s"], ["i"], "w").collect()}
    assert rows[0] == ("cath", 3) and rows[4] == (None, 4)


def test_packing_gives_long_words_their_own_chunk(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(["aaa", "bbb", "c" * 50, "d"])], "s int, i int, w string")
    assert [r["chunk"] for r in tokens.pack(df, ["s"], "i", "w", 10).orderBy("i").collect()] == [0, 0, 1, 2]


def test_lexicon_lookup(spark):
    entries = spark.createDataFrame([("clo", "clo", "NOUN", ""), ("clo", "cloi", "VERB", ""), ("Cymru", "Cymru", "PROPN", ""), ("af", "mynd", "VERB", "a"), ("af", "Mynd", "AUX", "b")], "wordform string, lemma string, tag string, morph string")
    words = spark.createDataFrame([("clo",), ("cymru",), ("af",), ("dim",), (None,)], "w0 string")
    got = {r["w0"]: (r["form"], r["lemma"], r["tag"]) for r in joins.look_up(words, "w0", joins.lexicon(entries)).collect()}
    assert got == {"clo": ("clo", None, None), "cymru": ("Cymru", "cymru", "PROPN"), "af": ("af", "mynd", None), "dim": (None, None, None), None: (None, None, None)}


def test_tolerance_join_is_inclusive_and_keeps_rows(spark):
    left = spark.createDataFrame([(1, "a", 1.00), (2, "a", 9.0), (3, None, 1.0), (4, "a", None), (1, "a", 1.00)], "i int, k string, t double")
    right = spark.createDataFrame([(10, "a", 1.05), (11, "a", 0.95), (12, "a", 0.94), (13, "b", 1.0)], "r long, k string, u double")
    got = sorted((r["i"], r["r"]) for r in joins.tolerance_join(left, right, ["k"], "t", "u", "r", 0.05).select("i", F.coalesce("r", F.lit(-1)).alias("r")).collect())
    assert got == [(1, 11), (1, 11), (2, -1), (3, -1), (4, -1)]


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([("a", True, "x"), ("b", False, "x"), ("c", False, "x"), (None, False, "x")], "k string, rev boolean, v string")
    new = spark.createDataFrame([("a", False, "y"), ("b", False, "y"), ("d", False, "y"), (None, False, "x")], "k string, rev boolean, v string")
    got = {r["k"]: r["class"] for r in review.diff_classes(old, new, ["k"], ["v"], "rev").collect()}
    assert got == {"a": "protected", "b": "changed", "c": "removed", "d": "added", None: "same"}
    assert {r["k"]: r["v"] for r in review.upsert(old, new, ["k"], ["v"], "rev").collect()} == {"a": "x", "b": "y", "c": "x", "d": "y", None: "x"}


def kappa_of(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    cats = {x for p in pairs for x in p}
    pe = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in cats) / n / n
    return (1.0 if po == 1 else 0.0) if pe >= 1 else round((po - pe) / (1 - pe), 6)


def test_kappa(spark):
    rows = [("erosion", a, "N", "NOUN", b, "s") for a, b in [("soft", "SM"), ("soft", None), ("n/a", "NM"), ("nasal", "NM"), ("n/a", None)]] + [("erosion", "n/a", "N", "NOUN", None, "one")] * 3
    df = spark.createDataFrame(rows, "status string, cysill_mutation_type string, cysill_pos string, spacy_pos string, spacy_mutation string, source string")
    got = {r["source"]: r["kappa"] for r in stats.kappa(df).collect()}
    assert got == {"s": kappa_of([("soft", "soft"), ("soft", "none"), ("none", "nasal"), ("nasal", "nasal"), ("none", "none")]), "one": 1.0}


def test_facts_dedup_is_order_free_and_null_safe(spark):
    rows = [(2, "u", "1s - 2s", "am", None, "b"), (1, "u", "1s - 2s", "am", None, "a"), (3, None, "1s - 2s", "am", "x", "c")]
    df = spark.createDataFrame(rows, "mutation_id long, video_url string, timestamp_span string, trigger_word string, following_word string, status string")
    for n in (1, 3):
        assert sorted(r["mutation_id"] for r in stats.dedup_facts(df.repartition(n)).collect()) == [1, 3]


# ------------------------------------------------------------ lexicon lines


def test_lines(spark):
    import re

    tags = set(lexicon_lines.UD_TAGS)

    def want(s):
        if s is None:
            return "columns"
        f = (s[:-1] if s.endswith("\r") else s).split("\t")
        if len(f) not in (3, 4):
            return "columns"
        if any('"' in x and not re.fullmatch(r'"(?:[^"]|"")*"', x) for x in f):
            return "quoting"
        v = [x[1:-1].replace('""', '"') if '"' in x else x for x in f]
        word = lambda i: v[i].strip() and all(c.isalpha() or c in " '’-" or c == '"' and '"' in f[i] for c in v[i])
        pair = r"[^\W_]+=[^\W_]+(?:,[^\W_]+)*"
        return None if word(0) and word(1) and v[2] in tags and (len(v) == 3 or not v[3] or re.fullmatch(rf"{pair}(?:\|{pair})*", v[3])) else "value"

    rng = np.random.default_rng(3)
    lines = [None, "", "\r", "a\tb\tX", '"a"\t"b ""c"""\tNOUN\tA=b|C=d,e\r', "a\tb\tX\t", '""\tb\tX', "\t\t", "a\tb\tX\r\r", "â\tb-c d\tX\tA=", "x" * 5000 + "\tb\tX"] + ["".join(rng.choice(list('a"\t\tb\r =X1'), rng.integers(1, 14))) for _ in range(3000)]
    out = lexicon_lines.parse_lines(spark.createDataFrame([(i, s, 1) for i, s in enumerate(lines)], "line_no long, line string, extra int"))
    rows = {r["line_no"]: r for r in out.collect()}
    assert [rows[i]["reason"] for i in range(len(lines))] == [want(s) for s in lines]
    assert (rows[4]["wordform"], rows[4]["lemma"], rows[4]["tag"], rows[4]["morph"]) == ("a", 'b "c"', "NOUN", "A=b|C=d,e")
    assert rows[9]["offset"] == 10
    with pytest.raises(ValueError):
        lexicon_lines.parse_lines(spark.createDataFrame([("a", "b")], "line string, reason string"))
    assert lexicon_lines.parse_lines(spark.createDataFrame([], "line string")).count() == 0


def test_automaton_over_chunks():
    rng = np.random.default_rng(4)
    cls = rng.integers(0, 4, 5000).astype(np.uint8)
    state, want = lexicon_lines.START, []
    for c in cls:
        state = lexicon_lines.NEXT[c, state]
        want.append(state)
    assert (lexicon_lines.states(cls) == np.array(want)).all()


def test_align_marks_each_token_once(spark):
    from gwerin.operators import align

    a = pd.DataFrame({"word": list("abcd"), "t": [1.0, 2, 3, 4], "rank": list("abcd"), "block": 0, "video_url": "v"})
    b = pd.DataFrame({"word": list("axcde"), "t": [1.0, 2, 30, 4, 5], "rank": list("abcde"), "block": 0, "video_url": "v"})
    out = align._one(a, b)
    assert out["w_idx"].tolist() == [0, 1, 2, 3] and out["tag"].tolist() == ["equal", "replace", "equal", "equal"] and out["timing_ok"].tolist() == [True, True, False, True]


def whole_video(words, cues):
    """(w_idx: caption_word, tag, timing_ok, run_len) by one alignment of all tokens; words: (start, end, word), cues: (start, text)."""
    import difflib

    b = [(t, x) for t, s in cues for x in s.split()]
    out = {}
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [w for _, _, w in words], [x for _, x in b], autojunk=False).get_opcodes():
        for i in range(i1, i2):
            j = j1 + i - i1
            out[i] = (None, tag if tag == "delete" else "replace_unmatched_length", None, i2 - i1) if tag == "delete" or j >= j2 else (b[j][1], tag, abs(words[i][1] - b[j][0]) <= 15, i2 - i1)
    return out


def test_align_streams_equals_the_whole_video(spark):
    from gwerin.operators import align

    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("bcdfgaeiou"), 5)) for _ in range(400)] + ["mae", "yn"]
    said = [str(w) for w in rng.choice(vocabulary, 6000)]
    words = [(i * 0.5, i * 0.5 + 0.4, w) for i, w in enumerate(said)]  # 3,000 s, cues of 14 words, clocks 9 s apart
    heard = [(max(0, i * 0.5 + 9), "cath" if rng.random() < 0.05 else w) for i, w in enumerate(said) if not 1000 <= i < 1040 and (rng.random() > 0.04 or 1840 < i < 2000)]
    cues = [(heard[k][0], " ".join(w for _, w in heard[k : k + 14])) for k in range(0, len(heard), 14)]
    left = spark.createDataFrame([("v", k, *w) for k, w in enumerate(words)] + [("w", 9999, 1.0, 1.2, "unig")], "video_url string, word_id long, word_start double, word_end double, word string")
    right = spark.createDataFrame([("v", k, *c) for k, c in enumerate(cues)], "video_url string, caption_id long, segment_start double, segment_text string")
    out = align.align_streams(align.stream(left, "video_url", "word_start", "word", ["word_id"], "word_end"), align.stream(right, "video_url", "segment_start", "segment_text", ["caption_id"])).collect()
    got = {r["w_idx"]: (r["caption_word"], r["tag"], r["timing_ok"], r["run_len"]) for r in out if r["video_url"] == "v"}
    assert all(r["w_idx"] == r["word_id"] for r in out if r["video_url"] == "v")
    assert [(r["w_idx"], r["tag"], r["run_len"]) for r in out if r["video_url"] == "w"] == [(0, "delete", 1)]
    assert len(got) == 6000 and got == whole_video(words, cues)


def test_whole_lexicon_has_quoted_lines(spark, tmp_path):
    import __spark_entry__ as entry

    lines = ["clo\tclo\tNOUN", '"clo"\tcloi\tVERB', '"a ""b"""\tb\tNOUN\r', '"Cymru"\t"Cymru"\tPROPN', 'x"\tx\tX']
    spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "line_no long, line string").write.parquet(str(tmp_path / "lexicon_lines.parquet"))
    got = {r["wordform"]: (r["n"], r["lemma"], r["tag"]) for r in entry.queries()["lexicon_ambiguity"](spark, str(tmp_path)).collect()}
    assert got == {"clo": (2, None, None), 'a "b"': (1, "b", "NOUN"), "Cymru": (1, "cymru", "PROPN")}
    got = {r["w"]: (r["form"], r["lemma"]) for r in entry.queries()["case_recovery_lookup"](spark, str(tmp_path)).collect()}
    assert got == {"clo": ("clo", None), 'a "b"': ('a "b"', "b"), "cymru": ("Cymru", "cymru")}


def test_next_words_lie_in_later_segments_and_buckets(spark):
    from gwerin.operators import rules

    rng = np.random.default_rng(6)
    starts = sorted(float(x) for x in rng.choice(np.arange(0, 6000, 7), 60, replace=False))
    rows = [("v", s, i, f"{s}/{i}") for s in starts for i in range(int(rng.integers(1, 4)))] + [("w", 1.0, 0, "x")]
    words = spark.createDataFrame(rows, "video_url string, segment_start double, i int, w string").withColumn("me", F.struct("w"))
    got = {r["w"]: [r[f"next{k}"] and r[f"next{k}"]["w"] for k in (1, 2, 3)] for r in rules.with_next(words, 3).collect()}
    v = [r[3] for r in rows if r[0] == "v"]
    want = {x: ([*v[k + 1 : k + 4], None, None, None])[:3] for k, x in enumerate(v)} | {"x": [None] * 3}
    assert got == want


# ------------------------------------------------------------ rules, by hand


NODE = dict(confidence=0.9, cysill_pos="NM", spacy_pos="NOUN", spacy_dep="root", spacy_mutation=None, gender=None)


def facts_of(spark, spoken, scan=False):
    """Facts of each list of words (text, lemma, changed tags) spoken one after the other: (trigger, following, rule, status, radical)."""
    from gwerin.operators import rules

    rows, lemmas = [], []
    for v, said in enumerate(spoken):
        for n, (w, lemma, tags) in enumerate(said):
            lemmas += [(len(rows), lemma)]
            rows.append(dict(NODE, **{k: x for k, x in tags.items() if k not in NODE}) | tags | dict(word=w, video_url=f"{v:03}", segment_start=float(n // 5), word_start=float(n), word_end=n + 0.5, word_id=len(rows)))
    kinds = {"confidence": "double", "segment_start": "double", "word_start": "double", "word_end": "double", "word_id": "long"}
    cols = sorted({k for r in rows for k in r})
    words = spark.createDataFrame([[r.get(c) for c in cols] for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols))
    own = spark.createDataFrame(lemmas, "word_id long, lemma string").withColumn("genuine", F.lit(True))
    rich = rules.enrich(words).drop("lemma", "genuine").join(own, "word_id")
    out = rules.scan_facts(rich) if scan else rules.evaluate(rules.candidates(rich))
    got = [[] for _ in spoken]
    for r in out.orderBy("video_url", "word_start").collect():
        got[int(r["video_url"])].append((r["trigger_word"], r["following_word"], r["rule"], r["status"], r["matched_radical"]))
    return got


def test_outcomes_of_a_trigger(spark):
    """dy asks for soft change, fy for nasal: each branch of the decision list."""
    cases = [
        ("dy", "gath", "cath", {}, "correct_mutation", "cath"),  # changed as asked, by its lemma
        ("dy", "cath", "cath", {}, "erosion", None),  # the radical where soft change was due
        ("dy", "pethau", "peth", {}, "erosion", None),  # an inflected radical, by its beginning
        ("dy", "pethau", "peth", {"spacy_pos": "X", "cysill_pos": "?"}, "erosion_unverified", None),
        ("dy", "cath", None, {}, "mutation_mismatch", None),  # nothing says what it is
        ("dy", "bach", None, {}, "correct_mutation", "pach"), ("dy", "fach", None, {}, None, None),  # some change may have made it; f itself has no soft form
        ("dy", "mhen", "pen", {}, "wrong_mutation_type", None),
        ("fy", "mhen", "pen", {}, "correct_mutation", "pen"),
        ("dy", "cath", "cath", {"confidence": 0.6}, None, None),  # not surely heard
        ("dy", "siop", "siop", {}, None, None),  # its beginning has no soft form
        ("dy", "the", None, {}, "code_switch", None),
        ("eu", "hafal", "afal", {}, "correct_mutation", None), ("eu", "afal", "afal", {}, "erosion", None),
        ("na", "chath", "cath", {}, "correct_mutation", "cath"), ("na", "ofn", "gofn", {}, "correct_mutation", "gofn"),
        ("mor", "llawn", "llawn", {}, None, None),  # ll stays behind it
    ]
    found = facts_of(spark, [[(trigger, None, {}), (word, lemma, tags)] for trigger, word, lemma, tags, _, _ in cases])
    for (trigger, word, _, _, status, radical), got in zip(cases, found):
        mine = [g[3:] for g in got if g[0] == trigger]
        assert mine == ([(status, radical)] if status else []), (trigger, word, got)


def test_layers_and_the_scan(spark):
    fem, adj = {"gender": "fem", "cysill_pos": "NF"}, {"spacy_pos": "ADJ", "cysill_pos": "ADJ"}
    card, obj = {"cysill_pos": "CARD", "spacy_pos": "NUM"}, {"spacy_dep": "obj"}
    amod = {"spacy_pos": "ADJ", "spacy_dep": "amod", "head": "gath"}
    cases = [
        ([("merch", None, fem), ("da", "da", adj)], ("merch", "da", "fem_noun+adjective", "erosion")),
        ([("merch,", None, fem), ("da", "da", adj)], None),  # a clause ends between them
        ([("nos", None, fem), ("da", "da", adj)], None),  # d stays behind s
        ([("merch", None, fem), ("tref", "tref", {"spacy_dep": "nmod"})], ("merch", "tref", "fem_noun+genitive_noun", "erosion")),
        ([("un", None, card), ("ferch", "merch", fem)], ("un", "ferch", "numeral+fem_noun", "correct_mutation")),
        ([("saith", None, card), ("mlynedd", "blynedd", {})], ("saith", "mlynedd", "restricted_nasal_numeral", "correct_mutation")),
        ([("saith", None, card), ("cath", "cath", {})], None),
        ([("haf", None, {}), ("dydd", "dydd", {})], ("haf", "dydd", "decompounded_noun", "erosion")),
        ([("ail", None, {"cysill_pos": "ORDF"}), ("ferch", "merch", {})], ("ail", "ferch", "word_trigger", "correct_mutation")),
        ([("trydedd", None, {"cysill_pos": "ORDF"}), ("ferch", "merch", {})], ("trydedd", "ferch", "feminine_ordinal+noun", "correct_mutation")),
        ([("gath", "cath", {"spacy_dep": "vocative"})], ("[VOCATIVE]", "gath", "spacy_vocative_soft", "correct_mutation")),
        ([("cath", "cath", obj)], ("[SHORT_FORM_VERB]", "cath", "spacy_obj_soft_unheaded", "erosion")),
        ([("cath", "cath", {**obj, "head_dep": "ROOT"})], ("[SHORT_FORM_VERB]", "cath", "spacy_obj_soft", "erosion")),
        ([("cath", "cath", {**obj, "head_dep": "ROOT", "head_verbform": "Vnoun"})], None),
        ([("gath", "cath", {"cysill_mutation_type": "soft"})], ("[OMITTED]", "gath", "phantom_check", "phantom_mutation")),
        ([("unig", None, amod), ("gath", "cath", {})], ("unig", "gath", "preposed_adjective+noun", "correct_mutation")),
        ([("unig", None, {**amod, "head": "other"}), ("gath", "cath", {})], None),
    ]
    for (said, want), got in zip(cases, facts_of(spark, [c[0] for c in cases])):
        assert [g[:4] for g in got] == ([want] if want else []), (said, got)
    # the fact of merch takes the next word along, so that it isn't looked at again
    said = [[("merch", None, fem), ("fer", None, {**fem, **adj}), ("da", "da", {"spacy_pos": "NOUN"})]]
    everywhere, visited = facts_of(spark, said)[0], facts_of(spark, said, scan=True)[0]
    assert len(everywhere) == 2 and visited == everywhere[:1]


def test_scan_equals_a_walk_over_the_video(spark):
    """Stops of a long video by one walk, and by maps composed over its buckets."""
    from gwerin.operators import rules

    rng = np.random.default_rng(9)
    pool = ["dy", "fy", "er", "ym", "cath", "merch", "da", "dan", "ar", "pen", "the"]
    said = [(str(rng.choice(pool)), {"gender": "fem" if rng.random() < 0.3 else None, "spacy_pos": str(rng.choice(["NOUN", "ADJ"])), "confidence": float(rng.choice([0.5, 0.9, 0.9]))}) for _ in range(600)]
    rows = [(w, t["gender"], t["spacy_pos"], t["confidence"], "v" if n % 9 else "u", float(n * 40), float(n), n + 0.5, n, "NM", "root", None) for n, (w, t) in enumerate(said)]
    words = spark.createDataFrame(rows, "word string, gender string, spacy_pos string, confidence double, video_url string, segment_start double, word_start double, word_end double, word_id long, cysill_pos string, spacy_dep string, spacy_mutation string")
    rich = rules.enrich(words)
    steps = {(r["video_url"], r["segment_start"]): r["step"] for r in rules.candidates(rich).collect()}
    want = set()
    for v in ("u", "v"):
        line = sorted(t for u, t in steps if u == v)
        at = 0
        while at < len(line):
            want.add((v, line[at]))
            at += steps[v, line[at]]
    got = [(r["video_url"], r["segment_start"]) for r in rules.scan(rich).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(t for _, t in want) > 256 * rules.BUCKET / 4


# ------------------------------------------------------------ corroboration, rerun and the like


def test_corroboration_by_the_aligned_transcript(spark):
    from gwerin.operators import align

    said = "aa bb gath cc dd cath ee ff pen gg hh ben ii jj ci kk ll mm nn oo".split()
    shown = "aa bb gath cc dd gath ee ff ben gg hh pen ii jj xx kk mm nn oo".split()
    words = spark.createDataFrame([("v", k, w, float(k), k + 0.5) for k, w in enumerate(said)], "video_url string, word_id long, word string, word_start double, word_end double")
    cues = spark.createDataFrame([("v", k, float(k), w) for k, w in enumerate(shown)], "video_url string, caption_id long, segment_start double, segment_text string")
    evidence = align.align_streams(align.stream(words, "video_url", "word_start", "word", ["word_id"], "word_end"), align.stream(cues, "video_url", "segment_start", "segment_text", ["caption_id"]))
    facts = [(1, 2, "gath", "cath", "soft"), (2, 5, "cath", "cath", "none"), (3, 8, "pen", "pen", None), (4, 11, "ben", "pen", "soft"), (5, 14, "ci", "ci", "none"), (6, 16, "ll", None, "none"), (7, 30, "zz", None, "none")]
    rows = [(m, "v", f"{k}.0s - {k}.5s", "dy", w, lemma, found) for m, k, w, lemma, found in facts] + [(8, "v", None, "dy", "gath", "cath", "soft")]
    df = spark.createDataFrame(rows, "mutation_id long, video_url string, timestamp_span string, trigger_word string, following_word string, lemma string, mutation_found string")
    got = {r["mutation_id"]: (r["verdict"], r["caption_word"], r["flagged"]) for r in align.corroborate(df, words, evidence).collect()}
    assert got == {
        1: ("confirmed_match", "gath", False), 2: ("confirms_erosion", "gath", False), 3: ("confirms_erosion", "ben", False), 4: ("caption_disputes_mutation", "pen", True), 5: ("caption_word_not_lemma_candidate", "xx", False),
        6: ("caption_omits_word", None, False), 7: ("no_alignment", None, False), 8: ("no_timestamp", None, False),
    }
    a = align.agreement(evidence, ["video_url"]).first()
    assert (a["tokens"], a["agreeing"], a["replace"], a["delete"]) == (20, 15, 4, 1)


def test_chat_lines_as_a_stream(spark):
    from gwerin.operators import align

    lines = spark.createDataFrame([(1, 1, "mae ci", None, None), (1, 2, "dda iawn", 2.0, 5.0), (1, 3, "ie", None, None), (2, 1, None, 1.0, 2.0)], "transcript_id long, line_no int, text string, utt_start double, utt_end double")
    got = [(r["word"], r["t"]) for r in align.chat_stream(lines).orderBy("o").collect()]
    assert sorted(got) == sorted([("mae", 0.0), ("ci", 0.0), ("dda", 2.0), ("iawn", 2.0), ("ie", 5.0)])


def test_rerun_changes_the_chosen_facts_only(spark):
    old = spark.createDataFrame([("u", "dy", "r", "x", False), ("u", "fy", "r", "x", False), ("v", "dy", "r", "x", True), ("v", "dy", "q", "x", False)], "video_url string, trigger_word string, rule string, status string, rev boolean")
    fresh = spark.createDataFrame([("u", "dy", "r", "y"), ("u", "fy", "r", "y"), ("v", "dy", "r", "y"), ("w", "dy", "r", "y")], "video_url string, trigger_word string, rule string, status string")
    keys = ["video_url", "trigger_word", "rule"]
    classes, facts = review.rerun(old, fresh, keys, ["status"], "rev", triggers=["DY"], rules=["r"])
    assert {tuple(r)[:3]: r["class"] for r in classes.collect()} == {("u", "dy", "r"): "changed", ("v", "dy", "r"): "protected", ("w", "dy", "r"): "added"}
    assert sorted(tuple(r) for r in facts.collect()) == [("u", "dy", "r", "y"), ("u", "fy", "r", "x"), ("v", "dy", "q", "x"), ("v", "dy", "r", "x"), ("w", "dy", "r", "y")]
    with pytest.raises(ValueError):
        review.choose(old)


def test_drop_overlaps_equals_one_fold(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in ("a", "b"):
        t = 0.0
        for i in range(400):
            t += float(rng.choice([0.0, 0.1, 0.5, 1.5, 3.0, 400.0], p=[0.2, 0.2, 0.2, 0.2, 0.19, 0.01]))
            rows.append((k, len(rows), round(t, 3), round(t + float(rng.choice([0.0, 0.2, 1.0, 2.0, 6.0, 90.0], p=[0.05, 0.2, 0.3, 0.3, 0.14, 0.01])), 3), float(rng.integers(4))))
    df = spark.createDataFrame(rows, "k string, i long, s double, e double, c double")
    want = []
    for k in ("a", "b"):
        mine = sorted(({"s": s, "i": i, "e": e, "c": c} for q, i, s, e, c in rows if q == k), key=lambda x: (x["s"], x["i"]))
        want += segments._kept(mine, 0.8)
    assert sorted(r["i"] for r in segments.drop_overlaps(df, "k", "s", "e", "i", "c").collect()) == sorted(want)


def test_segments_are_judged_in_order(spark):
    rows = [(1, "mae hi yn braf", 0.7, -0.1), (2, "mae hi yn braf", 0.6, -1.1), (3, " ", None, None), (4, "ie ie", None, None), (5, "ie ie ie na", 0.0, 0.0), (6, "mae hi yn braf", 0.6, -1.0), (7, None, 0.1, None)]
    df = spark.createDataFrame(rows, "i int, t string, ns double, lp double")
    got = {r["i"]: r["drop"] for r in tokens.judge_segments(df, ["i"], "t", "ns", "lp").collect()}
    assert got == {1: "no_speech", 2: "improbable", 3: "no_words", 4: None, 5: "repeats", 6: None, 7: "no_words"}


def test_sum_before_equals_window(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), int(t), int(rng.integers(5))) for t in rng.permutation(500)]
    df = spark.createDataFrame(rows, "k int, t long, v long").withColumn("b", F.floor(F.col("t") / 1))
    got = {(r["k"], r["t"]): r["o"] for r in carry.sum_before(df, ["k"], "b", ["t"], "v", "o").collect()}
    assert got == {(k, t): sum(v2 for k2, t2, v2 in rows if k2 == k and t2 < t) for k, t, _ in rows}
