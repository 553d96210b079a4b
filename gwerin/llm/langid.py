"""Language of documents, their lines, speech segments and single words (problem 5).

Method: hierarchical discrimination. The family is predicted first: by script, and among
Latin texts by linear support vector machines between Celtic, Germanic and Romance. Then
one-versus-one linear support vector machines separate the languages of the family. All
machines score hashed character n-grams of the text's consistent form.

The machines are fitted on a bounded sample of labelled lines (``LINES_PER_LANGUAGE``,
chosen by hash, at most ``LINE_CHARS`` of each); everything else reads all rows and whole
texts. Labels are noisy, so lines that the first fit puts elsewhere are left out of the
second.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin.llm.textform import consistent_form, normalize_array

LINES_PER_LANGUAGE = 800
LINE_CHARS = 400
BITS = 16
PART = 200_000  # code points that are scored at a time
ORDERS = (1, 2, 3, 4)
WORD_WEIGHT = 2  # features that a whole word counts for
LISTED_WORDS = 5000  # at most so many listed words of a language are fitted on
# Families, and the codes and names by which languages are labelled.
FAMILIES = {"celtic": ["cy"], "germanic": ["en", "de"], "romance": ["fr", "es"], "sinitic-japonic": ["ja", "zh"], "tai": ["th"], "indic": ["hi"], "hellenic": ["el"], "semitic": ["ar"]}
LATIN_FAMILIES = ("celtic", "germanic", "romance")
CODES = {"cym": "cy", "wel": "cy", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "jpn": "ja", "zho": "zh", "chi": "zh", "tha": "th", "hin": "hi", "ell": "el", "gre": "el", "ara": "ar"}
LANGUAGES = [lang for langs in FAMILIES.values() for lang in langs]
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}
# First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "sinitic-japonic": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "tai": [(0x0E01, 0x0E3A), (0x0E40, 0x0E4E)], "indic": [(0x0900, 0x0963), (0x0971, 0x097F)], "hellenic": [(0x370, 0x373), (0x376, 0x37D), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FFF)], "semitic": [(0x0620, 0x064A), (0x066E, 0x06D3), (0x0750, 0x077F)],
}


def base_code(label: Column) -> Column:
    """Two-letter code of a label however it is spelt (three letters, upper case, with region); null if it is none."""
    first = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*\s*$", 1))
    table = F.create_map(*[F.lit(x) for pair in (CODES | {c: c for c in LANGUAGES}).items() for x in pair])
    return F.when(first != "", F.try_element_at(table, first))


@functools.cache
def _script_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            out[a : b + 1] = i
    for cp in (0xD7, 0xF7):
        out[cp] = 0
    return out


@functools.cache
def _lower_table() -> np.ndarray:
    """Lower case of each code point; other than letters and apostrophes become a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    table = _script_table()
    for cp in np.flatnonzero(table):
        low = chr(cp).lower()
        out[cp] = ord(low) if len(low) == 1 else cp
    out[0x27] = 0x27
    return out


def _codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each between two spaces, and their text numbers."""
    joined = "".join(f" {t} " for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])


def _parts(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts in parts of about ``PART`` code points with their numbers; a longer text is cut between words."""
    piece, of, size = [], [], 0
    for i, text in enumerate(texts):
        begin = 0
        while True:
            end = len(text)
            if end - begin > PART:
                cut = text.rfind(" ", begin, begin + PART)
                end = cut if cut > begin else begin + PART
            piece.append(text[begin:end])
            of.append(i)
            size += end - begin
            begin = end
            if size >= PART:
                yield piece, np.array(of)
                piece, of, size = [], [], 0
            if begin >= len(text):
                break
    if piece:
        yield piece, np.array(of)


def _ngrams(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters and their rows; runs of others count as one space."""
    low = _lower_table()[cp]
    keep = np.ones(len(low), bool)
    if len(low):
        keep[1:] = ~((low[1:] == 0x20) & (low[:-1] == 0x20) & (row[1:] == row[:-1]))
    low, row = low[keep].astype(np.uint64), row[keep]
    hashes, rows = [], []

    def add(h: np.ndarray, r: np.ndarray) -> None:
        hashes.append(((h ^ (h >> np.uint64(29))) & np.uint64((1 << BITS) - 1)).astype(np.int64))
        rows.append(r)

    for n in ORDERS:
        if len(low) < n:
            continue
        h = np.full(len(low) - n + 1, n * 0x9E3779B1, np.uint64)
        for k in range(n):
            h = (h ^ low[k : len(low) - n + 1 + k]) * np.uint64(0x100000001B3)
        inside = row[: len(row) - n + 1] == row[n - 1 :]
        if n == 1:
            inside &= low != 0x20
        add(h[inside], row[: len(row) - n + 1][inside])
    starts = np.flatnonzero((low != 0x20) & np.r_[True, low[:-1] == 0x20])
    if len(starts):  # whole words
        ends = np.flatnonzero((low != 0x20) & np.r_[low[1:] == 0x20, True]) + 1
        size = ends - starts
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        letters = low[np.repeat(starts, size) + at]
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        h = np.add.reduceat((letters + np.uint64(1)) * power[at % 64], np.cumsum(size) - size)
        h ^= h >> np.uint64(31)
        for salt in range(WORD_WEIGHT):
            add(h * np.uint64(2 * salt + 0xD6E8FEB86659FD93), row[starts])
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _fit(idx: np.ndarray, row: np.ndarray, y: np.ndarray, scale: np.ndarray, rounds: int = 12, cost: float = 1.0) -> np.ndarray:
    """Linear support vector machine with hinge loss, by dual coordinate descent over the sample."""
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(len(y) + 1))
    rows = []
    for i in range(len(y)):
        features, count = np.unique(idx[order[edges[i] : edges[i + 1]]], return_counts=True)
        rows.append((features, count * scale[i]))
    return _descend(rows, y, 1 << BITS, rounds, cost).astype(np.float32)


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, rounds: int = 12, cost: float = 1.0) -> np.ndarray:
    """Weights of the machine for sparse rows (features, values) and sides of 1 and -1, both sides counting alike; the same for the same rows."""
    norm = [max(1e-9, float(v @ v)) for _, v in rows]
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w = np.zeros(size)
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            f, v = rows[i]
            gradient = y[i] * float(w[f] @ v) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), share[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


@dataclass
class Model:
    """Weights of each machine, by the names of its two sides; small and of fixed size."""

    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _duel(self, names: list[str], score: dict, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the one-versus-one votes and the smallest of its margins."""
        if not names:
            return np.full(rows, -1), np.zeros(rows)
        votes, least = np.zeros((len(names), rows)), np.full((len(names), rows), 9.0)
        for i, a in enumerate(names):
            for j, b in enumerate(names[i + 1 :], i + 1):
                s = score[a, b]
                votes[i] += s > 0
                votes[j] += s <= 0
                least[i], least[j] = np.minimum(least[i], s), np.minimum(least[j], -s)
        best = (votes + 1e-3 * np.tanh(least)).argmax(0)
        return best, least[best, np.arange(rows)]

    def scores(self, texts: list[str]) -> tuple[dict, np.ndarray]:
        """Margins of all machines and letters by script, of each text; in parts of ``PART`` code points."""
        n = len(texts)
        counts, size = np.zeros((len(SCRIPTS), n)), np.zeros(n)
        sums = {k: np.zeros(n) for k in self.machines}
        for piece, of in _parts(texts):
            cp, row = _codepoints(piece)
            script = _script_table()[cp]
            for i in range(len(SCRIPTS)):
                np.add.at(counts[i], of, np.bincount(row[script == i + 1], minlength=len(piece)))
            idx, at = _ngrams(cp, row)
            np.add.at(size, of, np.bincount(at, minlength=len(piece)))
            for k, w in self.machines.items():
                np.add.at(sums[k], of, np.bincount(at, weights=w[idx], minlength=len(piece)))
        size = np.sqrt(np.maximum(1, size))
        return {k: v / size for k, v in sums.items()}, counts

    def predict(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        """Language and confidence of consistent texts; (null, 0) without a letter of a known script."""
        n = len(texts)
        if not n:
            return [], np.zeros(0)
        score, counts = self.scores(texts)
        names = list(SCRIPTS)
        share = counts.max(0) / np.maximum(1, counts.sum(0))
        lang = np.full(n, None, object)
        sure = share.copy()
        top = counts.argmax(0)
        for i, name in enumerate(names):
            mine = np.flatnonzero((top == i) & (counts.sum(0) > 0))
            if not len(mine):
                continue
            families = [name]
            part = {k: v[mine] for k, v in score.items()}
            if name == "latin":
                families = [f for f in LATIN_FAMILIES if any((f, g) in part or (g, f) in part for g in LATIN_FAMILIES)]
                best, margin = self._duel(families, part, len(mine))
                sure[mine] *= 1 / (1 + np.exp(-2 * margin))
            else:
                best = np.zeros(len(mine), int)
            for f, family in enumerate(families):
                of = np.flatnonzero(best == f)
                langs = [x for x in FAMILIES[family] if len(FAMILIES[family]) == 1 or any(x in k for k in part)]
                if not len(of) or not langs:
                    continue
                won, margin = self._duel(langs, {k: v[of] for k, v in part.items()}, len(of))
                lang[mine[of]] = np.array(langs, object)[won]
                if len(langs) > 1:
                    sure[mine[of]] *= 1 / (1 + np.exp(-2 * margin))
        sure[[x is None for x in lang]] = 0.0
        return lang.tolist(), sure


def fit(lines: list[tuple[str, str]]) -> Model:
    """Fit the machines on (language, consistent line) pairs; languages without a line take no part."""
    lines = [(lang, t) for lang, t in lines if lang in FAMILY_OF and t and t.strip()]
    model = Model()
    for attempt in range(2):
        if attempt:
            guess, _ = model.predict([t for _, t in lines])
            lines = [x for x, g in zip(lines, guess) if x[0] == g]
        langs = [lang for lang, _ in lines]
        if not lines:
            break
        cp, row = _codepoints([t for _, t in lines])
        idx, at = _ngrams(cp, row)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(lines))))
        here = set(langs)
        duels = [(a, b, set(FAMILIES[a]), set(FAMILIES[b])) for i, a in enumerate(LATIN_FAMILIES) for b in LATIN_FAMILIES[i + 1 :]]
        duels += [(a, b, {a}, {b}) for fam in FAMILIES.values() for i, a in enumerate(fam) for b in fam[i + 1 :]]
        machines = {}
        for a, b, left, right in duels:
            if left & here and right & here:
                y = np.array([1 if x in left else -1 if x in right else 0 for x in langs])
                use = y != 0
                new = np.cumsum(use) - 1
                pick = use[at]
                machines[a, b] = _fit(idx[pick], new[at[pick]], y[use], scale[use])
        model = Model(machines)
    return model


def sample_lines(df: DataFrame, text: str, label: str, key: str, per_language: int = LINES_PER_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample of labelled lines, chosen by hash; (language, line in consistent form), in an order that depends on the rows only.

    At most ``per_language`` lines of each language in expectation and four times that in any case, ``LINE_CHARS`` of each.
    """
    lines = df.select(F.col(key).alias("k"), base_code(F.col(label)).alias("lang"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where("lang is not null and trim(line) <> ''")
    counts = {r["lang"]: r["n"] for r in lines.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # at most one row a language
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    chance = F.pmod(F.xxhash64("k", "pos"), F.lit(1 << 30)) / float(1 << 30)
    order = [F.col("chance"), F.col("k"), F.col("pos"), F.col("line")]
    chosen = lines.withColumn("chance", chance).where(F.col("chance") < share[F.col("lang")]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= 4 * per_language)
    rows = chosen.select("lang", "n", consistent_form(F.substring("line", 1, LINE_CHARS)).alias("line")).collect()  # at most 4 * per_language a language
    return [(r["lang"], r["line"]) for r in sorted(rows, key=lambda r: (r["lang"], r["n"]))]


def listed_words(known: DataFrame, per_language: int = LISTED_WORDS) -> list[tuple[str, str]]:
    """Listed words of one language only, at most ``per_language`` times the languages of them, as lines to fit on, in order."""
    own = known.where("word is not null").groupBy(F.lower("word").alias("w")).agg(F.min("lang").alias("lang"), F.count_distinct("lang").alias("n")).where("n = 1")
    chosen = own.select(base_code(F.col("lang")).alias("lang"), consistent_form(F.col("w")).alias("w")).orderBy(F.xxhash64("w"), "w").limit(per_language * len(LANGUAGES))
    return sorted((r["lang"], r["w"]) for r in chosen.collect() if r["lang"])


@functools.lru_cache(maxsize=2)
def _load(blob: bytes) -> Model:
    return pickle.loads(blob)


def identify(col: Column, model: Model) -> Column:
    """Column -> Column struct<lang, confidence>: of a text as a whole, (null, 0) for null and texts without letters."""
    blob = pickle.dumps(model)

    @F.arrow_udf("struct<lang:string,confidence:double>")
    def whole(texts: pa.Array) -> pa.Array:
        lang, sure = _load(blob).predict([t or "" for t in normalize_array(texts).to_pylist()])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["lang", "confidence"])

    return whole.asNondeterministic()(col)  # else a filter on the result would evaluate it once more


def identify_lines(col: Column, model: Model) -> Column:
    """Column -> Column array<struct<part_no, chars, lang, confidence>>: of each non-blank line; empty for null."""
    blob = pickle.dumps(model)
    kind = pa.struct([("part_no", pa.int64()), ("chars", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())])

    @F.arrow_udf("array<struct<part_no:bigint,chars:bigint,lang:string,confidence:double>>")
    def lines(texts: pa.Array) -> pa.Array:
        flat, part, ends = [], [], [0]
        for t in normalize_array(texts).to_pylist():
            for i, line in enumerate((t or "").split("\n"), 1):
                if line.strip():
                    flat.append(line)
                    part.append(i)
            ends.append(len(flat))
        lang, sure = _load(blob).predict(flat)
        values = pa.StructArray.from_arrays([pa.array(part, pa.int64()), pa.array([len(x.strip()) for x in flat], pa.int64()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return lines.asNondeterministic()(col)


def label_documents(df: DataFrame, model: Model, key: str, text: str, label: str) -> DataFrame:
    """(key, label, lang, confidence, lines): main language of each document, the one with most characters.

    Null, empty and blank texts have no language (null, confidence 0). Map-only.
    """
    out = df.select(F.col(key), F.col(label).alias("label"), identify_lines(F.col(text), model).alias("lines"))
    total = lambda lang: F.aggregate(F.filter("lines", lambda x: x["lang"] == lang), F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
    sums = F.transform(F.array_distinct(F.transform(F.filter("lines", lambda x: x["lang"].isNotNull()), lambda x: x["lang"])), lambda lang: F.struct(total(lang).alias("chars"), lang.alias("lang")))
    out = out.withColumn("_top", F.array_max(sums))
    weight = F.aggregate(F.filter("lines", lambda x: x["lang"] == F.col("_top.lang")), F.lit(0.0), lambda a, x: a + x["chars"] * x["confidence"])
    all_chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
    return out.select(key, "label", F.col("_top.lang").alias("lang"), F.coalesce(F.try_divide(weight, all_chars), F.lit(0.0)).alias("confidence"), "lines")


def label_segments(segments: DataFrame, words: DataFrame, model: Model, key: str, entity: str, start: str, text: str, label: str, at_least: int = 3) -> DataFrame:
    """(key, label, lang, confidence, words) of segments with ``at_least`` delivered words; copies count once under the lowest key.

    One shuffle of the words by segment does for both counting distinct words and the join.
    """
    spoken = words.where(F.col(entity).isNotNull() & F.col(start).isNotNull()).select(entity, start, "word_start", "word_end").repartition(entity, start)
    spoken = spoken.groupBy(entity, start, "word_start", "word_end").agg(F.lit(1).alias("one")).groupBy(entity, start).agg(F.count("*").alias("words")).where(F.col("words") >= at_least)
    first = segments.groupBy(entity, start).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")), key).alias("s"))
    both = first.join(spoken, [entity, start])
    out = both.select(F.col("s.k").alias(key), F.col("s.l").alias("label"), identify(F.col("s.t"), model).alias("p"), "words")
    return out.select(key, "label", F.col("p.lang").alias("lang"), F.col("p.confidence").alias("confidence"), "words")


def _word_features(model: Model, names: tuple[str, str], other: str, words: list[str], yes: np.ndarray, no: np.ndarray, in_home: np.ndarray, in_other: np.ndarray) -> np.ndarray:
    """Rows of a word's features, each towards ``other`` if positive: what the family machine says of its letters, its marks in all rows, the two lists, and one."""
    score = model.scores(words)[0].get(names) if words else None
    letters = np.zeros(len(words)) if score is None else np.clip(score if names[0] == FAMILY_OF[other] else -score, -2, 2)
    marks = np.clip(np.log((yes + 0.5) / (no + 0.5)), -3, 3)
    return np.stack([letters, marks, -3.0 * in_home, 3.0 * in_other, np.ones(len(words))], axis=1)


def fit_words(features: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Weights of the machine between two languages of single words, fitted on listed words (side 1: the other language).

    Each word counts with and without its lists, so that letters and marks are weighed for
    words that no list has. Words that the first fit, without lists, puts elsewhere are
    left out of the second, as a list may lack a word's other language.
    """
    plain = features.copy()
    plain[:, 2:4] = 0
    every = np.arange(features.shape[1])
    rows = lambda x: [(every, v) for v in x]
    if not (side > 0).any() or not (side < 0).any():
        return np.array([1.0, 0.5, 1.0, 1.0, 0.0])  # nothing to fit on: letters, marks and lists as they stand
    w = _descend(rows(plain), side, len(every), rounds=60)
    good = np.sign(plain @ w) == side
    if not (side[good] > 0).any() or not (side[good] < 0).any():
        return w
    both = np.concatenate([plain[good], features[good]])
    return _descend(rows(both), np.concatenate([side[good], side[good]]), len(every), rounds=60)


def label_words(df: DataFrame, model: Model, known: DataFrame, word: str, switched: str | None = None, home: str = "cy", other: str = "en") -> DataFrame:
    """One row per distinct word: (w, lang, confidence): ``home`` or ``other``.

    A one-versus-one machine decides, on what the machine between the two families says of
    the word's letters, on its own marks in all rows (if ``switched`` names them) and on the
    list of known words; it is fitted on at most ``LISTED_WORDS`` listed words of each
    language. A word that the list has in ``home`` is ``home`` in any case, as words of both
    languages count as that.
    """
    w = F.lower(consistent_form(F.col(word)))
    mark = F.col(switched).cast("int") if switched else F.lit(None).cast("int")
    marks = df.where(F.col(word).isNotNull()).select(w.alias("w"), mark.alias("m")).groupBy("w").agg(F.sum("m").alias("yes"), F.sum(1 - F.col("m")).alias("no"))
    listed = known.where(F.col("lang").isin(home, other)).select(F.lower("word").alias("w"), (F.col("lang") == home).alias("h")).where("w is not null").groupBy("w").agg(F.max("h").alias("in_home"), F.max(~F.col("h")).alias("in_other"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    marks = marks.join(listed, "w", "left").select("w", none("yes"), none("no"), flag("in_home"), flag("in_other"))
    a, b = FAMILY_OF[home], FAMILY_OF[other]
    names = (a, b) if (a, b) in model.machines else (b, a)
    one = F.col("in_home") != F.col("in_other")
    by = Window.partitionBy("in_home").orderBy(F.xxhash64("w"), "w")
    taught = sorted(marks.where(one).withColumn("n", F.row_number().over(by)).where(F.col("n") <= LISTED_WORDS).collect(), key=lambda r: r["w"])  # at most LISTED_WORDS a language
    column = lambda c: np.array([float(r[c]) for r in taught])
    x = _word_features(model, names, other, [r["w"] for r in taught], column("yes"), column("no"), column("in_home"), column("in_other"))
    weights = fit_words(x, np.where(column("in_other") > 0, 1, -1))
    blob = pickle.dumps(model)

    @F.arrow_udf("double")
    def margin(texts: pa.Array, yes: pa.Array, no: pa.Array, in_home: pa.Array, in_other: pa.Array) -> pa.Array:
        n = lambda c: c.cast(pa.float64()).to_numpy(zero_copy_only=False)
        return pa.array(_word_features(_load(blob), names, other, [t or "" for t in texts.to_pylist()], n(yes), n(no), n(in_home.cast(pa.int8())), n(in_other.cast(pa.int8()))) @ weights, pa.float64())

    scored = marks.withColumn("_m", margin.asNondeterministic()("w", "yes", "no", "in_home", "in_other"))
    lang = F.when(F.col("in_home") | (F.col("_m") <= 0), home).otherwise(other)
    sure = F.when(F.col("in_home") & (F.col("_m") > 0), 0.5).otherwise(1 / (1 + F.exp(-2 * F.abs("_m"))))
    return scored.select("w", lang.alias("lang"), sure.alias("confidence"))


def label_spoken(words: DataFrame, segments: DataFrame, known: DataFrame, model: Model, word_model: Model, home: str = "cy", other: str = "en") -> DataFrame:
    """(word_id, lang, confidence) of every row of ``words`` (word_id, video_url, segment_start, word, language).

    A word has the language of the segment it is spoken in; in speech of ``home`` a word of
    ``other`` has that. Where no segment says more, the word is judged by itself. The
    segments are labelled once each, the words once each distinct one, their delivered
    labels being the marks. A null word has no language (null, confidence 0).
    """
    mark = F.when(base_code(F.col("language")).isin(home, other), base_code(F.col("language")) == other)
    own = label_words(words.select("word", mark.alias("m")), word_model, known, "word", "m", home, other).select("w", F.struct("lang", "confidence").alias("own"))
    first = segments.where("video_url is not null and segment_start is not null").groupBy("video_url", "segment_start").agg(F.min_by("segment_text", "segment_id").alias("t"))
    said = first.select("video_url", "segment_start", identify(F.col("t"), model).alias("seg"))
    rows = words.select("word_id", "video_url", "segment_start", F.lower(consistent_form(F.col("word"))).alias("w"))
    rows = rows.join(said, ["video_url", "segment_start"], "left").join(own, "w", "left")
    seg, word = F.col("seg"), F.col("own")
    best = F.when(rows["w"].isNull(), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))).when(seg["lang"].isNull() | (seg["lang"] == home), F.when(seg["lang"].isNull() | (word["lang"] == other), word).otherwise(seg)).otherwise(seg)
    return rows.select("word_id", best.alias("p")).select("word_id", "p.lang", "p.confidence")
