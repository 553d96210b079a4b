"""Column -> Column functions on words and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gwerin import tables as T


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def compose(word: Column) -> Column:
    """Letters with a combining mark behind them as one character, for the marks that the language's letters carry; word in lower case."""
    out = word
    for mark, letters in T.MARKED.items():
        for plain, whole in zip(letters[::2], letters[1::2]):
            out = F.replace(out, F.lit(plain + mark), F.lit(whole))
    return F.when(word.rlike("[" + "".join(T.MARKED) + "]"), out).otherwise(word)


def normalize_word(word: Column) -> Column:
    """Lower case, marks composed, straight quotes, edges stripped, clitic 'r removed and 'n spelt yn; null and empty give the empty text."""
    s = compose(F.lower(F.translate(F.coalesce(word, F.lit("")), "“”‘’", "\"\"''")))
    s = F.btrim(s, F.lit(".,!?;:'\"()[]"))
    return F.replace(F.replace(s, F.lit("'r"), F.lit("")), F.lit("'n"), F.lit("yn"))


def initial_cluster(word: Column) -> Column:
    """Longest leading cluster, else the first character."""
    return F.regexp_extract(word, "^(" + "|".join(T.CLUSTERS) + "|.)", 1)


def surface_type(word: Column) -> Column:
    """Type of change that a word's beginning looks like; null if none."""
    return F.try_element_at(literal_map(T.SURFACE_TYPE), initial_cluster(word))


def is_english(word: Column, in_other: Column | None = None, in_home: Column | None = None) -> Column:
    """Code switch: an English function word that is no homograph, or a word that only the other list knows."""
    function = word.isin([w for w in T.ENGLISH_FUNCTION_WORDS if w not in T.HOMOGRAPHS])
    if in_other is None:
        return function
    return function | (in_other & ~in_home & ~word.startswith("ts") & ~word.startswith("j"))


def plausible_letters(word: Column) -> Column:
    """Every marked letter is one of the language's."""
    return ~F.lower(word).rlike(rf"[À-ɏ&&[^{T.LEGAL_MARKED}]]|\p{{M}}")


def plausible_word(word: Column) -> Column:
    """No impossible pair of letters and no more than three consonants in a row, clusters counting as one."""
    pairs = F.lower(word).rlike("|".join(T.IMPOSSIBLE_PAIRS))
    collapsed = F.regexp_replace(F.lower(word), "|".join(sorted(T.SINGLE_CLUSTERS, key=len, reverse=True)), "V")
    return ~pairs & ~collapsed.rlike(f"[^{T.VOWELS}V]{{4,}}")


def forward_form(radical: Column, kind: str) -> Column:
    """The radical with its first matching source, longest first, changed as ``kind`` has it; null if none applies."""
    out = F.lit(None).cast("string")
    for source, target in sorted(T.FORWARD[kind].items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(radical.startswith(source), F.concat(F.lit(target), F.substring(radical, len(source) + 1, 1 << 30))).otherwise(out)
    return F.nullif(out, F.lit(""))


def surface_forms(radical: Column, expected: Column) -> Column:
    """Array of distinct forms that the expected types make of a radical."""
    forms = [F.when(F.array_contains(expected, k), forward_form(radical, k)) for k in T.FORWARD]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def reverse_candidates(surface: Column, expected: Column | None = None) -> Column:
    """Sorted array of radicals that some change turns into the surface form; only the types of ``expected``, if given."""
    cluster, out = initial_cluster(surface), []
    asked = (lambda kind: F.lit(True)) if expected is None else (lambda kind: F.array_contains(expected, kind))
    for kind in ("soft", "soft_limited", "nasal", "aspirate", "colloquial_affricate"):
        for source, target in T.FORWARD[kind].items():
            rest = F.substring(surface, len(target) + 1, 1 << 30)
            shows = surface.rlike(f"^[{T.VOWELS}]") if target == "" else cluster == target
            out.append(F.when(asked(kind) & shows, F.concat(F.lit(source), rest)))
    if expected is not None:
        out.append(F.when(asked("h-mutation") & surface.rlike(f"^h[{T.VOWELS}]"), F.substring(surface, 2, 1 << 30)))
    return F.array_sort(F.array_distinct(F.array_except(F.array_compact(F.array(*out)), F.array(surface))))


def coarse_pos(tag: Column) -> Column:
    """Sorted distinct coarse classes of a tag's parts, joined by |."""
    part = lambda p: (
        F.when(p.startswith("PREP") | p.startswith("CPREP"), "ADP").when(p.startswith("VB") | p.startswith("VERB"), "VERB").when(p.startswith("ADJ") | p.startswith("ORD"), "ADJ").when(p.startswith("ADV"), "ADV")
        .when(p.startswith("PRON"), "PRON").when(p.startswith("N") | p.startswith("PLACE") | p.startswith("PERSON"), "NOUN").when(p.startswith("CARD"), "NUM").when(p.startswith("CONJ"), "CONJ").otherwise("other")
    )
    parts = F.split(tag, r"[+|]")
    return F.when(tag.isNull() | tag.isin("", "?", "none", "n/a"), "unknown").otherwise(F.array_join(F.array_sort(F.array_distinct(F.transform(parts, part))), "|"))


def tag_gender(tag: Column) -> Column:
    """F or M behind the first gender-bearing prefix of a tag."""
    mark = F.regexp_extract(tag, r"^(?:N|PRON|CARD|ORD)(F|M)$", 1)
    return F.when(mark == "F", "feminine").when(mark == "M", "masculine")


def parse_span(span: Column) -> tuple[Column, Column]:
    """Start and end in seconds of '12.3s - 15.1s'."""
    p = r"([\d.]+)s\s*-\s*([\d.]+)s"
    return F.regexp_extract(span, p, 1).try_cast("double"), F.regexp_extract(span, p, 2).try_cast("double")


def to_bool(value: Column) -> Column:
    s = F.lower(F.trim(value.cast("string")))
    return F.when(s.isin("true", "1", "yes"), True).when(s.isin("false", "0", "no"), False)


def agreement(value: Column) -> Column:
    """Older boolean values of tagger agreement as today's names; n/a and the like are null."""
    s = F.lower(F.trim(value))
    return F.when(value.isin(T.NULLS), None).when(s == "true", "cysill+heuristic").when(s == "false", "disputed").otherwise(value)


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def mmss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def slug(title: Column) -> Column:
    """Folder name of a title: word characters only, blanks to _, at most 60."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.substring(F.btrim(s, F.lit("_")), 1, 60), F.lit("")), F.lit("untitled"))


def highlight(text: Column, word: Column, left: str = "[", right: str = "]") -> Column:
    """Each whole-word occurrence, whatever its case, between the marks."""
    return F.when(word.isNull() | (word == "[OMITTED]") | (word == ""), text).otherwise(F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b(\Q"), word, F.lit(r"\E)\b")), F.lit(f"{left}$1{right}")))


def differs_only_in_initial(a: Column, b: Column) -> Column:
    rest = lambda w: F.substring(w, F.length(initial_cluster(w)) + F.lit(1), F.lit(1 << 30))
    return (a != b) & (rest(a) == rest(b))


def change_of(word: Column, lemma: Column) -> Column:
    """How a word differs from a lemma: radical, soft, nasal or aspirate; null if no change of its beginning makes it. Of two types that give one form the later counts."""
    cluster = initial_cluster(lemma)
    rest = F.substring(lemma, F.length(cluster) + F.lit(1), F.lit(1 << 30))
    made = lambda kind: F.concat(F.try_element_at(literal_map(T.FORWARD[kind]), cluster), rest) == word
    return F.when(made("aspirate"), "aspirate").when(made("nasal"), "nasal").when(made("soft"), "soft").when(word == lemma, "radical")
