"""Schemas that drift between files (problem 6).

Each file of a series is profiled by field: JSON type, kinds of values and, for fields that
went or came, a sketch of their values. Between neighbouring files, fields that went and
fields that came are paired by bipartite matching: two match if their values agree in every
fact that holds both, and among several possible partners the one with more agreement, the
more similar sketch and the more similar name wins. Renames are followed through each
series, so that a field keeps one identity under changing names, and all facts are read
into one table with one typed column per field.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gwerin.operators.assignment import assign
from gwerin.operators.carry import last_before, sum_before
from gwerin.session import sent, written

SKETCH = 6  # log2 of the entries of a sketch of a field's values: bounded, and merged in the map
FEW = 50_000  # fields that went or came up to which their list is sent to the values; beyond, values are shuffled to it
KINDS = ["boolean", "whole number", "decimal number", "string", "nested"]
# what a value can be read as, however it is written
CLASSES = ["flag", "bit", "whole", "decimal", "text"]
TRUE, FALSE = ["true", "yes"], ["false", "no"]
OWN = ["rec_id", "series", "file_name", "row_no", "broken", "rest"]


def _stamp(name: Column | str) -> list[Column]:
    """stamp and day of a file name: the order of files, and a number that rises with it."""
    return [F.regexp_extract(name, r"(\d{8}_\d{6})", 1).alias("stamp"), F.coalesce(F.regexp_extract(name, r"(\d{8})_\d{6}", 1).try_cast("bigint"), F.lit(0)).alias("day")]


def delivered(records: DataFrame) -> DataFrame:
    """(rec_id, series, file_name, row_no, record): rows that agree in (file_name, row_no) once, under the lowest rec_id; without a file name none."""
    once = records.where("file_name is not null").groupBy("file_name", "row_no").agg(F.min_by(F.struct("rec_id", "series", "record"), "rec_id").alias("r"))
    return once.select(F.col("r.rec_id").alias("rec_id"), F.coalesce("r.series", F.lit("")).alias("series"), "file_name", "row_no", F.col("r.record").alias("record"))


def _object(record: str) -> Column:
    """The record as a variant; null unless it is one JSON object that names no key twice."""
    v = F.try_parse_json(record)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def fields(once: DataFrame) -> DataFrame:
    """Long form: (series, file_name, fact, field, kind, value) of every field of delivered rows.

    A record that is null, broken, no JSON object or names a key twice holds no field. A
    field that is null has a null kind. Whole and decimal numbers compare by value. ``fact``
    is a 128-bit hash of the fact's identity.
    """
    rows = once.select("series", "file_name", _object("record").alias("v")).where("v is not null")
    fact = F.struct(*[F.xxhash64(F.try_variant_get("v", "$.video_url", "string"), F.try_variant_get("v", "$.timestamp", "string"), F.lit(seed)).alias(f"f{seed}") for seed in (1, 2)])
    long = rows.withColumn("fact", fact).lateralJoin(once.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.col("value").alias("x")))
    kind = F.schema_of_variant("x")
    text = F.try_variant_get("x", "$", "string")
    number = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    of = F.when(kind == "BIGINT", "whole number").when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "decimal number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind != "VOID", "nested")
    value = F.when(of.isin("whole number", "decimal number"), F.concat(F.lit("n"), number)).when(of.isNotNull(), F.concat(F.substring(of, 1, 1), F.coalesce(text, F.to_json("x"))))
    return long.select("series", "file_name", "fact", "field", of.alias("kind"), value.alias("value"))


def _class() -> Column:
    """One of CLASSES for a value of ``fields``."""
    kind, said = F.col("kind"), F.expr("substring(value, 2)")
    number = kind.isin("whole number", "decimal number", "string")
    return (
        F.when(kind.isNull(), None).when((kind == "boolean") | (kind == "string") & F.lower(said).isin(TRUE + FALSE), "flag").when(number & said.isin("0", "1"), "bit")
        .when(number & said.rlike(r"^-?\d{1,18}(\.0+)?$"), "whole").when((kind == "decimal number") | (kind == "string") & said.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "decimal").otherwise("text")
    )


def profile(long: DataFrame) -> DataFrame:
    """(series, file_name, stamp, day, field, kind, and a count of each of CLASSES): one row per field of a file, counted in the map.

    Of several kinds decimal covers whole; else the most frequent counts.
    """
    count = lambda of, names: [F.sum(F.when(of == k, 1).otherwise(0)).alias(k) for k in names]
    out = long.withColumn("class", _class()).groupBy("series", "file_name", "field").agg(*count(F.col("kind"), KINDS), *count(F.col("class"), CLASSES))
    whole = F.when(F.col("decimal number") > 0, 0).otherwise(F.col("whole number"))
    both = F.when(F.col("decimal number") > 0, F.col("decimal number") + F.col("whole number")).otherwise(0)
    top = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(k).alias("k")) for k, c in (("boolean", F.col("boolean")), ("decimal number", both), ("nested", F.col("nested")), ("string", F.col("string")), ("whole number", whole))]))
    return out.select("series", "file_name", *_stamp("file_name"), "field", F.when(top["n"] > 0, top["k"]).alias("kind"), *CLASSES)


def name_similarity(a: Column, b: Column) -> Column:
    """Between 0 and 1: shared words of two field names, equal when only their spelling differs."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")), "[-_]"), ""))
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


def _pairs(candidates: Column) -> Column:
    """Best one-to-one pairs among an array of (old_name, new_name, score): an assignment per row of the batch."""

    @F.arrow_udf("array<struct<old_name:string,new_name:string>>")
    def best(batch: pa.Array) -> pa.Array:
        out = []
        for some in batch.to_pylist():
            old, new = sorted({x["old_name"] for x in some}), sorted({x["new_name"] for x in some})
            at, to = {n: i for i, n in enumerate(old)}, {n: i for i, n in enumerate(new)}
            score = np.zeros((len(old), len(new)))
            for x in some:
                score[at[x["old_name"]], to[x["new_name"]]] = x["score"]
            out.append([{"old_name": old[i], "new_name": new[j]} for i, j in enumerate(assign(-score)) if j >= 0 and score[i, j] > 0])
        return pa.array(out, pa.list_(pa.struct([("old_name", pa.string()), ("new_name", pa.string())])))

    return best(candidates)


def _moved(long: DataFrame, diff: DataFrame) -> DataFrame:
    """(file_name, change, old_name, new_name) of fields that went or came; ``diff`` has series, file_name, before, old_name, new_name, one name of a row being null."""
    gone, new = diff.where("old_name is not null").drop("new_name"), diff.where("new_name is not null").drop("old_name")
    # values of those fields by fact, brought together by one exchange; a fact with two values in a file equals only itself
    asked = gone.select("series", F.col("before").alias("file_name"), F.col("file_name").alias("now"), F.col("old_name").alias("field"), F.lit(True).alias("old")).unionByName(
        new.select("series", "file_name", F.col("file_name").alias("now"), F.col("new_name").alias("field"), F.lit(False).alias("old"))
    )
    h = [F.xxhash64("value", F.lit(seed)).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    values = written(long.where("value is not null").join(sent(asked, FEW), ["series", "file_name", "field"]).select("now", "old", "field", "fact", *h))  # read for facts and for sketches
    cells = values.repartition("now", "fact").groupBy("now", "fact", "old", "field").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "ab"])
    marks = ["lo_a", "lo_b", "hi_a", "hi_b"]
    side = lambda is_old, name, tail: cells.where(F.col("old") == is_old).select("now", "fact", F.col("field").alias(name), *[F.col(c).alias(c + tail) for c in marks])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{c}2") for c in marks])
    agree = side(True, "old_name", "").join(side(False, "new_name", "2"), ["now", "fact"]).groupBy(F.col("now").alias("file_name"), "old_name", "new_name").agg(F.count("*").alias("both"), F.sum(same.cast("long")).alias("equal"))

    sketch = values.groupBy("now", "old", "field").agg(F.theta_sketch_agg("a", SKETCH).alias("k"))
    old_k, new_k = (sketch.where(F.col("old") == o).select(F.col("now").alias("file_name"), F.col("field").alias(name), F.col("k").alias(out)) for o, name, out in ((True, "old_name", "k1"), (False, "new_name", "k2")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    pairs = gone.select("file_name", "old_name").join(new.select("file_name", "new_name"), "file_name").join(agree, ["file_name", "old_name", "new_name"], "left")
    pairs = pairs.withColumn("alike", name_similarity(F.col("old_name"), F.col("new_name"))).where(((zero("both") > 0) & (zero("equal") == zero("both"))) | ((zero("both") == 0) & (F.col("alike") >= 0.5)))
    pairs = pairs.join(old_k, ["file_name", "old_name"], "left").join(new_k, ["file_name", "new_name"], "left")
    shared = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("k1", "k2")) / F.greatest(F.lit(1), F.theta_sketch_estimate(F.theta_union("k1", "k2"))), F.lit(0.0))
    scored = pairs.select("file_name", F.struct("old_name", "new_name", (1 + zero("both") + F.col("alike") + shared).cast("double").alias("score")).alias("p"))
    renamed = written(scored.groupBy("file_name").agg(F.collect_list("p").alias("c")).select("file_name", F.explode(_pairs(F.col("c"))).alias("p")).select("file_name", "p.*"))  # read three times
    left = gone.join(renamed, ["file_name", "old_name"], "left_anti").select("file_name", F.lit("removed").alias("change"), "old_name", F.lit("").alias("new_name"))
    came = new.join(renamed, ["file_name", "new_name"], "left_anti").select("file_name", F.lit("added").alias("change"), F.lit("").alias("old_name"), "new_name")
    return renamed.select("file_name", F.lit("renamed").alias("change"), "old_name", "new_name").unionByName(left).unionByName(came)


def _changes(long: DataFrame, prof: DataFrame) -> DataFrame:
    files = prof.select("series", "file_name", "stamp", "day").distinct().withColumn("me", F.struct("file_name"))
    files = last_before(files, ["series"], "day", ["stamp", "file_name"], "me", "before").select("series", "file_name", F.col("before.file_name").alias("before"))
    pairs = written(files.where("before is not null"))

    then = prof.join(pairs.select("series", F.col("before").alias("file_name"), F.col("file_name").alias("now")), ["series", "file_name"]).select("series", "now", F.col("file_name").alias("before"), F.col("field").alias("f"))
    now = prof.join(pairs, ["series", "file_name"]).select(F.col("series").alias("s2"), F.col("file_name").alias("n2"), F.col("before").alias("b2"), F.col("field").alias("f2"))
    both = then.join(now, (F.col("series") == F.col("s2")) & (F.col("now") == F.col("n2")) & (F.col("f") == F.col("f2")), "full_outer")
    diff = written(both.where("f is null or f2 is null").select(F.coalesce("series", "s2").alias("series"), F.coalesce("now", "n2").alias("file_name"), F.coalesce("before", "b2").alias("before"), F.col("f").alias("old_name"), F.col("f2").alias("new_name")))

    kinds = last_before(prof.select("series", "field", "day", "stamp", "file_name", "kind"), ["series", "field"], "day", ["stamp", "file_name"], "kind", "had")
    stayed = kinds.where("kind <> had").join(pairs, ["series", "file_name"]).join(prof.select("series", F.col("file_name").alias("before"), "field"), ["series", "before", "field"], "left_semi")
    return _moved(long, diff).unionByName(stayed.select("file_name", F.lit("type").alias("change"), F.col("field").alias("old_name"), F.col("field").alias("new_name")))


def changes(records: DataFrame) -> DataFrame:
    """(file_name, change, old_name, new_name) against the file before in the same series.

    Files are ordered by the stamp in their name, then by name. A task of the matching
    holds the candidate pairs of a file's fields; values are compared only for fields that
    went or came.
    """
    once = written(delivered(records))  # read for the profiles and again for values
    long = fields(once)
    return _changes(long, written(profile(long)))


def identities(usage: DataFrame, report: DataFrame) -> DataFrame:
    """(series, file_name, field, label): which field of the series a name stands for in each file.

    A field is labelled by the name at the start of its chain of renames. A name that comes
    back though its field lives on under another one is a field of its own, name#2, name#3
    and so on. ``usage`` and ``report`` have series, file_name, stamp and day.
    """
    at = ["series", "day", "stamp", "file_name"]
    none = F.lit(None).cast("struct<what:string,file_name:string,old_name:string>")
    event = lambda rows, name, side, what, old: rows.select(*at, F.col(name).alias("name"), F.lit(side).alias("side"), F.struct(F.lit(what).alias("what"), "file_name", old.alias("old_name")).alias("e"))
    renamed, added = report.where("change = 'renamed'"), report.where("change = 'added'")
    null = F.lit(None).cast("string")
    events = event(renamed, "old_name", 1, "out", null).unionByName(event(renamed, "new_name", 2, "in", F.col("old_name"))).unionByName(event(added, "new_name", 2, "added", null))
    asks = renamed.select(*at, F.col("old_name").alias("name"), F.lit(0).alias("side"), none.alias("e")).unionByName(usage.select(*at, F.col("field").alias("name"), F.lit(3).alias("side"), none.alias("e")))
    # each step is written, as the next reads it twice
    line = last_before(written(events.unionByName(asks)), ["series", "name"], "day", ["stamp", "file_name", "side"], "e", "last")
    line = line.withColumn("reborn", ((F.col("e.what") == "added") & F.coalesce(F.col("last.what") == "out", F.lit(False))).cast("long")).withColumn("came", F.when(F.col("e.what") != "out", F.col("e"))).drop("last")
    line = last_before(written(line), ["series", "name"], "day", ["stamp", "file_name", "side"], "came", "from")
    line = sum_before(written(line), ["series", "name"], "day", ["stamp", "file_name", "side"], "reborn", "births").where("side in (0, 3)")
    label = F.when(F.col("births") > 0, F.concat("name", F.lit("#"), F.col("births") + 1)).otherwise(F.col("name"))
    line = written(line.select("series", "file_name", "name", "side", label.alias("label"), F.when(F.col("from.what") == "in", F.struct(F.col("from.file_name").alias("file_name"), F.col("from.old_name").alias("name"))).alias("parent")))

    # each rename points to the one that gave its old name; pointers are doubled until all reach the start
    links = line.where("side = 0").drop("side")
    while links.where("parent is not null").limit(1).count():
        above = links.select("series", F.struct("file_name", "name").alias("parent"), F.col("label").alias("label2"), F.col("parent").alias("parent2"))
        links = written(links.join(above, ["series", "parent"], "left").select("series", "file_name", "name", F.coalesce("label2", "label").alias("label"), F.col("parent2").alias("parent")))
    root = links.select("series", F.struct("file_name", "name").alias("parent"), F.col("label").alias("root"))
    return line.where("side = 3").join(root, ["series", "parent"], "left").select("series", "file_name", F.col("name").alias("field"), F.coalesce("root", "label").alias("label"))


def common_names(used: DataFrame) -> dict[str, str]:
    """Label -> name of the field over all series, for labels that are not their own name.

    A field that one series begins under a name which another series gave it by renaming
    has the other's label, unless the two ever stand in one file. Only the vocabulary of
    names reaches the driver: one row per pair of a name and a label.
    """
    pairs = {(r["field"], r["label"]) for r in used.select("field", "label").distinct().collect()}
    labels = {label for _, label in pairs}
    to: dict[str, str] = {}
    for field, label in sorted(pairs):
        if field != label and field in labels:
            to.setdefault(field, label)
    barred: set[str] = set()
    while True:
        out = {}
        for label in sorted(set(to) - barred):
            seen, end = [label], to[label]
            while end in to and end not in barred and end not in seen:
                seen.append(end)
                end = to[end]
            if end in seen:  # a circle of renames: its first name in order
                end = min(seen[seen.index(end) :])
            if end != label:
                out[label] = end
        if not out:
            return out
        table = used.sparkSession.createDataFrame(list(out.items()), "label string, common string")
        clash = used.join(table, "label", "left").groupBy("series", "file_name", F.coalesce("common", "label").alias("common")).agg(F.collect_set("label").alias("l")).where(F.size("l") > 1)
        hit = {x for r in clash.select(F.explode("l").alias("x")).distinct().collect() for x in [r["x"]] if x in out}
        if not hit:
            return out
        barred |= hit


def _type(n: dict[str, int]) -> str:
    """Column type that most values of a field can be read as."""
    if 2 * n["text"] >= sum(n.values()):
        return "string"
    if n["flag"] and n["flag"] >= n["whole"] + n["decimal"]:
        return "boolean"
    return "double" if n["decimal"] else "bigint"


def _read(kind: str, said: Column) -> Column:
    if kind == "boolean":
        return F.when(F.lower(said).isin(*TRUE, "1", "1.0"), True).when(F.lower(said).isin(*FALSE, "0", "0.0"), False)
    if kind == "bigint":
        return F.regexp_extract(said, r"^(-?\d{1,19})(?:\.0*)?$", 1).try_cast("bigint")
    return said.try_cast(kind) if kind == "double" else said


def unify(records: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """All facts in one table: rec_id, series, file_name, row_no, broken, one typed column per field, rest.

    Re-delivered rows count once. A field has one column, named as it was first, whatever
    its names in the files, of the type that most of its values can be read as: boolean
    (true, yes, 1, ...), bigint, double or string. Values that can't be read so stay as text
    in ``rest`` (column -> text; null if there is none). A record that is null, broken, no
    object or names a key twice keeps its row with ``broken`` true. A column that would
    clash with another one, case ignored, gets underscores at its end. The list of
    columns, as of any table, is on the driver.
    """
    once = written(delivered(records))
    long = fields(once)
    prof = written(profile(long))
    report = written(_changes(long, prof)) if report is None else report
    files = prof.select("series", "file_name").distinct()
    usage = prof.select("series", "file_name", "stamp", "day", "field")
    used = written(identities(usage, report.join(files, "file_name").select("series", "file_name", *_stamp("file_name"), "change", "old_name", "new_name")))
    common = common_names(used)

    counts: dict[str, dict[str, int]] = {}
    for r in used.join(prof, ["series", "file_name", "field"]).groupBy("label").agg(*[F.sum(c).alias(c) for c in CLASSES]).collect():  # one row per label
        n = counts.setdefault(common.get(r["label"], r["label"]), dict.fromkeys(CLASSES, 0))
        for c in CLASSES:
            n[c] += r[c]
    columns, taken = {}, {c.lower() for c in OWN}
    for name in sorted(counts):
        out = name
        while out.lower() in taken:
            out += "_"
        taken.add(out.lower())
        columns[name] = out

    spark = records.sparkSession
    table = spark.createDataFrame(list(common.items()), "label string, common string")
    names = used.join(table, "label", "left").select("series", "file_name", "field", F.coalesce("common", "label").alias("name"))
    twice = F.row_number().over(Window.partitionBy("series", "file_name", "name").orderBy("field")) > 1  # never by the above; if ever, the value goes to the rest
    names = names.withColumn("name", F.when(twice, F.concat(F.lit("?"), "field")).otherwise(F.col("name"))).where("name <> field")
    names = names.groupBy("series", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))
    rows = once.withColumn("v", _object("record")).select("rec_id", "series", "file_name", "row_no", F.col("v").isNull().alias("broken"), F.try_variant_get("v", "$", "map<string,string>").alias("raw")).join(names, ["series", "file_name"], "left")
    named = F.map_from_entries(F.transform(F.map_entries("raw"), lambda e: F.struct(F.coalesce(F.try_element_at("names", e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    rows = rows.select("rec_id", "series", "file_name", "row_no", "broken", named.alias("facts"))
    typed = {out: _read(_type(counts[name]), F.try_element_at("facts", F.lit(name))) for name, out in columns.items()}
    if not typed:
        return rows.select("rec_id", "series", "file_name", "row_no", "broken", F.lit(None).cast("map<string,string>").alias("rest"))
    said = {out: F.try_element_at("facts", F.lit(name)) for name, out in columns.items()}
    odd = F.filter(F.array(*[F.struct(F.lit(out).alias("key"), F.when(typed[out].isNull(), said[out]).alias("value")) for name, out in columns.items() if _type(counts[name]) != "string"], *[F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))]), lambda x: x["value"].isNotNull())
    stray = F.filter(F.map_entries("facts"), lambda e: e["value"].isNotNull() & e["key"].startswith("?") & ~e["key"].isin(list(columns)))
    rest = F.concat(odd, F.coalesce(stray, F.array().cast("array<struct<key:string,value:string>>")))
    return rows.select("rec_id", "series", "file_name", "row_no", "broken", *[c.alias(out) for out, c in typed.items()], F.when(F.size(rest) > 0, F.map_from_entries(rest)).alias("rest"))
