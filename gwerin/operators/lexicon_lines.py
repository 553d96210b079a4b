"""Rows that fail to parse (problem 7).

A quote-aware finite-state machine reads the raw records of a batch as one stream. The
stream is cut into chunks; each chunk first becomes a map from entry state to exit state,
the maps are composed over the chunks by doubling, and with the entry states known every
chunk is read at once. Records come out as typed fields or with the first reason that
applies and the offset (in code points) of the field it concerns.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gwerin.functions.batches import slices

# The 17 universal tags.
UD_TAGS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
MORPH = r"^(?:[\p{L}\p{N}]+=[\p{L}\p{N}]+(?:,[\p{L}\p{N}]+)*(?:\|[\p{L}\p{N}]+=[\p{L}\p{N}]+(?:,[\p{L}\p{N}]+)*)*)?$"
FIELDS = 4
CHUNK = 128
SLICE_BYTES = 4 << 20
# states: at a field's start, in a plain field, in a quoted one, behind a quote in a quoted one, wrong
START, PLAIN, QUOTED, CLOSED, WRONG = range(5)
# classes of characters
OTHER, TAB, END, QUOTE = range(4)
NEXT = np.array([[PLAIN, PLAIN, QUOTED, WRONG, WRONG], [START] * 5, [START] * 5, [QUOTED, WRONG, CLOSED, QUOTED, WRONG]], np.uint8)
KIND = pa.struct([("wordform", pa.string()), ("lemma", pa.string()), ("tag", pa.string()), ("morph", pa.string()), ("reason", pa.string()), ("offset", pa.int64())])


@functools.cache
def _allowed() -> np.ndarray:
    """Code points that a wordform or lemma may hold besides quotes: letters with their marks, space, apostrophe, hyphen."""
    out = np.zeros(0x110000, bool)
    for cp in range(0x323B0):
        if unicodedata.category(chr(cp))[0] == "L":
            out[cp] = True
    for ch in " '’-":
        out[ord(ch)] = True
    return out


def states(cls: np.ndarray) -> np.ndarray:
    """State behind each character of a stream of classes that begins at a field's start."""
    n = len(cls)
    width = -(-n // CHUNK)
    grid = np.full(width * CHUNK, OTHER, np.uint8)
    grid[:n] = cls
    grid = grid.reshape(width, CHUNK)
    maps = np.tile(np.arange(5, dtype=np.uint8), (width, 1))
    for k in range(CHUNK):
        maps = NEXT[grid[:, k, None], maps]
    step = 1  # compose the maps of all chunks before each one
    while step < width:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.r_[np.uint8(START), maps[:-1, START]].astype(np.uint8)
    out = np.empty((width, CHUNK), np.uint8)
    for k in range(CHUNK):
        state = NEXT[grid[:, k], state]
        out[:, k] = state
    return out.reshape(-1)[:n]


def parse(lines: pa.Array) -> pa.Array:
    """Raw lines in, typed rows out; a null line has no columns."""
    n = len(lines)
    if not n:
        return pa.array([], KIND)
    texts = pc.replace_substring_regex(pc.fill_null(lines.cast(pa.large_string()), ""), r"\r\z", "")
    texts = pc.replace_substring(texts, "\n", "\x01")  # a line feed inside a line is a character like others
    stream = pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    bounds = np.frombuffer(stream.buffers()[1], np.int64)[stream.offset : stream.offset + n + 1]
    cp = np.frombuffer(stream.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]].decode("utf-8").encode("utf-32-le"), np.uint32)
    cls = np.zeros(len(cp), np.uint8)
    cls[cp == 9], cls[cp == 10], cls[cp == 0x22] = TAB, END, QUOTE
    after = states(cls)
    before = np.r_[np.uint8(START), after[:-1]]  # at a field's end: the state the field is in

    ends = np.flatnonzero((cls == TAB) | (cls == END))
    starts = np.r_[0, ends[:-1] + 1]
    line_of = np.r_[0, np.cumsum(cls[ends] == END)[:-1]]
    line_first = np.searchsorted(line_of, np.arange(n))
    number = np.arange(len(ends)) - line_first[line_of]
    count = np.bincount(line_of, minlength=n)
    final = before[ends]
    bad_quote = (final == QUOTED) | (final == WRONG)
    quoted = final == CLOSED

    sums = lambda flag: np.diff(np.r_[0, np.cumsum(flag)][np.stack([starts, ends])], axis=0)[0]
    fits = _allowed()[cp]
    odd = sums(~fits & (cp != 0x22)) + np.where(quoted, 0, sums(cp == 0x22))
    solid = sums((cp != 0x20) & (cp != 0x22)) + np.where(quoted, sums(cp == 0x22) > 2, 0)

    keep = (cls != TAB) & (cls != END)
    data = cp[keep]
    width = 1 + (data >= 0x80).astype(np.int64) + (data >= 0x800) + (data >= 0x10000)
    edges = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(ends - starts)]]
    raw = data.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    field = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(raw)])
    if quoted.any():
        inner = pc.replace_substring(pc.utf8_slice_codeunits(field, 1, -1), '""', '"')
        field = pc.if_else(pa.array(quoted), inner, field)

    wrong = np.zeros(len(ends), bool)
    wrong[number < 2] = (odd > 0)[number < 2] | (solid == 0)[number < 2]
    for k, ok in ((2, pc.is_in(field, pa.array(UD_TAGS, pa.large_string()))), (3, pc.match_substring_regex(field, MORPH))):
        at = number == k
        wrong[at] = ~ok.to_numpy(zero_copy_only=False)[at]

    def first(flag: np.ndarray) -> np.ndarray:
        """Index of each line's first flagged field, -1 if none."""
        out = np.full(n, -1)
        hit = np.flatnonzero(flag)[::-1]
        out[line_of[hit]] = hit
        return out

    columns = (count != FIELDS) & (count != FIELDS - 1) | lines.is_null().to_numpy(zero_copy_only=False)
    quoting, value = first(bad_quote), first(wrong)
    why = np.where(columns, 1, np.where(quoting >= 0, 2, np.where(value >= 0, 3, 0)))
    place = np.where(why == 2, quoting, np.where(why == 3, value, line_first))
    offset = starts[place] - starts[line_first]
    reason = pa.array([None, "columns", "quoting", "value"], pa.string()).take(pa.array(why))
    good = why == 0

    def column(k: int) -> pa.Array:
        at = line_first + k
        there = good & (count > k)
        return field.take(pa.array(np.where(there, at, 0), mask=~there)).cast(pa.string())

    return pa.StructArray.from_arrays([*[column(k) for k in range(FIELDS)], reason, pa.array(np.where(good, 0, offset), pa.int64(), mask=good)], fields=list(KIND))


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """The rows with wordform, lemma, tag, morph, reason and offset; map-only, and parsed once even where a filter on the result follows.

    ``reason`` is null for valid rows, else 'columns', 'quoting' or 'value', the first that
    applies, and the fields are null. A null or empty line fails by its columns.
    """
    names = ["wordform", "lemma", "tag", "morph", "reason", "offset"]
    if taken := set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}")

    @F.arrow_udf("struct<wordform:string,lemma:string,tag:string,morph:string,reason:string,offset:bigint>")
    def parsed(lines: pa.Array) -> pa.Array:
        parts = [parse(part) for part in slices(lines, SLICE_BYTES)]
        return pa.concat_arrays(parts) if parts else parse(lines)

    return df.withColumn("_p", parsed.asNondeterministic()(F.col(line))).select(*df.columns, *[F.col(f"_p.{c}").alias(c) for c in names])


def features(morph: Column) -> Column:
    """Map of a valid morph string; empty for null and empty."""
    return F.str_to_map(F.nullif(morph, F.lit("")), F.lit(r"\|"), F.lit("="))
