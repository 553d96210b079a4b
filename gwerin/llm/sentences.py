"""Sentence units of documents in any language or script (problem 10).

Method: document-centred disambiguation. What the dot behind a word does, and whether a
capitalised word is a name, is read from the unambiguous occurrences of the word elsewhere:
first in the same document, then over the corpus, and last from short lists. A dot at a
line's end closes a sentence, one before a small letter does not (in a line that uses
capitals); a capital in mid-sentence marks a name, which does not begin a sentence behind
an abbreviation. Terminators follow the script of the line: full stops and their kin
without spaces in Chinese and Japanese, dandas in Devanagari, the question mark ; in Greek,
and spaces in Thai.

Words, evidence and the plain boundaries are found on the code-point arrays of a batch;
only lines with quotes, brackets, ordinals or other special marks are walked by themselves.

Offsets are code points of the text as it is, end exclusive, without outer white space.
Null, empty and blank texts have no sentence.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gwerin.functions.batches import slices
from gwerin.session import checkpoint

# Abbreviations without inner dots, in lower case, by what they do.
NEVER_LAST = frozenset("approx art ca cf dott dr dra dña eg ex ej fam feb gen gol gw hr ing lic messrs mgr mlle mme mr mrs ms parch prof rev sr sra srta st sta sto tel viz vs डॉ श्री κα κος αρ σελ".split())
BEFORE_NUMBER = frozenset("apr aug ch cap dec fig fri jan jul jun kap mar mon no nos nov nr nº núm oct okt p pág pp rh rhif sat sep sept sun t thu thur thurs tt tue tues vol wed".split())
MAY_END = frozenset("ayb co cyf etc inc jr ltd plc usw".split())
DOTTED_NEVER_LAST = frozenset("d.h e.e e.g h.y i.e p.e p.ej p.ex q.v u.a z.b π.χ δηλ".split())
GERMAN_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert"
BEFORE_ORDINAL = frozenset("ab am an bis das dem den der des die im seit vom zum zur".split())
JOINING = frozenset("a ac and aus e et neu ni o oder or ou u und y".split())
ADDRESS_ENDS = frozenset("com cymru de es example fr gov info io net org uk wales".split())
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "《": "》", '"': '"', "＂": "＂", "〝": "〞"}
BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】", "｛": "｝"}
CLOSERS = "”»)]}」』）】›》’\"＂"
STOPS = "!?…。！？｡؟۔।॥‼⁇⁈⁉．"

_TERM = regex.compile(r"[.!?…。！？｡؟۔।॥‼⁇⁈⁉．]+")
_GREEK_TERM = regex.compile("[.!?…;\u037e]+")
_WORD_BEFORE = regex.compile(r"(?:[\p{L}\p{M}\p{N}]+(?:[.'’·-][\p{L}\p{M}\p{N}]+)*)$")
_NEXT = regex.compile(r"[\s\p{So}\p{Sk}\p{Cf}️]*")
_BLOCK = regex.compile(r"\S+")
_OPENING = regex.compile("[" + regex.escape("".join([*PAIRS, *BRACKETS])) + "]")
_MARKED = regex.compile("[" + regex.escape("".join([*PAIRS, *BRACKETS]) + "”»」』›》＂〞)]）】｝") + "]")
_LETTER = regex.compile(r"\p{L}")
_UPPER = regex.compile(r"\p{Lu}")
_LOWER = regex.compile(r"\p{Ll}")
_SOLID = regex.compile(r"[\p{L}\p{N}]")
_CJK = regex.compile(r"[぀-ヿ㐀-鿿]")
_CASELESS = regex.compile(r"[\p{Devanagari}\p{Arabic}\p{Hebrew}\p{Thai}]")
_LIST_MARK = regex.compile(r"[\s>*•·–—-]*\(?(?:\d{1,4}|[ivxlc]{1,5}|[IVXLC]{1,5})$")

_TERM_CHARS = ".!?…。！？｡؟۔।॥‼⁇⁈⁉．"
_GREEK_CHARS = ".!?…;\u037e"
_BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"

# what the dot behind a word does: never ends, not before a digit, may end, ends; may end but a name follows
NEVER, NUMBER, MAY, WORD, NAMED = 1, 2, 3, 4, 5
# what a capitalised word is: a name, or one that also begins lines
NAME, STARTER = 1, 2
COUNTS = ["plain", "ends", "small", "upper", "digit", "inside", "begins", "lower"]
SLICE_BYTES = 1 << 19
(
    IS_LETTER, IS_WORD, IS_DIGIT, IS_UPPER, IS_LOWER, IS_SPACE, IS_BREAK, IS_SKIP, IS_PAIR, IS_TERM, IS_GREEK_TERM, IS_THAI, IS_GREEK, IS_DEVANAGARI, IS_OPENER, IS_SOLID,
) = (1 << i for i in range(16))


@functools.cache
def _flags() -> np.ndarray:
    """Classes of each code point."""
    out = np.zeros(0x110000, np.uint16)
    by = {"Lu": IS_UPPER, "Ll": IS_LOWER, "Nd": IS_DIGIT, "So": IS_SKIP, "Sk": IS_SKIP, "Cf": IS_SKIP}
    for cp in (*range(0x323B0), *range(0xE0000, 0xE01F0)):  # beyond are no assigned letters
        kind = unicodedata.category(chr(cp))
        if kind in ("Cn", "Co", "Cs"):
            continue
        flag = by.get(kind, 0)
        flag |= {"L": IS_LETTER | IS_WORD | IS_SOLID, "M": IS_WORD, "N": IS_WORD | IS_SOLID}.get(kind[0], 0)
        if chr(cp).isspace():
            flag |= IS_SPACE | IS_SKIP
        out[cp] |= flag
    for chars, flag in (
        (_BREAKS, IS_BREAK), ("\ufe0f", IS_SKIP), ("".join([*PAIRS, *BRACKETS]) + CLOSERS.replace("’", "") + "〞", IS_PAIR), (_TERM_CHARS, IS_TERM), (_GREEK_CHARS, IS_GREEK_TERM), ("".join([*PAIRS, "¿¡"]), IS_OPENER),
    ):
        for ch in chars:
            out[ord(ch)] |= flag
    out[0x0E01:0x0E4F] |= IS_THAI
    out[0x0370:0x0400] |= IS_GREEK
    out[0x0900:0x0980] |= IS_DEVANAGARI
    return out


@functools.cache
def _low() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in np.flatnonzero(_flags() & (IS_UPPER | IS_LETTER)):
        low = chr(cp).lower()
        if len(low) == 1:
            out[cp] = ord(low)
    return out


def _hash(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of folded code points."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters = low[np.repeat(start, size) + at].astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat(letters * (power[at % 4096] ^ np.uint64(0xD6E8FEB86659FD93)), np.cumsum(size) - size)
    return h ^ (h >> np.uint64(31)) ^ size.astype(np.uint64)


def _lookup(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words in lower case, with their codes."""
    keys = list(words)
    cp = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
    size = np.array([len(k) for k in keys], np.int64)
    h = _hash(_low()[cp], np.cumsum(size) - size, size)
    order = np.argsort(h)
    return h[order], np.array([words[k] for k in keys], np.int8)[order]


def _codes(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    keys, codes = table
    if not len(keys):
        return np.zeros(len(h), np.int8)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, codes[at], 0).astype(np.int8)


@functools.cache
def _listed() -> tuple[np.ndarray, np.ndarray]:
    words = dict.fromkeys(MAY_END, MAY) | dict.fromkeys(BEFORE_NUMBER, NUMBER) | dict.fromkeys(NEVER_LAST, NEVER) | dict.fromkeys(DOTTED_NEVER_LAST, NEVER)
    return _lookup(words)


class Words:
    """The words of a batch of texts on its code points, with what stands around them.

    A word is a stretch of letters, marks and digits; short ones joined by dots (e.g) are
    one. ``cp`` ends each text with a line feed.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.cp = cp = np.frombuffer(("\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offset = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        self.flags = f = _flags()[cp]
        n = len(cp)
        brk = (f & IS_BREAK) > 0
        self.line_start = np.flatnonzero(~brk & np.r_[True, brk[:-1]])
        self.line_end = np.flatnonzero(~brk & np.r_[brk[1:], True]) + 1
        self.line_of = np.cumsum(np.bincount(self.line_start, minlength=n)[:n]) - 1  # holds within lines
        lines = len(self.line_start)
        self.letters, self.mixed = self.line_flags(IS_LETTER), self.line_flags(IS_UPPER) > 0
        self.thai, self.greek = self.line_flags(IS_THAI) * 2 > self.letters, self.line_flags(IS_GREEK) * 2 > self.letters
        # next character that is no space; one that is no space or closing mark: both stop at a line's end
        position = np.arange(n)
        space = ((f & IS_SPACE) > 0) & ~brk
        closing = np.isin(cp, np.array([ord(c) for c in "\"”»’)]"], np.uint32))
        back = lambda skip: np.minimum.accumulate(np.where(skip, n - 1, position)[::-1])[::-1]
        self.past_space, past_close = back(space), back(space | closing)
        before = np.maximum.accumulate(np.where(space, 0, position))

        run = (f & IS_WORD) > 0
        a = np.flatnonzero(run & np.r_[True, ~run[:-1]])
        b = np.flatnonzero(run & np.r_[~run[1:], True]) + 1
        short = b - a <= 3
        link = np.zeros(len(a), bool)  # joined with the run before
        if len(a) > 1:
            fresh = ((f[a[1:]] & IS_UPPER) > 0) & ((f[b[:-1] - 1] & IS_UPPER) == 0) & (b[:-1] - a[:-1] > 1)  # is.He lacks a space
            link[1:] = (a[1:] == b[:-1] + 1) & (cp[b[:-1]] == 0x2E) & short[1:] & short[:-1] & ~fresh
        first = ~link
        self.start = start = a[first]
        self.end = end = b[np.r_[first[1:], True]] if len(a) else b
        self.inner = np.bincount(np.cumsum(first) - 1, minlength=len(start)) > 1 if len(a) else np.zeros(0, bool)
        self.size = size = end - start
        self.hash = _hash(_low()[cp], start, size)
        upto = lambda flag: np.r_[0, np.cumsum((f & flag) > 0)]
        digits, solid = upto(IS_DIGIT), upto(IS_LETTER)
        self.digits = digits[end] - digits[start]
        self.n_letters = solid[end] - solid[start]
        self.row = self.line_of[start]

        after, prev = cp[end], cp[np.maximum(start - 1, 0)]
        prev = np.where(start == 0, 0x0A, prev)
        self.dot = after == 0x2E
        glue = np.isin(after, np.array([ord(c) for c in "'’/@"], np.uint32))
        then = f[end + 1]
        tight = (then & IS_WORD > 0) | np.isin(cp[end + 1], np.array([ord(c) for c in ".'’/@"], np.uint32))
        clean = ~np.isin(prev, np.array([ord(c) for c in ".'’"], np.uint32)) & (self.digits == 0) & ~(np.isin(after, [0x2E]) & tight) & ~glue
        nxt = past_close[end + 1]
        follow = f[nxt]
        dotted = clean & self.dot
        last = dotted & (follow & IS_BREAK > 0)
        mixed = self.mixed[self.row] if lines else np.zeros(0, bool)
        capital, small = (f[start] & IS_UPPER) > 0, (f[start] & IS_LOWER) > 0
        left = before[np.maximum(start - 1, 0)]
        opens = (start == 0) | brk[np.maximum(start - 1, 0)] | brk[left] | (left < self.line_start[self.row] if lines else False)
        spaced = (start > 0) & space[np.maximum(start - 1, 0)] & ~opens
        inside = spaced & (((f[left] & IS_LOWER) > 0) | (cp[left] == 0x2C)) & mixed
        has_letter = self.n_letters > 0
        self.evidence = np.stack([
            clean & ~self.dot & has_letter, last, dotted & (follow & IS_LOWER > 0) & mixed & (nxt == self.past_space[end + 1]) & (nxt > end + 1), dotted & (follow & IS_UPPER > 0), dotted & (follow & IS_DIGIT > 0),
            clean & capital & inside, clean & capital & opens, clean & small & mixed,
        ]).astype(np.int64)

    def line_flags(self, flag: int) -> np.ndarray:
        """Characters of a class in each line."""
        return np.bincount(self.line_of[((self.flags & flag) > 0) & ((self.flags & IS_BREAK) == 0)], minlength=len(self.line_start))

    def by_text(self) -> np.ndarray:
        """Number of each (text, word) among those of the batch."""
        text = np.searchsorted(self.offset, self.start, "right")
        _, word = np.unique(self.hash, return_inverse=True)
        return np.unique(text.astype(np.int64) * (int(word.max(initial=0)) + 1) + word, return_inverse=True)[1]


def own_kinds(plain, ends, small, digit):
    """Kind that the other occurrences in the document settle; 0 if they don't."""
    never = (small > 0) & (ends == 0) & (plain <= small)
    may = (small > 0) & (ends > 0) & (plain <= small + ends)
    number = (digit > 1) & (ends == 0) & (small == 0) & (plain == 0)
    word = (ends > 1) & (small == 0) & (digit == 0)
    return np.select([never, may, number, word], [NEVER, MAY, NUMBER, WORD], 0)


class Segmenter:
    """Cuts texts into sentences; ``learned`` maps words in lower case to what the corpus says of their dots, ``names`` to what it says of them as names."""

    def __init__(self, learned: dict[str, int] | None = None, names: dict[str, int] | None = None, listed: bool = True):
        self.learned, self.names = _lookup(learned or {}), _lookup(names or {})
        self.listed = _listed() if listed else _lookup({})

    def kinds(self, w: Words) -> np.ndarray:
        """What the dot behind each word does: document, then corpus, then list."""
        if not len(w.start):
            return np.zeros(0, np.int8)
        group = w.by_text()
        total = np.stack([np.bincount(group, weights=e)[group] for e in w.evidence])
        others = total - w.evidence
        plain, ends, small, upper, digit, inside, begins, lower = others
        kind = own_kinds(plain, ends, small, digit)
        # a word known by two line ends only may still be an abbreviation before a small letter
        kind = np.where((kind == WORD) & (plain == 0) & (w.evidence[2] > 0), 0, kind)
        for table in (self.learned, self.listed):
            kind = np.where(kind == 0, _codes(table, w.hash), kind)
        kind = np.where((kind == 0) & w.inner, MAY, kind)
        kind = np.where((w.n_letters == 1) & (w.digits == 0) & ~w.inner & (w.size <= 2), NEVER, kind)  # an initial
        kind = np.where((kind == 0) & (w.evidence[2] > 0) & (plain == 0) & (w.digits == 0), NEVER, kind)  # never seen without a dot, and a small letter follows
        kind = np.where(kind == 0, WORD, kind)
        # the word behind an abbreviation that may end: a name if seen inside sentences only
        known = _codes(self.names, w.hash)
        capital = (w.flags[w.start] & IS_UPPER) > 0
        name = capital & (lower == 0) & (begins == 0) & ((inside > 0) & (known != STARTER) | (known == NAME))
        next_name = np.r_[name[1:], False] & np.r_[w.start[1:] == w.past_space[np.minimum(w.end[:-1] + 1, len(w.cp) - 1)], False]
        return np.where((kind == MAY) & next_name, NAMED, kind).astype(np.int8)

    def split(self, text: str | None) -> list[tuple[int, int]]:
        starts, stops, _ = self.split_all([text or ""])
        return list(zip(starts.tolist(), stops.tolist()))

    def split_all(self, texts: list[str], walk: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all sentences of the texts, and their number in each; ``walk`` takes every line by itself, with the same result."""
        w = Words(texts)
        a, b = self._cut(w, self.kinds(w), walk)
        text = np.searchsorted(w.offset, a, "right") - 1
        return a - w.offset[text], b - w.offset[text], np.bincount(text, minlength=len(texts))

    def _cut(self, w: Words, kind: np.ndarray, walk: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sentences of the batch as positions in ``w.cp``, in order: plain lines at once, the others one by one."""
        cp, f, lines = w.cp, w.flags, len(w.line_start)
        if not lines:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = (f & IS_BREAK) == 0
        hard = (w.line_flags(IS_PAIR) > 0) | w.thai
        greek_at = w.greek[w.line_of] & inside
        foreign = ((f & IS_TERM) > 0) & ((f & IS_GREEK_TERM) == 0) & greek_at
        hard |= np.bincount(w.line_of[foreign], minlength=lines) > 0
        term = inside & np.where(greek_at, (f & IS_GREEK_TERM) > 0, (f & IS_TERM) > 0)
        i = np.flatnonzero(term & np.r_[True, ~term[:-1]])
        e = np.flatnonzero(term & np.r_[~term[1:], True]) + 1
        row = w.line_of[i]
        dots = np.r_[0, np.cumsum(cp == 0x2E)]
        n_dots = dots[e] - dots[i]
        skip = ((f & IS_SKIP) > 0) & inside
        position = np.arange(len(cp))
        past = np.minimum.accumulate(np.where(skip, len(cp) - 1, position)[::-1])[::-1]
        nxt = past[e]
        gap = nxt > e
        follow = f[nxt]
        none, upper, lower, digit = ((follow & x) > 0 for x in (IS_BREAK, IS_UPPER, IS_LOWER, IS_DIGIT))
        mixed = w.mixed[row]
        end = np.ones(len(i), bool)  # whether the marks end a sentence

        trail = (n_dots == e - i) & (n_dots > 1) | (e - i == 1) & (cp[i] == ord("…"))
        open_end = upper | ((follow & IS_OPENER) > 0)
        end[trail & ~none & ~open_end & lower & mixed] = False
        tricky = trail & ~none & ~open_end & ~(lower & mixed)

        single = (n_dots == 1) & (e - i == 1)
        at = np.searchsorted(w.end, i)
        at_safe = np.minimum(at, max(0, len(w.end) - 1))
        bare = single & (w.end[at_safe] != i if len(w.end) else True)  # no word before the dot
        # a dot within a joined word
        of = np.searchsorted(w.start, i, "right") - 1
        within = single & (of >= 0) & (i < w.end[np.maximum(of, 0)]) if len(w.end) else np.zeros(len(i), bool)
        bare &= ~within
        end[bare & ~none & ~gap & ~upper] = False
        ahead = np.array([ord(c) for c in "'’·-"], np.uint32)
        one = within & ((f[i - 2] & IS_WORD) == 0) & ((f[i - 1] & IS_LETTER) > 0) & ~np.isin(cp[i - 2], ahead)
        one |= within & digit & ((f[i - 1] & IS_DIGIT) > 0)
        end[one] = False
        tricky |= within & ~one & ~none
        dot = single & ~bare & ~within & ~none
        if dot.any() and len(w.end):
            u = at_safe
            unit_start = w.start[u]
            prev = np.where(unit_start > 0, cp[np.maximum(unit_start - 1, 0)], 0x0A)
            joined = np.isin(prev, np.array([ord(c) for c in ".·-"], np.uint32)) & ((f[np.maximum(unit_start - 2, 0)] & IS_WORD) > 0)
            k = kind[u]
            one_letter = (w.n_letters[u] == 1) & (w.size[u] == 1) | w.inner[u] & ((f[i - 2] & IS_WORD) == 0)
            decided = np.zeros(len(i), bool)

            def settle(when: np.ndarray, value: bool) -> None:
                hit = dot & when & ~decided
                end[hit] = value
                decided[hit] = True

            close = ~gap
            settle(close & digit & ((f[i - 1] & IS_DIGIT) > 0), False)
            soft = lower | digit | np.isin(cp[nxt], np.array([ord(c) for c in "/@:_-&="], np.uint32))
            settle(close & soft & mixed, False)
            undecided = close & (soft | one_letter & np.isin(prev, ahead))
            settle(close & ~undecided & (np.isin(cp[nxt], np.array([ord(c) for c in ",;:)]}%"], np.uint32)) | one_letter), False)
            leads = np.r_[True, w.row[1:] != w.row[:-1]][u]  # the first word of its line
            all_digits = w.digits[u] == w.size[u]
            head = unit_start == w.past_space[w.line_start[row]]
            settle(leads & head & all_digits & (w.size[u] <= 4) & ~undecided, False)
            roman = leads & (w.size[u] <= 5) & (np.isin(_low()[cp[unit_start]], np.array([ord(c) for c in "ivxlc"], np.uint32)) | all_digits)
            undecided |= joined | roman | all_digits
            tricky |= dot & undecided & ~decided
            decided |= dot & undecided
            settle(k == NEVER, False)
            settle((k == NUMBER) & (digit | lower & mixed), False)
            settle(k == NUMBER, True)
            may = (k == MAY) | (k == NAMED)
            settle(may & (digit | lower & mixed | (k == NAMED) & upper), False)
            tricky |= dot & may & lower & ~decided
            settle(may, True)
            settle((f[i - 1] & IS_DEVANAGARI) > 0, False)
        hard[row[tricky]] = True
        hard |= walk

        # plain lines: parts between the ends
        ok = end & ~hard[row]
        plain = np.flatnonzero(~hard)
        starts = np.sort(np.r_[w.line_start[plain], e[ok]])
        stops = np.sort(np.r_[w.line_end[plain], e[ok]])
        # an end at the line's end leaves an empty part, which is blank like others
        count = lambda flag: np.r_[0, np.cumsum(((f & flag) > 0) & inside)]
        space, solid = count(IS_SPACE), count(IS_SOLID)
        full = space[stops] - space[starts] < stops - starts
        starts, stops = starts[full], stops[full]
        if len(starts):
            of_line = w.line_of[starts]
            leads = np.r_[True, of_line[1:] != of_line[:-1]]
            merged = ~leads & (solid[stops] == solid[starts])  # marks alone belong to the sentence before
            begin = np.flatnonzero(~merged)
            starts, stops = starts[begin], stops[np.r_[begin[1:], len(stops)] - 1]
            first, last = w.past_space[starts], stops
            white = ((f & IS_SPACE) > 0) | ~inside
            back = np.maximum.accumulate(np.where(white, 0, position))
            starts, stops = first, back[last - 1] + 1
        # the others
        slow = np.flatnonzero(hard)
        if len(slow):
            more_a, more_b = [], []
            dotted = np.flatnonzero(w.dot & hard[w.row]) if len(w.row) else np.zeros(0, int)
            bounds = np.searchsorted(w.row[dotted], slow), np.searchsorted(w.row[dotted], slow, "right")
            text_of = np.searchsorted(w.offset, w.line_start[slow], "right") - 1
            for n, x, y, t in zip(slow.tolist(), bounds[0].tolist(), bounds[1].tolist(), text_of.tolist()):
                a, b, base = int(w.line_start[n]), int(w.line_end[n]), int(w.offset[t])
                said = {int(p) - a: int(c) for p, c in zip(w.end[dotted[x:y]], kind[dotted[x:y]])}
                for s, z in line(w.texts[t][a - base : b - base], said, bool(w.thai[n]), bool(w.greek[n]), bool(w.mixed[n])):
                    more_a.append(a + s)
                    more_b.append(a + z)
            starts, stops = np.r_[starts, np.array(more_a, np.int64)], np.r_[stops, np.array(more_b, np.int64)]
            order = np.argsort(starts, kind="stable")
            starts, stops = starts[order], stops[order]
        return starts.astype(np.int64), stops.astype(np.int64)


# ---------------------------------------------------------------- lines with special marks


def _pairs(line: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(quotes, brackets) of a line as (open, close) positions; what is not closed in the line is none."""
    quotes, brackets, stack = [], [], []
    for m in _MARKED.finditer(line):
        i, ch = m.start(), m[0]
        if stack and ch in stack[-1][1] and (ch != '"' or stack[-1][2] == '"'):
            o = stack.pop()
            (brackets if o[2] in BRACKETS else quotes).append((o[0], i))
        elif ch in PAIRS:
            stack.append((i, PAIRS[ch], ch))
        elif ch in BRACKETS:
            stack.append((i, BRACKETS[ch], ch))
        else:  # a closer of something further out: what lies between isn't closed
            for k in range(len(stack) - 1, -1, -1):
                if ch in stack[k][1]:
                    o = stack[k]
                    del stack[k:]
                    (brackets if o[2] in BRACKETS else quotes).append((o[0], i))
                    break
    return quotes, brackets


def line(line: str, said: dict[int, int], thai: bool, greek: bool, mixed: bool) -> list[tuple[int, int]]:
    """Sentences of one line, walked by itself; ``said`` has the kind of each dot behind a word, ``mixed`` says that the line uses capitals."""
    if thai:
        return [m.span() for m in _BLOCK.finditer(line)]
    term = _GREEK_TERM if greek else _TERM
    quotes, brackets = _pairs(line) if _OPENING.search(line) else ([], [])
    cuts, start, at = [], 0, 0
    while m := term.search(line, at):
        i, e = m.span()
        at = e
        end = _boundary(line, i, e, start, said, mixed, quotes, brackets)
        if end is not None and line[start:end].strip():
            cuts.append((start, end))
            start = at = end
    if line[start:].strip():
        if cuts and not _SOLID.search(line, start):
            cuts[-1] = (cuts[-1][0], len(line))
        else:
            cuts.append((start, len(line)))
    done = []
    for a, b in cuts:
        part = line[a:b]
        a += len(part) - len(part.lstrip())
        b = a + len(part.strip())
        if done and not _SOLID.search(line, a, b):  # marks alone belong to the sentence before
            done[-1] = (done[-1][0], b)
        else:
            done.append((a, b))
    return done


def _boundary(line: str, i: int, e: int, start: int, said: dict[int, int], mixed: bool, quotes: list, brackets: list) -> int | None:
    """End of the sentence if the terminators line[i:e] end one, else null."""
    first = start + len(line[start:]) - len(line[start:].lstrip())
    around = [p for p in quotes + brackets if start <= p[0] < i < p[1]]
    # what the marks close: quotes and brackets right behind them
    end, closed = e, []
    while end < len(line):
        j = end
        while j < len(line) and line[j].isspace():
            j += 1
        hit = [p for p in around if p[1] == j]
        if hit and (j == end or line[j] in "»›"):
            closed += hit
            end = j + 1
        elif line[end] in CLOSERS and not any(p[0] == end for p in quotes + brackets) and line[end] not in "'’":
            end += 1
        elif line[end] in STOPS or line[end] == ".":
            end += 1
        else:
            break
    still = [p for p in around if p not in closed and not (p in brackets and p[0] == first)]
    if still:
        return None
    nxt = _NEXT.match(line, end).end()
    gap = nxt > end
    follow = line[nxt] if nxt < len(line) else ""
    if not follow:
        return len(line)
    upper, lower = bool(_UPPER.match(follow)), bool(_LOWER.match(follow))
    closed_quotes = [p for p in closed if p in quotes]
    if closed_quotes:
        o = min(closed_quotes)[0]
        opens = line[first:o].strip() == ""
        told = line[:o].rstrip()[-1:] in (":", "：")
        if _CJK.match(follow):
            return end if told and not opens else None
        if _CASELESS.match(follow):
            return None
        if lower:
            return end if told and not mixed and not opens else None
        return None if opens and not _UPPER.search(line[:o]) and not mixed else end
    inside = [p for p in closed if p in brackets]
    if inside and min(inside)[0] != first:
        return end if upper and mixed else None
    marks = line[i:e]
    if marks.strip(".") == "" and len(marks) == 1 and not inside:
        return _dot(line, i, end, start, follow, gap, upper, lower, said, mixed)
    if (marks.strip(".") == "" and len(marks) > 1) or marks == "…":
        if upper or follow in "¿¡" or follow in PAIRS:
            return end
        if lower and mixed:
            return None
        return end if len(line[start:i].split()) > 2 else None
    return end


def _dot(line: str, i: int, end: int, start: int, follow: str, gap: bool, upper: bool, lower: bool, said: dict[int, int], mixed: bool) -> int | None:
    before = _WORD_BEFORE.search(line, start, i)
    if before is None:
        return end if gap or upper else None
    word = before[0]
    if not gap:
        if follow.isdigit() and word[-1].isdigit():
            return None
        if lower or follow.isdigit() or follow in "/@:_-&=":
            m = regex.match(r"[\p{L}\p{M}\p{N}'’-]+", line[end:])
            right = (m[0] if m else "").lower()
            rest = line[end + len(right) :][:1]
            if right in ADDRESS_ENDS or (rest and rest in "/@.:") or len(word.split(".")[-1]) < 2 or len(right) < 2 or mixed:
                return None
            return end
        if follow in ",;:)]}%" or len(word.split(".")[-1]) == 1 and _LETTER.match(word[-1]):
            return None
    if start == 0 and _LIST_MARK.fullmatch(line[:i]) or _LIST_MARK.fullmatch(line[start:i]) and not line[:start].strip():
        return None
    if word.isdigit():
        m = regex.search(r"([\p{L}\p{M}]+)\.?\s+\d+$", line[start:i])
        month = regex.match(GERMAN_MONTHS, line[end:].lstrip(), regex.I)
        if month or (m and m[1].lower() in BEFORE_ORDINAL and upper and m[1].lower() != "an"):
            return None
        return end
    kind = said.get(i, WORD)
    if kind == NEVER:
        return None
    if kind == NUMBER:
        return None if follow.isdigit() or (lower and mixed) else end
    if kind in (MAY, NAMED):
        if follow.isdigit() or kind == NAMED and upper:
            return None
        if lower:
            nxt = regex.match(r"[\p{L}\p{M}]+", line[end:].lstrip())
            return None if mixed or (nxt and nxt[0] in JOINING) else end
        return end
    if "ऀ" <= word[-1] <= "ॿ":
        return None  # in Devanagari the danda ends sentences, the dot abbreviates
    return end


# ---------------------------------------------------------------- corpus evidence

LEAST_SEEN = 8  # occurrences from which the corpus settles a word
LEAST_SHARE = 1 / 200_000  # and the share of all dotted words (of all capitals inside sentences) from which it does: so at most 200,000 words of each kind can be known


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by what stands around them, summed up within the batch."""
    for batch in batches:
        for part in slices(batch.column(0), SLICE_BYTES):
            w = Words([t or "" for t in part.to_pylist()])
            some = np.flatnonzero(w.evidence.any(axis=0)) if len(w.start) else np.zeros(0, int)
            _, first, group = np.unique(w.hash[some], return_index=True, return_inverse=True)
            sums = [np.bincount(group, weights=e[some], minlength=len(first)).astype(np.int64) for e in w.evidence] if len(some) else [np.zeros(0, np.int64)] * len(COUNTS)
            text = np.searchsorted(w.offset, w.start, "right") - 1
            base = w.offset[text]
            words = [w.texts[text[k]][w.start[k] - base[k] : w.end[k] - base[k]].lower() for k in some[first]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array(c, pa.int64()) for c in sums]], names=["word", *COUNTS])


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, COUNTS) over all documents, pre-aggregated in the map."""
    n = df.select(text).mapInArrow(_counts, "word string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return n.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def learn(counts: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """What all documents together settle: {word: kind of its dot}, {word: NAME or STARTER}.

    never: its dot hardly ever stands at a line's end, and it is seldom written without one or a
    small letter mostly follows. number: the dots before digits are more than chance. may: dots
    before small letters and at line ends. word: dots at line ends, hardly any before small
    letters, and written without one. A name has its capital inside sentences and no small
    one; a starter also begins lines. Words below ``LEAST_SHARE`` are not settled, which
    bounds the result.
    """
    dotted = F.col("ends") + F.col("small") + F.col("upper") + F.col("digit")
    total = counts.agg(F.sum(dotted).alias("d"), F.sum("inside").alias("i")).first()
    seen = lambda c, whole: c >= max(float(LEAST_SEEN), LEAST_SHARE * (whole or 0))
    inner = F.col("small") + F.col("upper") + F.col("digit")
    never = (F.col("ends") <= 0.02 * dotted) & ((F.col("plain") <= 0.25 * dotted) | (F.col("small") >= 0.7 * inner) & (F.col("plain") <= dotted))
    final = F.col("ends") + F.col("upper")
    number = (F.col("digit") >= 3) & (F.col("digit") > 0.2 * final)
    may = (F.col("small") >= 0.2 * dotted) & (F.col("ends") > 0.02 * dotted)
    word = (F.col("ends") >= 0.05 * dotted) & (F.col("small") <= 0.05 * dotted) & (F.col("plain") >= 0.25 * dotted)
    kind = F.when(never & (F.col("digit") <= 0.5 * dotted), NEVER).when(number, NUMBER).when(may, MAY).when(word, WORD)
    capital = F.col("inside") + F.col("begins")
    name = F.when(F.col("lower") > 0.02 * capital, None).when(F.col("begins") > 0.02 * capital, STARTER).otherwise(NAME)
    dots = counts.where(seen(dotted, total["d"])).select("word", kind.alias("kind")).where("kind is not null").collect()
    names = counts.where(seen(F.col("inside"), total["i"])).select("word", name.alias("kind")).where("kind is not null").collect()
    return {r["word"]: r["kind"] for r in dots}, {r["word"]: r["kind"] for r in names}


@functools.lru_cache(maxsize=2)
def _segmenter(blob: bytes) -> Segmenter:
    return Segmenter(*pickle.loads(blob))


def sentence_spans(text: Column, learned: dict[str, int] | None = None, names: dict[str, int] | None = None) -> Column:
    """Column -> Column array<struct<sent_start, sent_end>>."""
    blob = pickle.dumps((learned or {}, names or {}))
    kind = pa.struct([("sent_start", pa.int64()), ("sent_end", pa.int64())])

    @F.arrow_udf("array<struct<sent_start:bigint,sent_end:bigint>>")
    def split(texts: pa.Array) -> pa.Array:
        done = [_segmenter(blob).split_all([t or "" for t in part.to_pylist()]) for part in slices(texts, SLICE_BYTES)]
        starts, stops, counts = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in range(3))
        ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], fields=list(kind)))

    return split(text)


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_no, sent_start, sent_end): one row per sentence; repeated and null keys are kept as they are.

    Two passes: corpus counts, pre-aggregated in the map, then the cut, map-only. What the
    corpus settles travels with the tasks; ``LEAST_SHARE`` bounds it however large the corpus.
    """
    learned, names = learn(checkpoint(word_counts(df, text)))
    spans = df.select(key, sentence_spans(F.col(text), learned, names).alias("s"))
    # outer, as a plain explode would make the optimizer evaluate the spans twice, once to filter
    return spans.select(key, F.posexplode_outer("s").alias("sent_no", "s")).where("s is not null").select(key, "sent_no", "s.sent_start", "s.sent_end")
