"""One consistent character form for text that only looks alike (problem 1).

The kernel works on a whole Arrow batch: the text buffer becomes one numpy array of
code points, tables are gathered, expansions are placed by offsets and marks are
composed by array operations. No string method is called per row.

Consistent form: canonically composed; full-width, mathematical, ligature and
look-alike letters replaced by ordinary ones; the straight apostrophe; ordinary
spaces; nothing invisible. Words really written in another script stay as they are:
a token's look-alikes are replaced only if its other letters are Latin, or if all its
letters are look-alikes and its line holds no real word of that script. Letters that
are only nearly alike count as look-alikes among Latin letters and as real elsewhere.

Null stays null and the empty text stays empty.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gwerin.functions.batches import slices

# Letters of other alphabets, and rare Latin ones, that are drawn like basic Latin.
CYRILLIC_LIKE = {
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "Ѵ": "V", "Ү": "Y", "ү": "y", "Һ": "H", "һ": "h", "Ӏ": "I", "ӏ": "l", "Ԁ": "D", "ԁ": "d", "Ԍ": "G", "ԍ": "g", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
}
GREEK_LIKE = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j"}
ARMENIAN_LIKE = {"Տ": "S", "Ս": "U", "Լ": "L", "Օ": "O", "ց": "g", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "օ": "o"}
CHEROKEE_LIKE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B"}
LATIN_LIKE = {"ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ɴ": "n", "ʀ": "r", "ʋ": "v", "ʏ": "y", "ʙ": "b", "ʜ": "h", "ʟ": "l", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
# Letters near enough to be look-alikes among Latin letters, but ordinary letters of their script elsewhere.
NEAR_CYRILLIC = {"в": "b", "к": "k", "м": "m", "н": "h", "т": "t"}
NEAR_GREEK = {"α": "a", "γ": "y", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
NEAR_ARMENIAN = {"գ": "q", "զ": "q", "ռ": "n", "ք": "p", "ա": "w", "լ": "l"}
APOSTROPHES = "´ʹʻʼʽʾˈˊʹ՚׳ߴ‘’‚‛′‵ꞌ"
# Code points that draw nothing (ranges, ends included).
INVISIBLE = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
SPACES = [0x09, 0x0B, 0x0C, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x2800, 0x3000]

TOP = 0x110000
SLICE_BYTES = 1 << 20  # text of a batch that the arrays are made for at a time
LIMIT = 0x32000  # no character above has a decomposition or a case here
LATIN, CYR, GRK, ARM, CHK, CJK, OTHER = 1, 2, 3, 4, 5, 6, 7


def _script(name: str) -> int:
    for word, code in (("LATIN", LATIN), ("CYRILLIC", CYR), ("GREEK", GRK), ("ARMENIAN", ARM), ("CHEROKEE", CHK), ("CJK", CJK), ("HIRAGANA", CJK), ("KATAKANA", CJK), ("IDEOGRAPHIC", CJK), ("HANGUL", CJK), ("BOPOMOFO", CJK)):
        if name.startswith(word):
            return code
    return OTHER


def _folded(ch: str) -> str | None:
    """Ordinary form of a compatibility letter, else None."""
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return None
    cp, kind = ord(ch), d[1 : d.index(">")]
    roman_or_ligature = 0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F or cp == 0x17F or 0x132 <= cp <= 0x133 or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3
    if kind in ("wide", "narrow", "font", "initial", "medial", "final", "isolated") or kind == "compat" and roman_or_ligature:
        return unicodedata.normalize("NFKD", ch)
    return None


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """Tables by code point, made once in each worker from the character database."""
    first: dict[int, str] = {}  # expansion of one code point before scripts are looked at
    ccc = np.zeros(TOP, np.uint8)
    script = np.zeros(TOP, np.uint8)
    pair: dict[int, int] = {}
    cjk_punct = np.zeros(TOP, bool)
    for cp in range(0x80, LIMIT):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if c := unicodedata.combining(ch):
            ccc[cp] = c
        if cat[0] == "L":
            script[cp] = _script(unicodedata.name(ch, ""))
        f = _folded(ch)
        if f is not None and cat[0] not in "LN" and (0xFF00 <= cp <= 0xFFEF):
            cjk_punct[cp] = True
        full = unicodedata.normalize("NFD", f if f is not None else ch)
        if full != ch:
            first[cp] = full
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(p := d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            pair[int(p[0], 16) << 21 | int(p[1], 16)] = cp
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, LIMIT), (0xAC00, 0xD7A4)):
        script[a:b] = CJK
    for cp in range(0x1D7F):
        if unicodedata.category(chr(cp))[0] == "L" and not script[cp]:
            script[cp] = _script(unicodedata.name(chr(cp), ""))
    for cp in range(0x41, 0x7B):
        if chr(cp).isalpha():
            script[cp] = LATIN
    for a, b in INVISIBLE:
        for cp in range(a, b + 1):
            first[cp] = ""
    for cp in SPACES:
        first[cp] = " "
    for ch in APOSTROPHES:
        first[ord(ch)] = "'"
    first[0xFF07] = "'"
    like = np.zeros(TOP, np.uint32)
    origin = np.zeros(TOP, np.uint8)
    near = np.zeros(TOP, bool)
    for code, values in ((CYR, CYRILLIC_LIKE | NEAR_CYRILLIC), (GRK, GREEK_LIKE | NEAR_GREEK), (ARM, ARMENIAN_LIKE | NEAR_ARMENIAN), (CHK, CHEROKEE_LIKE), (LATIN, LATIN_LIKE)):
        for a, b in values.items():
            like[ord(a)] = ord(b)
            origin[ord(a)] = code
    for a in NEAR_CYRILLIC | NEAR_GREEK | NEAR_ARMENIAN:
        near[ord(a)] = True
    # exp: length and start of each expansion in one pool; 255 marks "itself"
    length = np.full(TOP, 255, np.uint8)
    start = np.zeros(TOP, np.uint32)
    pool: list[int] = []
    for cp, s in first.items():
        length[cp], start[cp] = len(s), len(pool)
        pool.extend(map(ord, s))
    keys = np.array(sorted(pair), np.uint64)
    second = np.zeros(TOP, bool)
    for k in pair:
        second[k & 0x1FFFFF] = True
    second[0x1161:0x1176] = second[0x11A8:0x11C3] = True
    return {
        "len": length, "start": start, "pool": np.array(pool or [0], np.uint32), "ccc": ccc, "script": script, "like": like, "origin": origin, "pair_keys": keys,
        "pair_to": np.array([pair[int(k)] for k in keys], np.uint32), "second": second, "cjk_punct": cjk_punct, "near": near,
    }


def _expand(cp: np.ndarray, row: np.ndarray, keep: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by its expansion; those in keep stay."""
    n = t["len"][cp]
    itself = (n == 255) | keep
    size = np.where(itself, 1, n).astype(np.int64)
    out = np.repeat(cp, size)
    if (~itself).any():
        begin = np.cumsum(size) - size
        local = np.arange(len(out)) - np.repeat(begin, size)
        moved = np.repeat(~itself, size)
        src = np.repeat(t["start"][cp].astype(np.int64), size)[moved] + local[moved]
        out[moved] = t["pool"][src]
    return out, np.repeat(row, size)


def _reorder(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Canonical order: marks between two starters stably sorted by class."""
    if len(cp) < 2 or not ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])).any():
        return np.arange(len(cp))
    group = np.cumsum((ccc == 0) | np.r_[True, row[1:] != row[:-1]])
    return np.lexsort((ccc, group))


def _pairs(a: np.ndarray, b: np.ndarray, t: dict) -> np.ndarray:
    """Composed code points of pairs, 0 where none."""
    key = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
    at = np.minimum(np.searchsorted(t["pair_keys"], key), len(t["pair_keys"]) - 1)
    out = np.where(t["pair_keys"][at] == key, t["pair_to"][at], 0).astype(np.uint32)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out[lv] = 0xAC00 + ((a[lv].astype(np.uint32) - 0x1100) * 21 + b[lv] - 0x1161) * 28
    lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - np.uint32(0xAC00)) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    out[lvt] = a[lvt] + b[lvt] - 0x11A7
    return out


def _compose(cp: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition of text in canonical order, by rank of the mark behind its starter."""
    while len(cp):
        ccc = t["ccc"][cp]
        new_row = np.r_[True, row[1:] != row[:-1]]
        # starters that compose with the starter right before them (Hangul, some Indic signs)
        two = np.flatnonzero(t["second"][cp] & (ccc == 0) & ~new_row)
        if len(two):
            to = _pairs(cp[two - 1], cp[two], t)
            ok = (to > 0) & ((t["ccc"][cp[two - 1]] == 0))
            hit = two[ok]
            to = to[ok]
            first = np.r_[True, hit[1:] != hit[:-1] + 1] if len(hit) else np.zeros(0, bool)
            hit, to = hit[first], to[first]
            if len(hit):
                cp[hit - 1] = to
                keep = np.ones(len(cp), bool)
                keep[hit] = False
                cp, row = cp[keep], row[keep]
                continue
        starts = (ccc == 0) | new_row
        group = np.cumsum(starts) - 1
        head = np.flatnonzero(starts)
        rank = np.arange(len(cp)) - head[group]
        gone = np.zeros(len(cp), bool)
        marks = np.flatnonzero(rank > 0)
        if len(marks):
            marks = marks[np.argsort(rank[marks], kind="stable")]
            ends = np.flatnonzero(np.r_[rank[marks][1:] != rank[marks][:-1], True]) + 1
            last = np.zeros(len(head), np.uint8)
            begin = 0
            for end in ends:
                m = marks[begin:end]
                begin = end
                g = group[m]
                h = head[g]
                free = (ccc[m] > last[g]) & (ccc[h] == 0)
                to = np.where(free, _pairs(cp[h], cp[m], t), 0)
                ok = to > 0
                cp[h[ok]] = to[ok]
                gone[m[ok]] = True
                last[g[~ok]] = ccc[m[~ok]]
        cp, row = cp[~gone], row[~gone]
        # a starter may have come next to one it composes with
        if not (gone.any() and (t["second"][cp] & (t["ccc"][cp] == 0)).any()):
            return cp, row
    return cp, row


def _fold_lookalikes(cp: np.ndarray, row: np.ndarray, t: dict) -> np.ndarray:
    like = t["like"][cp]
    maybe = like > 0
    if not maybe.any():
        return cp
    space = (cp == 0x20) | (cp == 0x0A) | (cp == 0x0D)
    new_row = np.r_[True, row[1:] != row[:-1]]
    token = np.cumsum(space | new_row)
    line = np.cumsum((cp == 0x0A) | new_row)
    n_tok, n_line = int(token[-1]) + 1, int(line[-1]) + 1
    script, origin = t["script"][cp], t["origin"][cp]
    plain_latin = np.bincount(token[(script == LATIN) & ~maybe], minlength=n_tok) > 0
    fold = np.zeros(len(cp), bool)
    for code in (CYR, GRK, ARM, CHK):
        mine = maybe & (origin == code)
        if not mine.any():
            continue
        real_here = (script == code) & (~maybe | t["near"][cp] & ~plain_latin[token])
        real_tok = np.bincount(token[real_here], minlength=n_tok) > 0
        real_line = np.bincount(line[real_here], minlength=n_line) > 0
        fold |= mine & ~real_tok[token] & (plain_latin[token] | ~real_line[line])
    mine = maybe & (origin == LATIN)
    fold |= mine
    return np.where(fold, like, cp)


def normalize_codepoints(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consistent form of code points whose row numbers are given, in order."""
    t = _tables()
    cjk_rows = np.unique(row[t["script"][cp] == CJK])
    keep = t["cjk_punct"][cp] & np.isin(row, cjk_rows) if len(cjk_rows) else np.zeros(len(cp), bool)
    cp, row = _expand(cp, row, keep, t)
    if not len(cp):
        return cp, row
    cp = cp[_reorder(cp, row, t["ccc"][cp])]
    cp = _fold_lookalikes(cp, row, t)
    return _compose(cp, row, t)


def normalize_array(texts: pa.Array) -> pa.Array:
    """Arrow strings in, their consistent forms out; nulls stay."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.nbytes > SLICE_BYTES and len(texts) > 1:
        return pa.concat_arrays([_normalize(part) for part in slices(texts, SLICE_BYTES)])
    return _normalize(texts)


def _normalize(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n or texts.null_count == n:
        return texts.cast(pa.string())
    flat = pc.fill_null(texts, "")
    buf = flat.buffers()
    off = np.frombuffer(buf[1], np.int64)[flat.offset : flat.offset + n + 1]
    data = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    odd = (data >= 0x7F) | (data < 0x20) & (data != 0x0A) & (data != 0x0D)
    if not odd.any():
        return texts.cast(pa.string())
    seen = np.r_[0, np.cumsum(odd)]
    todo = np.flatnonzero(seen[off[1:]] > seen[off[:-1]])
    sub = flat.take(pa.array(todo))
    sbuf = sub.buffers()
    soff = np.frombuffer(sbuf[1], np.int64)[sub.offset : sub.offset + len(sub) + 1]
    sdata = sbuf[2].to_pybytes()[soff[0] : soff[-1]]
    soff = soff - soff[0]
    cp = np.frombuffer(sdata.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.r_[0, np.cumsum((np.frombuffer(sdata, np.uint8) & 0xC0) != 0x80)]
    lens = np.diff(heads[soff])
    row = np.repeat(np.arange(len(sub)), lens)
    out, orow = normalize_codepoints(cp.copy(), row)
    counts = np.bincount(orow, minlength=len(sub)) if len(out) else np.zeros(len(sub), np.int64)
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    edges = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(counts)]]
    raw = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    done = pa.Array.from_buffers(pa.large_string(), len(sub), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(raw)])
    where = np.arange(n, dtype=np.int64)
    where[todo] = n + np.arange(len(sub))
    merged = pa.concat_arrays([flat, done]).take(pa.array(where))
    if texts.null_count:
        merged = pc.if_else(texts.is_valid(), merged, pa.scalar(None, pa.large_string()))
    return merged.cast(pa.string())


def _udf():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def consistent(texts: pa.Array) -> pa.Array:
        return normalize_array(texts)

    return consistent


def consistent_form(col):
    """Column -> Column: the consistent form of a text column (null stays null)."""
    return _udf()(col)


def text_key(col):
    """Letters, marks and digits of a text's consistent form in lower case: equal words compare as equal."""
    from pyspark.sql import functions as F

    return F.regexp_replace(F.lower(consistent_form(col)), r"[^\p{L}\p{M}\p{N}]", "")


def normalize_text(df, columns: list[str], suffix: str = "_norm"):
    """Add <column><suffix> in the consistent form for each text column.

    Map-only: no shuffle, no state, every row kept in place. A clash with an existing
    column is an error rather than a silent overwrite.
    """
    if taken := [c + suffix for c in columns if c + suffix in df.columns]:
        raise ValueError(f"columns exist already: {taken}")
    return df.withColumns({c + suffix: consistent_form(df[c]) for c in columns})


def changed_rows(df, id_col: str, text_col: str):
    """Rows whose text is not in the consistent form: (row_id, text, norm)."""
    from pyspark.sql import functions as F

    out = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return out.withColumn("norm", consistent_form(F.col("text"))).where("norm <> text")
