"""Encoding of whole texts by a public byte-level BPE vocabulary (problem 8).

Texts are cut into words by the vocabulary's pattern. The distinct words of a batch are
walked in byte order, which is the depth-first order of their prefix trie: each prefix
keeps the last token of its own encoding, so a shared prefix is encoded once, and a
word's ids are read backwards from its last token. A token t may follow a prefix iff the
pair (last token of the prefix, t) encodes to itself, so each step needs only pairs.

Everything is map-only: no shuffle, and a cache of bounded size that changes no result.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa

from gwerin.functions.batches import slices

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's word pattern.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 300_000
CACHE_PAIRS = 2_000_000
SLICE_BYTES = 4 << 20


class TrieEncoder:
    def __init__(self, ranks_path: str, pattern: str = WORD_PATTERN):
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain byte-pair merging, for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def traverse(self, words: list[str]) -> None:
        """Depth-first over the trie of the words: fills the cache."""
        ranks, follows, longest = self.ranks, self.follows, self.longest
        last: list[int] = []  # last[i]: last token of the encoding of the current path's first i + 1 bytes
        size: list[int] = []  # its length in bytes
        before = b""
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(data) + 1):
                for n in range(min(end, longest), 0, -1):
                    t = ranks.get(data[end - n : end])
                    if t is not None and (n == end or follows(last[end - n - 1], t)):
                        last.append(t)
                        size.append(n)
                        break
            ids, at = [], len(data)
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            self.cache[word] = tuple(reversed(ids))
            before = data

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids; null and empty have none."""
        found = [self.words(t) if t else [] for t in texts]
        index: dict[str, int] = {}
        which = np.fromiter((index.setdefault(w, len(index)) for f in found for w in f), np.int64)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.traverse([w for w in index if w not in self.cache])
        coded = [self.cache[w] for w in index]
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.int32, int(lens.sum()))
        starts = np.cumsum(lens) - lens
        n = lens[which]
        out_start = np.cumsum(n) - n
        ids = flat[np.repeat(starts[which] - out_start, n) + np.arange(int(n.sum()))] if len(which) else np.zeros(0, np.int32)
        word_ends = np.r_[0, np.cumsum(n)]
        text_ends = word_ends[np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)]
        return ids, np.diff(text_ends)


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str) -> TrieEncoder:
    return TrieEncoder(ranks_path)


def token_ids(col, ranks_path: str = DEFAULT_RANKS):
    """Column -> Column array<int>: ids without special tokens; null and empty texts have the empty list."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        done = [encoder(ranks_path).encode(part.to_pylist()) for part in slices(texts, SLICE_BYTES)]
        counts = np.concatenate([c for _, c in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([i for i, _ in done]) if done else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))

    return encode(col)


def token_count(col, ranks_path: str = DEFAULT_RANKS):
    """Column -> Column bigint: number of ids; null and empty texts have none."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        done = [encoder(ranks_path).encode(part.to_pylist())[1] for part in slices(texts, SLICE_BYTES)]
        return pa.array(np.concatenate(done) if done else np.zeros(0, np.int64), pa.int64())

    return count(col)
