"""Vectorised word splitting and hashing over UTF-8 bytes, for use inside tasks.

Words are runs of bytes outside a separator set. A word's hash is a polynomial over its bytes modulo 2**64, read off one prefix sum,
so a batch of texts costs a few array passes and no Python object per word. Texts are handled in pieces of bounded size, whatever
their length; only one hash and two offsets per word are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from protlake.session import arrow_batches

PIECE = 1 << 17  # bytes hashed at a time
GROUP = 1 << 20  # bytes of text handled together
BATCH = 1000  # rows in an Arrow batch of texts

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (0x9E3779B97F4A7C15 | 1)
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_WORD_STEP = (0xD6E8FEB86659FD93 | 1)

# separators: ASCII white space as in [\x20\x09-\x0D]; and everything in ASCII that is no letter or digit
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[:128] = [not chr(c).isalnum() for c in range(128)]


def batches(spark: SparkSession, rows: int = BATCH):
    """Arrow batches small enough to fit beside the executor's heap, for the tables written inside the block."""
    return arrow_batches(spark, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, cache: dict) -> np.ndarray:
    have = cache.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, PIECE + 1), base % 2**64, np.uint64)
        out[0] = 1
        have = cache[base] = np.multiply.accumulate(out)
    return have[:n]


_CACHE: dict[int, np.ndarray] = {}


def split_words(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte offsets and hashes of all words of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends, hashes = [], [], []
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not separators[raw[to - 1]]:  # a piece ends behind a separator, so no word is cut
            back = np.flatnonzero(separators[raw[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                to = min(n, to + PIECE)
        piece = raw[at:to]
        inside = ~separators[piece]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * _powers(_STEP, len(piece), _CACHE), out=prefix[1:])
            h = (prefix[e] - prefix[s]) * _powers(_STEP_INVERSE, len(piece), _CACHE)[s]
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix(h + (e - s).astype(np.uint64)))
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def grouped(texts: list, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` characters together, or one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of several texts, end to end: ``doc`` numbers the text of each word, ``first`` holds each text's first word."""

    def __init__(self, texts: list, separators: np.ndarray, lower: bool = False):
        parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass") for t in texts]
        self.offsets = np.cumsum([0, *[len(p) + 1 for p in parts]])
        self.starts, self.ends, self.hash = split_words(b"\n".join(parts), separators)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)


def sequence_prefix(h: np.ndarray, step: int = _WORD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which ``span_hash`` reads the hash of any run of words."""
    n = len(h)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(step, max(n, 1), _CACHE)[:n], out=prefix[1:])
    return prefix, _powers(pow(step, -1, 2**64), n + 1, _CACHE)


def span_hash(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [start, end); equal runs have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``k`` words; a text of fewer words, but at least one, is one run."""
    prefix, inverse = sequence_prefix(words.hash)
    width = np.minimum(words.count, k)
    runs = np.where(words.count > 0, words.count - width + 1, 0)
    doc = np.repeat(np.arange(len(runs)), runs)
    start = words.first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs))
    return doc, span_hash(prefix, inverse, start, start + width[doc])
