"""Small tables and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import re
from collections import Counter

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for columns of their own
CLASHING = ["id", "t", "root", "bands", "words", "size", "block", "shard", "target", "key", "piece", "start", "spans", "head", "take", "c0", "order"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in CLASHING})


def sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, exact and near copies, and shared passages."""
    base, passage = sentence(1, 120), sentence(99, 70)
    near = base.split()
    near[60] = "changed"
    long_text = sentence(5, 20_000)
    texts = [base, base, " ".join(near), passage + " " + sentence(2, 40), sentence(3, 45) + " " + passage, "", "   \t ", None, "one", "one", "One!",
             long_text, long_text + " tail", "x" * 5000, "...", sentence(4, 49)]
    rows = [(i, t, "en" if i % 3 else None, ("b", "a", None)[i % 3], len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[8], (None, "no id", None, None, None), (None, None, None, None, None), (None, base, "en", "a", 5)]
    return rows


def bag(text: str | None, k: int = 5) -> Counter:
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def near_classes(docs: list[tuple], threshold: float = 0.8) -> dict[int, int]:
    """Smallest doc_id that every document reaches over pairs of weighted Jaccard similarity ``threshold`` or more."""
    bags = {d: bag(t) for d, t in docs if d is not None}
    ids = sorted(bags)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held: dict[tuple, list[int]] = {}
    for i in ids:
        for s in bags[i]:
            held.setdefault(s, []).append(i)
    pairs = {(a, b) for group in held.values() for a in group for b in group if a < b}
    for a, b in pairs:
        shared, total = (bags[a] & bags[b]).total(), bags[a].total() + bags[b].total()
        if shared >= threshold * (total - shared) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(docs: list[tuple], length: int = 50) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """Merged word ranges of windows that an earlier document holds, and the first holders."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in docs if d is not None and t is not None}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i:i + length]), d)
    out = {}
    for d, ws in words.items():
        hits = [(i, first[tuple(ws[i:i + length])]) for i in range(len(ws) - length + 1) if first[tuple(ws[i:i + length])] < d]
        spans: list[tuple[int, int]] = []
        for i, _ in hits:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + length)
            else:
                spans.append((i, i + length))
        if hits:
            out[d] = (spans, {f for _, f in hits})
    return out
