"""Greedy word-piece lengths by a linear automaton.

The trie over the vocabulary has failure links in the sense of longest-match tokenising: where no child fits, the link leads to the node
of what is left after the longest pieces that are certain have been cut off, and the number of pieces popped on the way
is stored with it. A word is read once, character by character; its number of pieces is the sum of the popped counts. No piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protlake.llm import textkit as tk
from protlake.session import staged

REMEMBERED = 300_000  # words whose count a task keeps
UNKNOWN = 1 << 40  # added to a word's count of 1 when no sequence of pieces spells it


class LengthAutomaton:
    """Piece counts of words. ``initial`` may begin a word, ``inner`` may continue it.

    An empty initial piece is the bare word-begin piece: it counts as a piece where no longer initial piece fits.
    """

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        initial = set(initial)
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 stands inside it
        depth_one: list[bool] = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.next[node].get(c)
                    if child is None:
                        child = self.next[node][c] = len(self.next)
                        self.next.append({})
                        depth_one.append(False)
                    node = child
                if node != root:
                    depth_one[node] = True
        self.link: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        if "" in initial:
            self.link[0], self.popped[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if depth_one[child]:  # the whole string of the node is a piece
                    self.link[child], self.popped[child] = 1, 1
                else:
                    at, count = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.next[at]:
                        count, at = count + self.popped[at], self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.next[at][c], count
                queue.append(child)

    def count(self, word: str) -> int:
        """Number of pieces of the greedy longest-match split; 1 + UNKNOWN if it fails."""
        node, total, forward, link, popped = 0, 0, self.next, self.link, self.popped
        for c in word:
            while (child := forward[node].get(c)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1 + UNKNOWN
            node = child
        while node != 1:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1 + UNKNOWN
        return total


class _Remembered(dict):
    def __init__(self, automaton: LengthAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(word) > 64:
            return self.automaton.count(word)
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def pieces_of_model(path: str) -> tuple[list[str], list[str]]:
    """Vocabulary of a sentencepiece model as word-initial and inner pieces; control, byte and unknown pieces are left out.

    The bare word-begin piece, if the vocabulary has it, is the empty word-initial piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, inner = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            (initial if piece.startswith("▁") else inner).append(piece.removeprefix("▁"))
    return initial, inner


def token_counts(docs: DataFrame, initial: list[str], inner: list[str]) -> DataFrame:
    """``doc_id``, ``words``, ``tokens``, ``unknown_words`` of every row of ``docs``.

    Words are separated by white space; a bare word-begin piece (an empty initial piece) counts as a token; a word that the pieces can't spell is one token and counts as unknown. A null or empty text has no
    words. Texts are read whole, words of any length in linear time. Null and repeated ids stay; other columns are not read. The vocabulary
    goes to the executors once; its size doesn't depend on the data.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((initial, inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(LengthAutomaton(*shipped.value))
        of = known.__getitem__
        for batch in batches:
            sizes, sums = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").split()
                sizes.append(len(found))
                sums.append(sum(map(of, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([s % UNKNOWN for s in sums], pa.int64()), pa.array([s // UNKNOWN for s in sums], pa.int64())],
                names=["doc_id", "words", "tokens", "unknown_words"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, words long, tokens long, unknown_words long")
    with tk.batches(docs.sparkSession):
        return staged(counted, "token-counts")
