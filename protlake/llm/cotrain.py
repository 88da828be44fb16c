"""Document quality by co-training two views.

The text view sees the words (hashed) and the shape of the text in steps; the metadata view sees language, source and length. Words enter a
fit only if their share of good and bad training documents differs clearly, so the many rare words of the corpus add no noise. Both are logistic
regressions on sparse binary features. Each starts from labelled documents; in every round each view scores all unlabelled
documents, and those of which it is surest, by its calibrated score, join the other view's training set with the predicted
label. In the end both scores are calibrated on held-out labels, combined, and every document is scored.

What is fitted is bounded by parameters: about ``max_labelled`` labelled documents (by hash of the id) and ``per_round`` pseudo-labels per view, class and round. The
pool for pseudo-labels is the whole table but for that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protlake.llm import textkit as tk
from protlake.session import Scratch, staged

WORD_SLOTS, SHAPES, STEPS = 1 << 15, 12, 32
TEXT_SIZE = WORD_SLOTS + SHAPES * STEPS
META_SIZE = 1 << 12
MAX_LABELLED, ROUNDS, PER_ROUND, SURE = 12_000, 2, 300, 0.97
CLEAR, LEAST_DOCS = 3.5, 5  # a word's difference between the classes in standard errors, and training documents that hold it

_SYMBOL = np.zeros(256, bool)
_SYMBOL[:128] = [not (chr(c).isalnum() or chr(c) in " \t\n\r\v\f.,;:!?'\"()-") for c in range(128)]
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[offsets[1:] - 1] - total[offsets[:-1]]).astype(float)


def text_features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Active feature numbers of all texts, end to end, and how many each text has."""
    n = len(texts)
    words = tk.Words(texts, tk.NON_WORD, lower=True)
    plain = tk.Words(texts, tk.SPACE)
    raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    sizes = np.maximum(np.diff(plain.offsets) - 1, 1).astype(float)
    many = np.maximum(plain.count, 1).astype(float)
    same = np.zeros(len(plain.hash) + 1)
    same[1:len(plain.hash)] = (plain.hash[1:] == plain.hash[:-1]) & (plain.doc[1:] == plain.doc[:-1])
    order = np.lexsort((plain.hash, plain.doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (plain.hash[order][1:] != plain.hash[order][:-1]) | (plain.doc[order][1:] != plain.doc[order][:-1])
    distinct = np.bincount(plain.doc[order][fresh], minlength=n)
    stretch = np.bincount(plain.doc, weights=plain.ends - plain.starts, minlength=n)
    short = np.bincount(plain.doc, weights=(plain.ends - plain.starts) <= 1, minlength=n)
    lines = _per_text(raw == 10, plain.offsets)
    shares = [_per_text(_SYMBOL[raw], plain.offsets) / sizes, _per_text(_DIGIT[raw], plain.offsets) / sizes, _per_text(_UPPER[raw], plain.offsets) / sizes,
              _per_text(_STOP[raw], plain.offsets) / many, np.bincount(plain.doc, weights=same[:-1], minlength=n) / many, distinct / many, short / many,
              lines / many, np.minimum(1, stretch / many / 20), _per_text(raw >= 128, plain.offsets) / sizes]
    steps = [np.minimum(np.sqrt(np.clip(s, 0, 1)) * (STEPS - 1), STEPS - 1).astype(int) for s in shares]
    steps += [np.minimum(np.log2(many).astype(int), STEPS - 1), np.where(plain.count == 0, 1, 0)]
    shape = np.stack([WORD_SLOTS + j * STEPS + s for j, s in enumerate(steps)], axis=1)
    slots = words.doc * WORD_SLOTS + (words.hash % np.uint64(WORD_SLOTS)).astype(np.int64)
    slots = np.unique(slots)
    owner = np.concatenate((slots // WORD_SLOTS, np.repeat(np.arange(n), SHAPES)))
    number = np.concatenate((slots % WORD_SLOTS, shape.reshape(-1)))
    order = np.lexsort((number, owner))
    return number[order].astype(np.uint16), np.bincount(owner, minlength=n)


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Feature numbers (one row per document): language, source, length step, and language with length step."""
    def slot(kind: str, value: str) -> int:
        h = 1469598103934665603
        for c in f"{kind}={value}".encode("utf-8", "surrogatepass"):
            h = (h ^ c) * 1099511628211 % 2**64
        return int(tk.mix(np.array([h], np.uint64))[0] % np.uint64(META_SIZE))

    seen: dict[tuple[str, str], int] = {}

    def of(kind: str, value) -> int:
        key = (kind, "" if value is None else str(value))
        if key not in seen:
            seen[key] = slot(*key)
        return seen[key]

    steps = [-1 if s is None or s < 0 else int(2 * np.log2(1 + s)) for s in sizes]
    return np.array([[of("lang", a), of("source", b), of("size", c), of("lang-size", f"{a}/{c}")] for a, b, c in zip(langs, sources, steps, strict=True)],
                    np.int64).reshape(len(langs), 4)


def _sums(weights: np.ndarray, number: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[number])))
    end = np.cumsum(count)
    return total[end] - total[end - count]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class View:
    """A logistic regression on sparse binary features with a calibration a * z + c. Features numbered below ``tested`` have to be informative."""
    size: int
    tested: int = 0
    weights: np.ndarray = field(init=False)
    bias: float = 0.0
    a: float = 1.0
    c: float = 0.0

    def __post_init__(self):
        self.weights = np.zeros(self.size)

    def fit(self, number: np.ndarray, count: np.ndarray, y: np.ndarray, steps: int = 70, rate: float = 0.15, decay: float = 1e-5) -> None:
        """Adaptive gradient steps over the whole set, classes weighing the same."""
        if self.tested:
            use = np.append(informative(number, count, y, self.tested), np.ones(self.size - self.tested, bool))[number]
            count = np.bincount(np.repeat(np.arange(len(count)), count)[use], minlength=len(count))
            number = number[use]
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        self.weights, self.bias = np.zeros(self.size), 0.0
        seen, seen_bias = np.full(self.size, 1e-10), 1e-10
        for _ in range(steps):
            error = (_sigmoid(_sums(self.weights, number, count) + self.bias) - y) * weight
            gradient = np.bincount(number, weights=np.repeat(error, count), minlength=self.size) + decay * self.weights
            seen += gradient * gradient
            self.weights -= rate * gradient / np.sqrt(seen)
            seen_bias += error.sum() ** 2
            self.bias -= rate * error.sum() / np.sqrt(seen_bias)

    def raw(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _sums(self.weights, number, count) + self.bias

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        (self.a,), self.c = logistic(z[:, None], y)
        if self.a < 0:
            self.a, (_, self.c) = 0.0, logistic(np.zeros((len(y), 1)), y)

    def calibrated(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.a * self.raw(number, count) + self.c


def informative(number: np.ndarray, count: np.ndarray, y: np.ndarray, size: int, clear: float = CLEAR, least: int = LEAST_DOCS) -> np.ndarray:
    """Which of the features below ``size`` have clearly different shares of the two classes (two-proportion z test)."""
    of = np.repeat(y, count)
    held = number < size
    good = np.bincount(number[held], weights=of[held], minlength=size)
    every = np.bincount(number[held], minlength=size)
    n, n_good = len(y), y.sum()
    share = every / max(n, 1)
    error = np.sqrt(share * (1 - share) * (1 / max(n_good, 1) + 1 / max(n - n_good, 1)))
    apart = np.abs(good / max(n_good, 1) - (every - good) / max(n - n_good, 1))
    return (every >= least) & (apart > clear * error)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Few-feature logistic regression by Newton's method; weights and bias."""
    x1 = np.column_stack((np.clip(x, -40, 40), np.ones(len(x))))
    beta = np.zeros(x1.shape[1])
    for _ in range(25):
        p = _sigmoid(x1 @ beta)
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x1.T @ (p - y) + ridge * beta)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1], float(beta[-1])


@dataclass
class Model:
    """Both views and how their calibrated scores combine; ``prior`` alone if there was nothing to learn from."""
    text: View
    meta: View
    mix: tuple[float, float, float] = (1.0, 0.0, 0.0)
    prior: float | None = None

    def scores(self, number, count, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, metadata and combined probability of being good."""
        if self.prior is not None:
            flat = np.full(len(count), self.prior)
            return flat, flat, flat
        t = self.text.calibrated(number, count)
        m = self.meta.calibrated(meta.reshape(-1), np.full(len(count), meta.shape[1]))
        return _sigmoid(t), _sigmoid(m), _sigmoid(self.mix[0] * t + self.mix[1] * m + self.mix[2])


FEATURES_SCHEMA = "doc_id long, words binary, meta array<int>"


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))


def _features(texts, langs, sources, sizes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b in tk.grouped(texts):
        number, count = text_features(texts[a:b])
        yield a, b, number, count, meta_features(langs[a:b], sources[a:b], sizes[a:b])


def features(docs: DataFrame) -> DataFrame:
    """Both views of every document in compact form."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, number, count, meta in _features(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                at = np.concatenate(([0], np.cumsum(count)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([number[at[i]:at[i + 1]].tobytes() for i in range(b - a)], pa.binary()),
                     pa.array(list(meta.astype(np.int32)), pa.list_(pa.int32()))], names=["doc_id", "words", "meta"])

    return _columns(docs).mapInArrow(run, FEATURES_SCHEMA)


def _unpacked(words: list, meta: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = np.array([len(w) // 2 for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint16).astype(np.int64), count, np.array(meta, np.int64).reshape(len(meta), 4)


def _surest(pool: DataFrame, model: Model, n: int, sure: float, scratch: Scratch) -> list[list]:
    """For each kind (view, class) the n unlabelled documents the view is surest of, with their features.

    Parts give their own n best of each kind, so the n best of all are among them; only their ids and scores are sorted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, _ = model.scores(*_unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for kind, p in enumerate((text, 1 - text, meta, 1 - meta)):
                best = np.lexsort((batch.column(0).to_numpy(), -p))[:n]
                best = pa.array(best[p[best] >= sure], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(best), pa.int32()), pa.array(p).take(best), *[c.take(best) for c in batch.columns]],
                                                 names=["kind", "p", "doc_id", "words", "meta"])

    sure_ones = scratch.table(pool.mapInArrow(run, "kind int, p double, " + FEATURES_SCHEMA))
    out = []
    for kind in range(4):
        of_kind = sure_ones.filter(F.col("kind") == kind)
        ids = [r.doc_id for r in of_kind.select("doc_id", "p").distinct().orderBy(F.desc("p"), "doc_id").limit(n).collect()]
        out.append(of_kind.filter(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"]).orderBy("doc_id").select("words", "meta").collect() if ids else [])
    return out


def _sampled(labels: DataFrame, bound: int) -> DataFrame:
    """Labels of about ``bound`` documents, by hash, with ``good``: bounded, so fit for a broadcast."""
    good = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")))
    total = good.count()
    if total <= bound:
        return good
    return good.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < int(bound / total * (1 << 40)))


def train(table: DataFrame, labels: DataFrame, scratch: Scratch, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, per_round: int = PER_ROUND, sure: float = SURE) -> Model:
    """The model. ``table``: features of all documents.

    A document is good if its quality label is 1 and it isn't toxic. Of several labels of a document the worst counts; labels without a
    doc_id or quality are left out, a null ``toxic`` is 0. A fifth of the labelled documents, by hash, calibrates and is not fitted on.
    """
    sample = scratch.table(_sampled(labels, max_labelled))
    known = (table.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id")
             .select("words", "meta", "good", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0).alias("held")).collect())
    model = Model(View(TEXT_SIZE, WORD_SLOTS), View(META_SIZE))
    parts = [[r for r in known if bool(r.held) == held] for held in (False, True)]
    if any(len({r.good for r in part}) < 2 for part in parts):
        model.prior = 1.0 if not known else float(np.mean([r.good for r in known]))
        return model
    held = _unpacked([r.words for r in parts[1]], [r.meta for r in parts[1]])
    y = np.array([r.good for r in parts[1]], float)
    sets = [[(r.words, r.meta, r.good) for r in parts[0]] for _ in range(2)]
    pool = table.filter("doc_id is not null").join(F.broadcast(sample), "doc_id", "left_anti").select("doc_id", "words", "meta")
    for step in range(rounds + 1):
        for view, rows in zip((model.text, model.meta), sets, strict=True):
            number, count, meta = _unpacked([r[0] for r in rows], [r[1] for r in rows])
            target = np.array([r[2] for r in rows], float)
            data = (number, count) if view is model.text else (meta.reshape(-1), np.full(len(meta), 4))
            view.fit(*data, target)
            check = held[:2] if view is model.text else (held[2].reshape(-1), np.full(len(held[2]), 4))
            view.calibrate(view.raw(*check), y)
        if step < rounds:
            found = _surest(pool, model, per_round, sure, scratch)
            for kind, rows in enumerate(found):  # what one view is sure of teaches the other
                taught = sets[1 if kind < 2 else 0]
                taught += [(r.words, r.meta, 1 - kind % 2) for r in rows]
    t = model.text.calibrated(*held[:2])
    m = model.meta.calibrated(held[2].reshape(-1), np.full(len(held[2]), 4))
    (x, z), bias = logistic(np.column_stack((t, m)), y)
    model.mix = (float(x), float(z), bias)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``doc_id``, ``text_score``, ``meta_score``, ``score``, ``keep`` for every row of ``docs``.

    Scores are calibrated probabilities of being good; ``keep`` is score >= threshold. Reads ``doc_id``, ``text``, ``lang``, ``source``, ``n_chars`` and ``doc_id``, ``quality``, ``toxic`` of
    ``labels``. Null and empty texts and null metadata have features of their own and are scored like others; null and repeated doc_ids stay. Without labels of both
    classes every score is the share of good labels (1 without labels).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, both = model.scores(*_unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= threshold)],
                                             names=["doc_id", "text_score", "meta_score", "score", "keep"])

    with Scratch(docs.sparkSession, "cotrain") as scratch, tk.batches(docs.sparkSession):
        table = scratch.table(features(docs))
        model = train(table, labels, scratch, **how)
        return staged(table.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean"), "quality-scores")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` whose document is kept, all columns as they are; texts are scored where they lie."""
    with Scratch(docs.sparkSession, "cotrain") as scratch, tk.batches(docs.sparkSession):
        model = train(scratch.table(features(docs)), labels, scratch, **how)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = docs.schema
    inner = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for batch in batches:
            for a, b, number, count, meta in _features(*[batch.column(n + i).to_pylist() for i in range(4)]):
                _, _, both = model.scores(number, count, meta)
                part = batch.slice(a, b - a).filter(pa.array(both >= threshold))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)], names=names)

    from pyspark.sql import types as T
    out = inner.mapInArrow(run, T.StructType([T.StructField(x, f.dataType, True) for x, f in zip(names, schema.fields, strict=True)]))
    with tk.batches(docs.sparkSession):
        return staged(out, "quality-accepted").select(*[F.col(x).alias(c) for x, c in zip(names, docs.columns, strict=True)])
