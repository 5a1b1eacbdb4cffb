"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words, word bigrams and
character n-grams (white space counts as a character); a softmax layer on top
gives the classes. Vectors and layer are trained by
stochastic gradient descent in NumPy on a bounded sample, in one task. As the score is linear
in the average, a task needs one number a bucket to score, and scoring is a
gather and a sum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import SPACE, _BYTE, flat, mix, pieces, span_hashes, word_hashes, word_spans
from .toxicity import training_sample

#: Most training rows, and bytes of their texts, that are learned from; buckets; length of a vector; characters of n-grams.
SAMPLE_ROWS, SAMPLE_BYTES, BUCKETS, DIM, GRAMS = 4_000, 8 << 20, 1 << 18, 8, (3, 5)

#: First learning rates of vectors (a bucket's share of a text scales its gradient down), layer and bias; they fall to 0.
RATES = (20.0, 0.4, 0.04)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x2545F4914F6CDD1D)
_SHIFT = np.uint64(64 - 18)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int32)


def features(part: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of words, word bigrams and character n-grams; a word twice in a row is one common bigram."""
    starts, ends, row = word_spans(part, offsets, SPACE)
    h = word_hashes(part, starts, ends)
    yield row, _bucket(h)
    inside = row[1:] == row[:-1]
    yield row[1:][inside], _bucket(np.where(h[1:] == h[:-1], _SAME, mix(h[1:] ^ (h[:-1] * _ODD)))[inside])
    at = np.flatnonzero((part & 0xC0) != 0x80)  # where characters start
    row = np.searchsorted(offsets, at, "right") - 1
    edge, codes = np.append(at, len(part)), _BYTE[part]
    for n in GRAMS:
        first = np.arange(max(len(at) - n + 1, 0))
        first = first[row[first] == row[first + n - 1]]
        yield row[first], _bucket(span_hashes(codes, edge[first], edge[first + n]))


def counts(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text, ascending, and the number of its features in each."""
    data, offsets = flat(column)
    for a, b in pieces(offsets):
        found = list(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        row, bucket = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        edge = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            yield (key[x:y] % BUCKETS).astype(np.int32), count[x:y].astype(np.int32)


def shares(count: np.ndarray) -> np.ndarray:
    return (count / max(count.sum(), 1)).astype(np.float32)


def bags(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and the share of its features in each."""
    return ((bucket, shares(count)) for bucket, count in counts(column))


def packed(bucket: np.ndarray, count: np.ndarray) -> bytes:
    """A text's buckets and counts in few bytes: gaps between the buckets, then the counts, byte by byte of all numbers, compressed."""
    numbers = np.concatenate([np.diff(bucket, prepend=np.int32(0)), count]).astype("<i4")
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


class Bags(Sequence):
    """Packed bags as (buckets, share of the text's features in each); each is unpacked when it is asked for, so only one is held."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs

    def __len__(self) -> int:
        return len(self.blobs)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        planes = np.frombuffer(zlib.decompress(self.blobs[i]), np.uint8).reshape(4, -1)
        gap, count = np.ascontiguousarray(planes.T).view("<i4").reshape(2, -1)
        return np.cumsum(gap, dtype=np.int32), shares(count)


class Embeddings:
    """Vectors of buckets and a softmax layer over two classes."""

    def __init__(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 3, rates: tuple[float, float, float] = RATES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.layer = np.zeros((DIM, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        steps, done = max(1, epochs * len(texts)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                bucket, share = texts[i]
                vectors, layer, bias = (r * (1 - done / steps) for r in rates)
                done += 1
                hidden = share @ self.vectors[bucket]
                z = hidden @ self.layer + self.bias
                e = np.exp(z - z.max())
                g = e / e.sum()
                g[label[i]] -= 1  # gradient of the cross-entropy by z
                back = self.layer @ g
                self.vectors[bucket] -= (vectors * share)[:, None] * back
                self.layer -= layer * np.outer(hidden, g)
                self.bias -= bias * g
        self.compile()

    @classmethod
    def scorer(cls, weight: np.ndarray, offset: float) -> Embeddings:
        self = cls.__new__(cls)
        self.weight, self.offset = weight, offset
        return self

    def compile(self) -> None:
        self.weight = (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)
        self.offset = float(self.bias[1] - self.bias[0])

    def score(self, column) -> np.ndarray:
        """Probability of class 1 of each text."""
        data, offsets = flat(column)
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for a, b in pieces(offsets):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            for row, bucket in features(part, bounds):
                total[a:b] += np.bincount(row, self.weight[bucket], b - a)
                count[a:b] += np.bincount(row, minlength=b - a)
        z = total / np.maximum(count, 1) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) for every row of ``docs``.

    ``labels`` (doc_id, quality) are the rows to learn from; the caller leaves
    out held-out ones. Scores depend on the text alone. A null or empty text
    gets the score of the bias; a null doc_id is kept; repeated rows score
    alike; without labelled rows every score is close to 0.5; an empty table gives
    no rows. Of a labelled doc_id that repeats one text is learned from.
    ``sample_rows`` and ``sample_bytes`` bound what is learned from.
    """
    shared = _fitted(docs, labels, sample_rows, sample_bytes)

    def score(batches):
        model = Embeddings.scorer(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                s = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    one = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return one.mapInArrow(score, "doc_id long, score double, predicted int")


def _fitted(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int):
    """Weights by bucket and offset of a model fitted to the sample.

    Tasks turn its texts into packed bags, one task learns from these (the
    sample is bounded), and only the model comes to the driver.
    """

    def run(batches):
        for batch in batches:
            bag = pa.array([packed(*x) for x in counts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bag, batch.column("label")], names=["doc_id", "bag", "label"])

    def fit(batches):
        rows = sorted(x for b in batches for x in zip(*[b.column(c).to_pylist() for c in ("doc_id", "bag", "label")], strict=True))
        model = Embeddings(Bags([x[1] for x in rows]), np.array([x[2] for x in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.offset])], names=["weight", "offset"])

    sample = training_sample(docs, labels, "quality", sample_rows, sample_bytes).mapInArrow(run, "doc_id long, bag binary, label double")
    found = sample.repartition(1).mapInArrow(fit, "weight binary, offset double").collect()
    if found:
        model = np.frombuffer(bytes(found[0].weight), np.float32), found[0].offset
    else:  # no partition: nothing to learn from
        none = Embeddings(Bags([]), np.empty(0, np.int64))
        model = none.weight, none.offset
    return docs.sparkSession.sparkContext.broadcast(model)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; no row moves. Cases as in score_quality."""
    shared = _fitted(docs, labels, sample_rows, sample_bytes)

    def keep(batches):
        model = Embeddings.scorer(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield part.filter(pa.array(model.score(part.column("text")) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
