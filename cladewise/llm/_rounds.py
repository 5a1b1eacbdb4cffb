"""Question-and-answer rounds: which of my keys does another slice hold too?

Documents are dealt into slices (a few MB of text each, by a hash of doc_id and text).
A slice packs its distinct keys into one binary per bucket, each bucket
compares what all slices sent, and a slice gets back bits in the order of the
keys it sent. So a key that a third of all rows hold costs one entry a slice,
no group is collected, and no text moves after the first exchange (Spark reuses
that exchange for every later look at the slices). A slice is sorted by doc_id
and its text, so a task that is run again after a lost executor sends the same
keys in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pack, unpack

#: Bytes of text in a slice, and keys in a bucket, about.
SLICE_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20

SENT = "slice int, bucket int, keys binary"
ANSWER = "slice int, bucket int, other binary, lower binary"


def sliced(docs: DataFrame, slice_bytes: int = SLICE_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """(slice, doc_id, text) of every row, the number of slices, and the bytes of all texts (counted, not guessed).

    ``carry``: columns to take along, as one struct, so that their names can't clash.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / slice_bytes))
    one = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("slice"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*carry).alias("carry")] if carry else []))
    return one, n, total


def buckets_for(keys: float) -> int:
    return max(1, math.ceil(keys / BUCKET_KEYS))


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each distinct key, in key order, and for each row the number of its key."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def dealt(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups keys by bucket, and the bounds of each bucket's run."""
    bucket = ((key >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def send(slice_id: int, n_buckets: int, *columns: np.ndarray) -> Iterator[dict]:
    """One row for each bucket that gets keys: the columns' bytes one after the other; the first column deals."""
    order, bounds = dealt(columns[0], n_buckets)
    for b in np.flatnonzero(np.diff(bounds)):
        part = order[bounds[b] : bounds[b + 1]]
        yield {"slice": slice_id, "bucket": int(b), "keys": b"".join(c[part].tobytes() for c in columns)}


def received(rows: list[dict], n_buckets: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key sent: another slice holds it; a slice with a smaller number (or value) does."""
    order, bounds = dealt(key, n_buckets)
    other, lower = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for r in rows:
        part = order[bounds[r["bucket"]] : bounds[r["bucket"] + 1]]
        other[part], lower[part] = unpack(r["other"], len(part)), unpack(r["lower"], len(part))
    return other, lower


def as_table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


SENT_ARROW = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary())])
ANSWER_ARROW = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("other", pa.binary()), ("lower", pa.binary())])


def compare(sent: DataFrame, kinds: list[str], by_value: bool) -> DataFrame:
    """Answers each bucket. ``kinds``: dtypes of the columns sent; the last one is a value if ``by_value``.

    ``other``: another slice sent the same key. ``lower``: so did one with a
    smaller value (with ``by_value``) or a smaller slice number.
    """
    widths = [np.dtype(k).itemsize for k in kinds]

    def answer(table):
        table = table.sort_by([("slice", "ascending")])
        slices, blobs = table["slice"].to_pylist(), table["keys"].to_pylist()
        counts = np.array([len(b) // sum(widths) for b in blobs], np.int64)
        columns = []
        for i, kind in enumerate(kinds):
            before = sum(widths[:i])
            columns.append(np.concatenate([np.frombuffer(b, kind, n, int(n) * before) for b, n in zip(blobs, counts, strict=True)]))
        keys, value = (columns[:-1], columns[-1]) if by_value else (columns, np.repeat(np.arange(len(blobs)), counts))
        first, number = distinct(*keys)
        other = np.bincount(number, minlength=len(first))[number] > 1
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, value)
        lower = value > least[number]
        ends = np.cumsum(counts)
        bucket = table["bucket"][0].as_py()
        return as_table([{"slice": s, "bucket": bucket, "other": pack(other[e - n : e]), "lower": pack(lower[e - n : e])} for s, n, e in zip(slices, counts, ends, strict=True)], ANSWER_ARROW)

    return sent.groupBy("bucket").applyInArrow(answer, ANSWER)


def ask(slices: DataFrame, keys: Callable[[int, pa.Table], Iterator[dict]]) -> DataFrame:
    """First round: ``keys`` yields what each slice sends."""

    def run(key, table):
        return as_table(list(keys(key[0].as_py(), in_order(table))), SENT_ARROW)

    return slices.groupBy("slice").applyInArrow(run, SENT)


def with_answers(slices: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, list[dict]], pa.Table], schema: str) -> DataFrame:
    """A later look at the slices, each beside the answers it got."""

    def both(key, table, answer):
        return run(key[0].as_py(), in_order(table), answer.to_pylist())

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(both, schema)
