"""Substring dedup by difference-cover anchors.

Positions of a document's words are taken modulo a period; only windows that
start at the cover's residues are hashed (3 of 7 for the default). Whatever two
long matches' offsets are, some shift brings both onto cover residues, so every
match of ``width`` words shares an aligned anchor. Anchors that occur once are
done with; around the others the full windows are compared (the extension), by
96-bit hashes, and a window goes if a document with a smaller id holds it too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rounds as R
from ._text import hashed_words, int64s, span_hashes, windows

#: Perfect difference covers: period and residues whose differences give every residue.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}

_OUT = "doc_id long, text string, n_words long, n_removed long, kept string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def period_for(width: int) -> int:
    """The largest period that leaves anchors of at least half the width: period - 1 + anchor <= width."""
    return max((p for p in COVERS if p - 1 + (width + 1) // 2 <= width), default=1)


class _Slice:
    """What one slice derives from its rows, alike each time it is looked at."""

    def __init__(self, table: pa.Table, width: int, period: int):
        self.width, self.anchor = width, width - period + 1
        self.ids = int64s(table["doc_id"])
        self.hashes, self.counts = hashed_words(table["text"])
        start, row = windows(self.hashes, self.counts, self.anchor)
        within = start - (np.cumsum(self.counts) - self.counts)[row]
        on = np.isin(within % period, COVERS[period])
        self.at, self.row = start[on], row[on]
        key = span_hashes(self.hashes, self.at, self.at + self.anchor)
        self.first, self.number = R.distinct(key)
        self.keys = key[self.first]

    def candidates(self, other: np.ndarray):
        """Windows that hold a repeated anchor, with 96-bit keys and the row of each."""
        ids = self.ids[self.row]
        low = np.full(len(self.first), np.iinfo(np.int64).max)
        high = np.full(len(self.first), np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, ids)
        np.maximum.at(high, self.number, ids)
        hit = (other | (low < high))[self.number]
        held = np.zeros(len(self.hashes) + 1, np.int64)
        np.cumsum(np.bincount(self.at[hit], minlength=len(self.hashes)), out=held[1:])
        start, row = windows(self.hashes, self.counts, self.width)
        on = held[start + self.width - self.anchor + 1] > held[start]
        start, row = start[on], row[on]
        a = span_hashes(self.hashes, start, start + self.width)
        b = (span_hashes(self.hashes, start, start + self.width, second=True) >> np.uint64(32)).astype(np.uint32)
        first, number = R.distinct(a, b)  # stable, so the first has the smallest doc_id
        return start, row, a[first], b[first], self.ids[row[first]], number


def dedup_substrings(docs: DataFrame, width: int = 13, slice_bytes: int = R.SLICE_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Removes each word covered by a ``width``-word window that also starts in a document with a smaller id.

    Takes columns doc_id and text (others are left out, but for those named in
    ``carry``, which come back as a struct of that name); returns doc_id, text,
    n_words, n_removed and kept (the words left, joined by one space).
    Windows are judged on the input. Words are maximal runs without ASCII white
    space, unchanged. A null text has no words and kept "" and its text stays
    null; a null doc_id counts as the largest id; rows of one doc_id are one
    document, so they don't remove each other, and each gives a row; an empty
    table gives no rows.
    """
    period = period_for(width)
    slices, _, total = R.sliced(docs, slice_bytes, carry)
    n_anchor, n_window = R.buckets_for(total / 14), R.buckets_for(total / 28)

    def anchors(number, table):
        yield from R.send(number, n_anchor, _Slice(table, width, period).keys)

    def extended(number, table, answers):
        s = _Slice(table, width, period)
        _, _, a, b, ids, _ = s.candidates(R.received(answers, n_anchor, s.keys)[0])
        return R.as_table(list(R.send(number, n_window, a, b, ids)), R.SENT_ARROW)

    def cut(number, table, answers):
        s = _Slice(table, width, period)
        kinds = [[r for r in answers if r["round"] == k] for k in (1, 2)]
        start, row, a, _, ids, key = s.candidates(R.received(kinds[0], n_anchor, s.keys)[0])
        lower = R.received(kinds[1], n_window, a)[1]
        gone = lower[key] | (s.ids[row] > ids[key])
        cover = np.zeros(len(s.hashes) + 1, np.int64)
        np.add.at(cover, start[gone], 1)
        np.add.at(cover, start[gone] + width, -1)
        stays = np.cumsum(cover[:-1]) == 0
        ends = np.cumsum(s.counts)
        sums = np.concatenate([[0], np.cumsum(~stays)])
        removed = sums[ends] - sums[ends - s.counts]
        kept = []
        for text, n, e, r in zip(table["text"], s.counts, ends, removed, strict=True):
            words = (text.as_py() or "").encode().split()
            kept.append(b" ".join(words if not r else [w for w, k in zip(words, stays[e - n : e], strict=True) if k]).decode())
        out = pa.table([table["doc_id"], table["text"].cast(pa.string()), pa.array(s.counts), pa.array(removed), pa.array(kept, pa.string())], schema=_OUT_ARROW)
        return out.append_column("carry", table["carry"]) if carry else out

    first = R.compare(R.ask(slices, anchors), ["u8"], False)
    second = R.compare(R.with_answers(slices, first, extended, R.SENT), ["u8", "u4", "i8"], True)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return R.with_answers(slices, both, cut, f"{_OUT}, carry {slices.schema['carry'].dataType.simpleString()}" if carry else _OUT)
