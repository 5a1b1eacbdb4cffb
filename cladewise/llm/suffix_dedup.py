"""Suffix-array dedup with a logarithmic family of indexes.

Every slice of documents is a batch. Its suffix array holds the starts of the
suffixes of at least ``width`` bytes, sorted by an 80-bit fingerprint of their
first ``width`` bytes (only whether two suffixes share that many bytes matters,
not which is smaller), and is split by fingerprint over shards. A shard takes
batches one by one: each is merge-scanned against the levels it has, equal
prefixes are matches on both sides, the batch becomes the lowest level, and
levels of like size merge, so an entry is merged a logarithmic number of times.

A first round keeps unrepeated text out of the suffix arrays: a suffix only
enters if the minimiser of its prefix (the least hash among its 100-byte grams)
occurs twice, which holds for every repeated prefix. Of equal texts only one
enters; the others are removed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _rounds as R
from ._shared import written
from ._text import _BYTE, flat, mix, pack, pieces, span_hashes, windows

_OUT = "doc_id long, text string, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])


def sliding(reduce, values: np.ndarray, width: int) -> np.ndarray:
    """``reduce`` (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = reduce(out[:-step], out[step:])
        have += step
    return out


class LevelFamily:
    """Sorted runs of (fingerprint, entry number) whose sizes grow geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, entry: np.ndarray, matched: np.ndarray) -> None:
        """Scans a sorted batch against each level, marks matches, and stores it."""
        for x, y, held in self.levels:
            at = np.searchsorted(x, a)
            probe = np.arange(len(a))
            while len(probe):  # more than one step only where the first 64 bits agree
                at_, probe = at[probe], probe
                inside = at_ < len(x)
                at_, probe = at_[inside], probe[inside]
                same = x[at_] == a[probe]
                at_, probe = at_[same], probe[same]
                full = y[at_] == b[probe]
                matched[entry[probe[full]]] = True
                matched[held[at_[full]]] = True
                probe = probe[~full]
                at[probe] += 1
        self.levels.append((a, b, entry))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            two = [np.concatenate(c) for c in zip(self.levels[-2], self.levels[-1], strict=True)]
            order = np.argsort(two[0], kind="stable")
            self.levels[-2:] = [tuple(c[order] for c in two)]


def _scan_shard(table):
    """Answers one shard: which entries' prefixes another batch holds too."""
    table = table.sort_by([("slice", "ascending")])
    blobs = table["keys"].to_pylist()
    counts = [len(x) // 10 for x in blobs]
    matched, at, family = np.zeros(sum(counts), bool), 0, LevelFamily()
    for blob, n in zip(blobs, counts, strict=True):
        a, b = np.frombuffer(blob, "u8", n), np.frombuffer(blob, "u2", n, 8 * n)
        family.add(a, b, np.arange(at, at + n), matched)
        at += n
    ends, bucket = np.cumsum(counts), table["bucket"][0].as_py()
    return R.as_table([{"slice": s, "bucket": bucket, "other": pack(matched[e - n : e]), "lower": b""} for s, n, e in zip(table["slice"].to_pylist(), counts, ends, strict=True)], R.ANSWER_ARROW)


class _Slice:
    def __init__(self, table: pa.Table, width: int):
        self.width, self.gram = width, width // 2
        self.data, self.offsets = flat(table["text"])
        self.sizes = np.diff(self.offsets)
        keys = [np.zeros(0, np.uint64)]
        self.runs = []  # of each piece: first suffix of each run that shares a minimiser, and its key
        for a, b in pieces(self.offsets):
            start, _, grams = self._grams(a, b)
            if not len(start):
                self.runs.append((a, b, start, np.zeros(0, np.uint64)))
                continue
            least = sliding(np.minimum, grams, self.width - self.gram + 1)
            covered = np.zeros(len(grams) + self.width - self.gram, np.uint64)
            covered[start + self.width - self.gram] = least[start]
            keys.append(grams[grams <= sliding(np.maximum, covered, self.width - self.gram + 1)])
            value = least[start]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1)
            self.runs.append((a, b, np.flatnonzero(new), value[new]))
        self.whole = np.flatnonzero(self.sizes >= width)
        both = [_BYTE[self.data], self.offsets[self.whole], self.offsets[self.whole + 1]] if len(self.whole) else None
        whole = mix(span_hashes(*both) ^ span_hashes(*both, second=True)) if both else np.zeros(0, np.uint64)
        grams = np.concatenate(keys)
        everything = np.concatenate([grams, whole])
        self.first, number = R.distinct(everything)
        self.keys = everything[self.first]
        self.many = np.bincount(number, minlength=len(self.first)) > 1
        self.whole_number = number[len(grams) :]

    def _grams(self, a: int, b: int):
        """Suffix starts within the piece, their rows, and the hash of the gram at every byte."""
        part = self.data[self.offsets[a] : self.offsets[b]]
        start, row = windows(part, self.sizes[a:b], self.width)
        if not len(start):
            return start, row, None
        at = np.arange(len(part) - self.gram + 1)
        return start, row + a, span_hashes(_BYTE[part], at, at + self.gram)

    def copies(self, other: np.ndarray, lower: np.ndarray):
        """Rows whose text stands in for equal ones, rows whose text another row has."""
        enters, copied = np.ones(len(self.sizes), bool), np.zeros(len(self.sizes), bool)
        leader = np.full(len(self.keys), -1)
        leader[self.whole_number[::-1]] = self.whole[::-1]
        copied[self.whole] = (other | self.many)[self.whole_number]
        enters[self.whole] = (leader[self.whole_number] == self.whole) & ~lower[self.whole_number]
        return enters, copied

    def suffixes(self, other: np.ndarray, lower: np.ndarray):
        """Byte positions of the suffixes that enter, the sorted fingerprints, and each one's fingerprint number."""
        hit, (enters, copied) = other | self.many, self.copies(other, lower)
        at, fine, coarse = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for a, b, run, value in self.runs:
            if not len(run):
                continue
            part = self.data[self.offsets[a] : self.offsets[b]]
            start, row = windows(part, self.sizes[a:b], self.width)
            on = np.repeat(hit[np.searchsorted(self.keys, value)], np.diff(np.append(run, len(start))))
            start = start[on & enters[row + a]]
            if len(start):
                codes = _BYTE[part]
                at.append(start + self.offsets[a])
                fine.append(span_hashes(codes, start, start + self.width))
                coarse.append((span_hashes(codes, start, start + self.width, second=True) >> np.uint64(48)).astype(np.uint16))
        fine, coarse = np.concatenate(fine), np.concatenate(coarse)
        first, number = R.distinct(fine, coarse)
        twice = np.bincount(number, minlength=len(first)) > 1
        return np.concatenate(at), fine[first], coarse[first], number, twice, copied


def dedup_suffixes(docs: DataFrame, width: int = 200, slice_bytes: int = R.SLICE_BYTES // 2) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that also starts anywhere else.

    Takes doc_id and text (other columns are left out). Returns doc_id, text,
    n_bytes, n_removed, spans (maximal removed runs, in bytes) and kept (the
    bytes left, which may cut a character). Strings lie within one document's
    UTF-8 bytes, may overlap, and are judged on the input. A null text has no
    bytes and stays null; rows with equal or null doc_id are separate
    documents; an empty table gives no rows.
    """
    slices, _, total = R.sliced(docs, slice_bytes)
    n_gram, n_shard = R.buckets_for(total / 40), R.buckets_for(total / 8)

    def grams(number, table):
        yield from R.send(number, n_gram, _Slice(table, width).keys)

    def batch(number, table, answers):
        s = _Slice(table, width)
        _, fine, coarse, *_ = s.suffixes(*R.received(answers, n_gram, s.keys))
        return R.as_table(list(R.send(number, n_shard, fine, coarse)), R.SENT_ARROW)

    def cut(number, table, answers):
        s = _Slice(table, width)
        kinds = [[r for r in answers if r["round"] == k] for k in (1, 2)]
        at, fine, _, key, twice, copied = s.suffixes(*R.received(kinds[0], n_gram, s.keys))
        other = R.received([r | {"lower": r["other"]} for r in kinds[1]], n_shard, fine)[0]
        at = at[(other | twice)[key]]
        cover = np.zeros(len(s.data) + 1, np.int32)
        cover[: len(cover)] += np.bincount(at, minlength=len(cover)).astype(np.int32)
        cover -= np.bincount(at + width, minlength=len(cover)).astype(np.int32)
        gone = np.cumsum(cover[:-1]) > 0
        spans, kept, removed = [], [], []
        for i, n in enumerate(s.sizes):
            o = s.offsets[i]
            if copied[i]:
                spans.append([{"start": 0, "end": int(n)}])
                kept.append(b"")
                removed.append(int(n))
                continue
            out = gone[o : o + n]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
            kept.append(s.data[o : o + n][~out].tobytes())
            removed.append(int(out.sum()))
        return pa.table([pa.array(table["doc_id"].to_pylist(), pa.int64()), table["text"].cast(pa.string()), pa.array(s.sizes), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], schema=_OUT_ARROW)

    first = R.compare(R.ask(slices, grams), ["u8"], False)
    second = R.with_answers(slices, first, batch, R.SENT).groupBy("bucket").applyInArrow(_scan_shard, R.ANSWER)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return R.with_answers(slices, both, cut, _OUT)


#: One row of a level or batch: a shard's suffixes in order, as first eight bytes and hash of ``width`` bytes, and whose they are.
_LEVEL = "shard int, heads binary, marks binary, owners binary"
_LEVEL_ARROW = pa.schema([("shard", pa.int32()), ("heads", pa.binary()), ("marks", pa.binary()), ("owners", pa.binary())])
_MATCHED = "slice int, starts binary"
_MATCHED_ARROW = pa.schema([("slice", pa.int32()), ("starts", pa.binary())])


def _columns(table: pa.Table) -> list[np.ndarray]:
    kinds = (("heads", ">u8"), ("marks", "u8"), ("owners", "u8"))
    return [np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()] or [np.zeros(0, k)]) for c, k in kinds]


def _level_row(shard: int, columns: list[np.ndarray]) -> pa.Table:
    order = np.lexsort((columns[1], columns[0]))
    return pa.table([pa.array([shard], pa.int32()), *[pa.array([c[order].astype(k).tobytes()], pa.binary()) for c, k in zip(columns, (">u8", "u8", "u8"), strict=True)]], schema=_LEVEL_ARROW)


class SuffixFamily:
    """A logarithmic family of suffix arrays that lies in the shared folder and takes new batches of documents.

    ``add`` orders the batch's suffixes (by their first eight bytes, then by a
    hash of their first ``width`` bytes), merge-scans them against every level
    there is, stores them as the lowest level, and merges levels of like size,
    so a suffix is merged a logarithmic number of times. Suffixes are dealt to
    ``shards`` by hash; a level has one row for each shard. Here every suffix is
    kept, as any of them may meet a later batch.
    """

    def __init__(self, spark: SparkSession, width: int = 200, shards: int = 16):
        self.spark, self.width, self.shards = spark, width, shards
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, docs: DataFrame, slice_bytes: int = R.SLICE_BYTES) -> DataFrame:
        """doc_id, text, n_bytes, spans of the batch's rows: spans of bytes covered by ``width``-byte strings that occur elsewhere in this batch or in an earlier one.

        Takes doc_id and text. A null text has no bytes; rows with equal or null
        doc_id are separate documents; an empty batch gives no rows.
        """
        width, shards = self.width, self.shards
        slices, _, _ = R.sliced(docs, slice_bytes)

        def suffixes(key, table):
            number, rows = key[0].as_py(), []
            data, offsets = flat(R.in_order(table)["text"])
            for a, b in pieces(offsets):
                part, sizes = data[offsets[a] : offsets[b]], np.diff(offsets)[a:b]
                start, _ = windows(part, sizes, width)
                if not len(start):
                    continue
                head = np.zeros(len(start), np.uint64)
                for k in range(min(8, width)):
                    head = (head << np.uint64(8)) | part[start + k]
                mark = span_hashes(_BYTE[part], start, start + width)
                owner = np.uint64(number) << np.uint64(32) | (start + offsets[a]).astype(np.uint64)
                shard = (mark % np.uint64(shards)).astype(np.int64)
                rows += [_level_row(s, [c[shard == s] for c in (head, mark, owner)]) for s in np.unique(shard)]
            return pa.concat_tables(rows) if rows else _LEVEL_ARROW.empty_table()

        def ordered(key, table):
            return _level_row(key[0].as_py(), _columns(table))

        batch = written(slices.groupBy("slice").applyInArrow(suffixes, _LEVEL).groupBy("shard").applyInArrow(ordered, _LEVEL))
        met = batch.groupBy("shard").applyInArrow(_scan_within, _MATCHED)
        for _, level in self.levels:
            other = level.select(F.col("shard").alias("shard"), F.col("heads").alias("heads"), F.col("marks").alias("marks"))
            met = met.unionByName(batch.groupBy("shard").cogroup(other.groupBy("shard")).applyInArrow(_scan_level, _MATCHED))
        met = written(met)
        self._keep(batch)

        def spans(number, table, matched):
            data, offsets = flat(table["text"])
            cover = np.zeros(len(data) + 1, np.int32)
            for starts in {x for m in matched for x in np.frombuffer(m["starts"], np.uint32).tolist()}:
                cover[starts] += 1
                cover[min(starts + width, len(data))] -= 1
            gone, out = np.cumsum(cover[:-1]) > 0, []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                out.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
            return pa.table([table["doc_id"].cast(pa.int64()), table["text"].cast(pa.string()), pa.array(np.diff(offsets)), pa.array(out, _SPANS)], names=["doc_id", "text", "n_bytes", "spans"])

        return R.with_answers(slices, met, spans, "doc_id long, text string, n_bytes long, spans array<struct<start: long, end: long>>")

    def _keep(self, batch: DataFrame) -> None:
        size = int(batch.agg(F.sum(F.octet_length("marks") / 8)).first()[0] or 0)
        if not size:
            return
        self.levels.append((size, batch))
        while len(self.levels) > 1 and self.levels[-2][0] <= 2 * self.levels[-1][0]:
            (n, x), (m, y) = self.levels[-2:]
            merged = x.unionByName(y).groupBy("shard").applyInArrow(lambda key, table: _level_row(key[0].as_py(), _columns(table)), _LEVEL)
            self.levels[-2:] = [(n + m, written(merged))]


def _matched(owners: np.ndarray) -> pa.Table:
    """Rows of (slice, starts) from owners' numbers."""
    owners = np.unique(owners)
    at = np.flatnonzero(np.diff(np.concatenate([[-1], (owners >> np.uint64(32)).astype(np.int64)])))
    return R.as_table([{"slice": int(p[0] >> np.uint64(32)), "starts": (p & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()} for p in np.split(owners, at[1:]) if len(p)], _MATCHED_ARROW)


def _scan_within(table):
    """Neighbours in suffix order that share a whole prefix."""
    heads, marks, owners = _columns(table)
    same = (heads[1:] == heads[:-1]) & (marks[1:] == marks[:-1])
    hit = np.zeros(len(heads), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return _matched(owners[hit])


def _scan_level(batch, level):
    """Merges a batch's order with a level's: its suffixes that stand beside an equal prefix of the level."""
    if not len(batch) or not len(level):
        return _MATCHED_ARROW.empty_table()
    heads, marks, owners = _columns(batch)
    old = [np.concatenate([np.frombuffer(x, k) for x in level[c].to_pylist()]) for c, k in (("heads", ">u8"), ("marks", "u8"))]
    order = np.lexsort((np.concatenate([old[1], marks]), np.concatenate([old[0], heads])))
    every, of = (np.concatenate([o, n])[order] for o, n in ((old[0], heads), (old[1], marks)))
    run = np.cumsum(np.concatenate([[True], (every[1:] != every[:-1]) | (of[1:] != of[:-1])])) - 1
    known = np.bincount(run, order < len(old[0])) > 0  # runs of equal prefixes that the level has
    mine = order >= len(old[0])
    return _matched(owners[order[mine & known[run]] - len(old[0])])
