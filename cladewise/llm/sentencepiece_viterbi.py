"""SentencePiece encoding and decoding with a streaming Viterbi search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MODEL_FILE, PRE_TOKEN, Vocabulary, vocabulary

#: Pre-tokens whose ids a task remembers, in each of two generations.
REMEMBERED = 120_000
#: Characters that are fed to the search at once.
CHUNK = 1 << 16


class StreamingViterbi:
    """Best segmentation of a stream of characters in a bounded window.

    Only boundaries within the longest piece of the last one can still start a
    piece. Whenever the best paths to all of them run through one boundary,
    what lies before it is final: its ids are committed and forgotten. Where a
    pre-token ends no piece goes on, so all paths meet there and everything is
    committed; within a longer one the search walks the frontier's paths back
    until they meet. The score is the sum of piece scores; of equal ones the
    longer last piece wins. What is searched between two such boundaries depends
    on nothing else, so the ids of frequent pre-tokens are remembered.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.tail = ""  # the open pre-token, while it is short
        self.inside = self.blank = False  # the open pre-token is in the window, and has only spaces so far
        self._clear()

    def _clear(self) -> None:
        self.text = ""  # characters since the last commit
        self.best: list[int] = [0]
        self.back = [0]

    def _extend(self, text: str, done: int) -> None:
        """Best scores and cuts of the boundaries after ``done``."""
        ending, unknown, best, back = self.v.endings.get, self.v.unknown, self.best, self.back
        for end in range(done + 1, len(text) + 1):
            start = cut = end - 1
            s = ending(text[start], 1)
            top = best[start] + (unknown if s is None or s == 1 else s)
            while start and s != 1:
                start -= 1
                s = ending(text[start:end], 1)
                if s is not None and s != 1 and best[start] + s >= top:
                    top, cut = best[start] + s, start
            best.append(top)
            back.append(cut)
        self.text = text

    def _search(self, characters: str) -> list[int]:
        """Moves the window over more of a pre-token; returns what is final."""
        out: list[int] = []
        window = 2 * self.v.longest
        for a in range(0, len(characters), window):
            self._extend(self.text + characters[a : a + window], len(self.text))
            if len(self.text) >= window:
                out += self._commit()
        return out

    def _commit(self) -> list[int]:
        """Moves the frontier's paths back until they meet."""
        end = len(self.text)
        front = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(front) > 1:
            last = max(front)
            front.remove(last)
            front.add(self.back[last])
        meet = front.pop()
        if not meet:
            return []
        ids = self._path(meet)
        low = self.best[meet]
        self.text, self.best = self.text[meet:], [b - low for b in self.best[meet:]]
        self.back = [0] + [max(b - meet, 0) for b in self.back[meet + 1 :]]
        return ids

    def _path(self, end: int) -> list[int]:
        ids: list[int] = []
        while end:
            start = self.back[end]
            piece = self.text[start:end]
            known = self.v.ids.get(piece)
            if known is not None:
                ids.append(known)
            else:
                ids += [self.v.byte_ids[x] for x in reversed(piece.encode())]
            end = start
        ids.reverse()
        return ids

    def _close(self) -> list[int]:
        """The open pre-token has ended: all paths meet at its end."""
        ids = self._path(len(self.text))
        self.inside = False
        self._clear()
        return ids

    def _ids(self, token: str) -> tuple[int, ...]:
        ids = self.older.get(token)
        if ids is None:
            ids = tuple(self._search(token) + self._close())
        if len(token) <= 64:
            self.seen[token] = ids
        return ids

    def feed(self, characters: str) -> list[int]:
        """Ids that are final after these characters."""
        if len(self.seen) >= REMEMBERED:
            self.seen, self.older = {}, self.seen
        parts, out = PRE_TOKEN.findall(self.tail + characters), []
        if not parts:
            return out
        if self.inside and (self.blank or parts[0][0] != " "):
            on = parts.pop(0)
            out += self._search(on)
            self.blank = self.blank and not on.strip(" ")
            if not parts:
                return out
        if self.inside:
            out += self._close()
        self.tail = parts.pop()
        seen = self.seen
        out += chain.from_iterable([seen.get(t) or self._ids(t) for t in parts])
        if len(self.tail) > 2 * self.v.longest:
            self.inside, self.blank, characters, self.tail = True, not self.tail.strip(" "), self.tail, ""
            out += self._search(characters)
        return out

    def finish(self) -> list[int]:
        """The ids that were still open; the next characters start another text."""
        ids = self._close() if self.inside else []
        if self.tail:
            tail, self.tail = self.tail, ""
            ids += self._ids(tail)
        return ids


def encode_stream(v: Vocabulary, chunks: Iterable[str]) -> Iterator[int]:
    """Ids of a text that comes in chunks, in memory bounded by the longest piece (and by how far paths stay apart)."""
    search = StreamingViterbi(v)
    yield from search.feed(" ")
    for chunk in chunks:
        yield from search.feed(chunk)
    yield from search.finish()


def encode_text(search: StreamingViterbi, text: str | None) -> np.ndarray:
    """Ids of a whole text, fed to the search in chunks; none for a null or empty one."""
    ids = search.feed(" " + text[:CHUNK]) if text else []
    for a in range(CHUNK, len(text or ""), CHUNK):
        ids += search.feed(text[a : a + CHUNK])
    return np.array(ids + search.finish(), np.int32)


def decode(v: Vocabulary, ids) -> str:
    """The text of ids: pieces and bytes joined, without the space the model put first."""
    return b"".join([v.texts[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("round_trip", pa.bool_())])


def encode(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids gives the text back, for each row of ``docs``.

    Takes doc_id and text; other columns are left out. A null text has null
    ids, n_ids 0 and a null round_trip; an empty one has no ids and comes back.
    Characters that are no piece become byte pieces. Rows are independent:
    repeated ones get equal ids, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))

    def run(batches):
        v = shared.value
        search = StreamingViterbi(v)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                ids = [encode_text(search, t) for t in texts]
                n = np.array([len(i) for i in ids], np.int32)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                back = [None if t is None else decode(v, i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(n), pa.array(back, pa.bool_())], schema=_OUT)

    one = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return one.mapInArrow(run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def decode_ids(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text, no ids an empty one."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_file))

    def run(batches):
        for batch in batches:
            texts = [None if i is None else decode(shared.value, i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
