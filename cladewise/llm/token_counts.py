"""Token counts by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MODEL_FILE, Vocabulary, pre_tokens, vocabulary

#: Nodes of a task's trie; a full trie is emptied, which costs time and no exactness.
NODES = 400_000
#: Characters of a pre-token that go into the trie; longer ones are counted beside it.
TRIE_DEPTH = 64


class CountTrie:
    """Distinct pre-tokens as paths; each node holds the forward score of its prefix and its token count.

    A node's score depends on its prefix alone, so it is computed once for all
    pre-tokens that share the prefix. A pre-token's terminal count is kept and
    looked up from then on. Of equal scores the longer last piece wins.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0], [0]
        self.terminal: dict[str, int] = {}

    def _forward(self, token: str, end: int, path: list[int], score, count) -> tuple[int, int]:
        """Best score and token count of ``token[:end]``, from the nodes of its shorter prefixes."""
        ending, start = self.v.endings.get, end - 1
        s = ending(token[start], 1)
        known = s is not None and s != 1
        top = score[path[start]] + (s if known else self.v.unknown)
        n = count[path[start]] + (1 if known else len(token[start].encode()))
        while start and s != 1:
            start -= 1
            s = ending(token[start:end], 1)
            if s is not None and s != 1 and score[path[start]] + s >= top:
                top, n = score[path[start]] + s, count[path[start]] + 1
        return top, n

    def insert(self, token: str) -> int:
        if len(token) > TRIE_DEPTH:
            score, count, path = [0], [0], range(len(token) + 1)
            for end in range(1, len(token) + 1):
                top, n = self._forward(token, end, path, score, count)
                score.append(top)
                count.append(n)
            return count[-1]
        if len(self.score) > NODES:
            self.clear()
        path = [0]
        for end, c in enumerate(token, 1):
            node = self.child.get((path[-1], c))
            if node is None:
                top, n = self._forward(token, end, path, self.score, self.count)
                node = self.child[path[-1], c] = len(self.score)
                self.score.append(top)
                self.count.append(n)
            path.append(node)
        self.terminal[token] = self.count[path[-1]]
        return self.count[path[-1]]

    def tokens(self, words: list[str]) -> int:
        known, total = self.terminal, 0
        for t in words:
            n = known.get(t)
            if n is None:
                n = self.insert(t)
                known = self.terminal
            total += n
        return total


def token_counts(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_tokens and n_pre_tokens of every row; a null or empty text has none.

    Takes doc_id and text; other columns are left out. The counts equal those
    of the best-scoring segmentation into the model's pieces, where a character
    that is no piece counts its bytes. Rows are independent and never shuffled;
    repeated rows get equal counts, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))

    def run(batches):
        trie = CountTrie(shared.value)
        for batch in batches:
            n, m = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                words = pre_tokens(text.as_py())
                n[i], m[i] = trie.tokens(words), len(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(m)], names=["doc_id", "n_tokens", "n_pre_tokens"])

    one = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return one.mapInArrow(run, "doc_id long, n_tokens long, n_pre_tokens long")
