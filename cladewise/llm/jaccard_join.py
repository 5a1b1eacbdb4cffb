"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles (tokens); equal sets are one vertex.

* A census counts, for every token, the slices that hold it. A link of a set
  of n tokens shares at least t * n of them, so a set with fewer tokens that
  anything else holds links with nothing and goes no further.
* Similar documents form groups: same least shared token, blocks of bounded
  size, linked within the block. Each group's token union is stored: the
  token-group matrix.
* In one order of all tokens, rarest first, two linked sets meet within the
  first (shared - t * n + 1) tokens of both. Only these heads are posted, so
  frequent tokens and crowds that differ too much make no rows, and a query
  meets a group, however many members of it have the token.
* A query that met a group is compared with the stored union: fewer common
  tokens than a link with the group's smallest member needs close the group.
  Only groups that stay open are read, and their members compared.

Of two components the smaller one asks, first by one vertex of each component,
then, of what is still apart, by the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rounds as R
from ._shared import components, written
from ._text import SPACE, hashed_words, mix, span_hashes, windows

#: Most members and about the most tokens of a block of one group, and most queries that meet a group in one task.
BLOCK, BLOCK_TOKENS, QUERIES = 1024, 1 << 20, 4096

_ASKED = "slice int, bucket int, tokens binary, sets binary"
_ASKED_ARROW = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("sets", pa.binary())])
_TOLD = "slice int, bucket int, held binary, other binary, lower binary"
_TOLD_ARROW = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("held", pa.binary()), ("other", pa.binary()), ("lower", pa.binary())])
_SETS = "doc_id long, text_hash long, n_shingles long, vertex long, copied boolean, least long, head int, tokens binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("vertex", pa.int64()), ("copied", pa.bool_()), ("least", pa.int64()), ("head", pa.int32()), ("tokens", pa.binary())])
_GROUPS = "grp long, vertex long, comp long, n long, head int, tokens binary, smallest long, largest long, heads binary"
_GROUPS_ARROW = pa.schema([("grp", pa.int64()), ("vertex", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("head", pa.int32()), ("tokens", pa.binary()), ("smallest", pa.int64()), ("largest", pa.int64()), ("heads", pa.binary())])


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by group (exact: two halves below 2**53)."""
    low = np.bincount(group, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


class _Slice:
    """What one slice derives from its rows, alike each time it is looked at."""

    def __init__(self, table: pa.Table, n: int):
        hashes, counts = hashed_words(table["text"], SPACE, lower=True)
        start, row = windows(hashes, counts, n)
        short = np.flatnonzero((counts > 0) & (counts < n))
        ends = np.cumsum(counts)
        start, row, stop = np.concatenate([start, ends[short] - counts[short]]), np.concatenate([row, short]), np.concatenate([start + n, ends[short]])
        token = span_hashes(hashes, start, stop)
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        token, row = token[new], row[new]
        self.size = np.bincount(row, minlength=len(counts))
        null = np.asarray(table["doc_id"].combine_chunks().is_null()) if len(counts) else np.zeros(0, bool)
        self.active = np.flatnonzero((self.size > 0) & ~null)
        self.set1 = mix(_sums(mix(token), row, len(counts)) + self.size.astype(np.uint64))
        self.set2 = mix(_sums(mix(token ^ np.uint64(0x5851F42D4C957F2D)), row, len(counts)))
        # of equal sets in the slice only the first takes part
        first, self.number = R.distinct(self.set1[self.active], self.set2[self.active])
        self.node = self.active[first]
        lead = np.zeros(len(counts), bool)
        lead[self.node] = True
        keep = lead[row]
        self.token, self.row = token[keep], row[keep]
        self.key, self.of_key, self.times = np.unique(self.token, return_inverse=True, return_counts=True)
        self.of_key = self.of_key.ravel()

    def deals(self, n_buckets: int):
        """Order of the tokens and of the sets by bucket, and the bounds of each bucket's runs."""
        out = []
        for key in (self.key, self.set1[self.node]):
            bucket = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out.append((order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))))
        return out

    def asks(self, number: int, n_buckets: int):
        """For each bucket the upper halves of its tokens (the bucket stands for the lower ones) and whole set keys."""
        (by, edge), (by_set, edge_set) = self.deals(n_buckets)
        upper = (self.key >> np.uint64(32)).astype(np.uint32)
        for b in np.flatnonzero(np.diff(edge) + np.diff(edge_set)):
            own, sets = by[edge[b] : edge[b + 1]], self.node[by_set[edge_set[b] : edge_set[b + 1]]]
            yield {"slice": number, "bucket": int(b), "tokens": upper[own].tobytes(), "sets": self.set1[sets].tobytes() + self.set2[sets].tobytes()}

    def rows(self, table: pa.Table, told: list[dict], n_buckets: int, num: int, den: int) -> pa.Table:
        """One row for each document, with the shared tokens, rarest first, of sets that may have links."""
        (by, edge), (by_set, edge_set) = self.deals(n_buckets)
        held = np.ones(len(self.key), np.uint8)
        other, lower = np.zeros(len(self.node), bool), np.zeros(len(self.node), bool)
        for r in told:
            b = r["bucket"]
            held[by[edge[b] : edge[b + 1]]] = np.frombuffer(r["held"], np.uint8)
            own = by_set[edge_set[b] : edge_set[b + 1]]
            other[own], lower[own] = R.unpack(r["other"], len(own)), R.unpack(r["lower"], len(own))
        count = len(self.size)
        copied = np.zeros(count, bool)
        copied[self.active] = (other | (np.bincount(self.number, minlength=len(self.node)) > 1))[self.number]
        leads = np.zeros(count, bool)
        leads[self.node] = ~lower
        shared = ((held > 0) | (self.times > 1))[self.of_key] & leads[self.row]
        have = np.bincount(self.row[shared], minlength=count)
        need = -(-self.size * num // den)
        sent = leads & (have >= need) & (self.size > 0)
        on = shared & sent[self.row]
        token, row, rank = self.token[on], self.row[on], held[self.of_key[on]]
        edges = np.searchsorted(row, np.arange(count + 1))
        least = np.zeros(count, np.int64)
        least[sent] = token.view(np.int64)[edges[:-1][sent]]  # tokens lie in order within a row
        order = np.lexsort((token, rank, row))
        token = token[order]
        blobs = [token[a:b].tobytes() if s else None for a, b, s in zip(edges[:-1], edges[1:], sent, strict=True)]
        null = ~sent
        return pa.table(
            [
                table["doc_id"].cast(pa.int64()), pa.compute.struct_field(table["carry"], "text_hash"), pa.array(self.size, pa.int64()), pa.array(self.set1.view(np.int64)),
                pa.array(copied), pa.array(least, pa.int64(), mask=null), pa.array((have - need + 1).astype(np.int32), pa.int32(), mask=null), pa.array(blobs, pa.binary()),
            ],
            schema=_SETS_ARROW,
        )


def _census(table):
    """Answers one bucket: how many slices hold each token (logarithm, 0: this one alone), and who else holds each set."""
    table = table.sort_by([("slice", "ascending")])
    tokens, sets = ([np.frombuffer(x, kind) for x in table[c].to_pylist()] for c, kind in (("tokens", np.uint32), ("sets", np.uint64)))
    sizes, set_sizes = [len(t) for t in tokens], [len(s) // 2 for s in sets]
    _, number, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    held = np.round(8 * np.log2(count)).astype(np.uint8)[number.ravel()]
    one, two = np.concatenate([s[: len(s) // 2] for s in sets]), np.concatenate([s[len(s) // 2 :] for s in sets])
    first, of = R.distinct(one, two)  # stable, so the first is of the least slice
    other = np.bincount(of, minlength=len(first))[of] > 1
    lower = first[of] != np.arange(len(of))
    ends, set_ends, bucket = np.cumsum(sizes), np.cumsum(set_sizes), table["bucket"][0].as_py()
    rows = zip(table["slice"].to_pylist(), sizes, ends, set_sizes, set_ends, strict=True)
    return R.as_table([{"slice": s, "bucket": bucket, "held": held[e - n : e].tobytes(), "other": R.pack(other[f - m : f]), "lower": R.pack(lower[f - m : f])} for s, n, e, m, f in rows], _TOLD_ARROW)


def _matrix(sets: list[np.ndarray], others: list[np.ndarray] | None = None):
    """Sizes of all intersections between two lists of sets (or within one), by blocks of shared tokens."""
    every = sets + (others or [])
    flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    token, number, held = np.unique(flat, return_inverse=True, return_counts=True)
    keep = held > 1
    column = (np.cumsum(keep) - 1)[number]
    on = keep[number]
    owner, column = owner[on], column[on]
    n, width = len(sets), 4096
    out = np.zeros((n, len(others) if others is not None else n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(keep.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(every), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m[:n] @ (m[n:] if others is not None else m).T
    return out.astype(np.int64)


def _linked(sizes, others, inter, num: int, den: int) -> np.ndarray:
    return den * inter >= num * (sizes[:, None] + others[None, :] - inter)


def _tokens(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _link_block(num: int, den: int):
    """One group: its members with their component, and a row (no vertex) with its token union, its members' heads and sizes."""

    def run(table):
        table = table.sort_by([("vertex", "ascending")])
        sets, sizes, ids, head = _tokens(table["tokens"]), np.asarray(table["n"]), np.asarray(table["vertex"]), np.asarray(table["head"])
        label = np.arange(len(sets))
        if len(sets) > 1:
            link = _linked(sizes, sizes, _matrix(sets), num, den)
            while True:
                new = np.minimum(np.where(link, label[None, :], len(sets)).min(axis=1), label)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        union, heads = (np.unique(np.concatenate(x)) for x in (sets, [s[:h] for s, h in zip(sets, head, strict=True)]))
        n = len(sets)
        one = {"grp": [int(ids[0])], "vertex": [None], "comp": [None], "n": [n], "head": [None], "tokens": [union.tobytes()], "smallest": [int(sizes.min())], "largest": [int(sizes.max())], "heads": [heads.tobytes()]}
        members = pa.table([pa.array(np.full(n, ids[0])), table["vertex"], pa.array(ids[label]), table["n"], table["head"], table["tokens"], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_GROUPS_ARROW)
        return pa.concat_tables([members, pa.table(one, schema=_GROUPS_ARROW)])

    return run


def _in_full(batches):
    """Posts of a matrix row: one row for each token of ``heads``."""
    for batch in batches:
        heads = [np.frombuffer(x, np.int64) for x in batch.column("heads").to_pylist()]
        row = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        others = [batch.column(c).take(pa.array(row)) for c in batch.schema.names if c != "heads"]
        yield pa.RecordBatch.from_arrays([*others, pa.array(np.concatenate(heads) if heads else [], pa.int64())], names=[*(c for c in batch.schema.names if c != "heads"), "token"])


def _head_posts(batches):
    """Posts of asking vertices: one row for each token of the head, with its place."""
    for batch in batches:
        heads = [np.frombuffer(x, np.int64)[:h] for x, h in zip(batch.column("tokens").to_pylist(), batch.column("head").to_pylist(), strict=True)]
        row = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        place = [np.arange(len(x), dtype=np.int32) for x in heads]
        others = [batch.column(c).take(pa.array(row)) for c in ("grp", "vertex", "comp", "n", "shared", "weight")]
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        yield pa.RecordBatch.from_arrays([*others, flat(place, pa.int32()), flat(heads, pa.int64())], names=["own", "vertex", "comp", "n", "shared", "weight", "place", "token"])


def _bound(num: int, den: int):
    """Queries whose overlap with the stored union allows a link with the group's smallest member or a larger one."""

    def run(unions, queries):
        keep = np.zeros(len(queries), bool)
        if len(unions):
            union, smallest = np.frombuffer(unions["tokens"][0].as_py(), np.uint64), unions["smallest"][0].as_py()
            for i, (q, n) in enumerate(zip(_tokens(queries["asked"]), queries["size"].to_pylist(), strict=True)):
                common = int(np.isin(q, union, assume_unique=True).sum())
                keep[i] = common * (num + den) >= num * (n + max(smallest, -(-n * num // den)))
        return queries.filter(pa.array(keep)).select(["opened", "vertex"])

    return run


def _compare(num: int, den: int):
    """Links (a, b) between the components of an open group's members and of the queries that opened it."""

    def run(members, queries):
        pairs = [np.zeros((0, 2), np.int64)]
        if len(members) and len(queries):
            ours, theirs, size, sizes = _tokens(members["tokens"]), _tokens(queries["asked"]), np.asarray(members["n"]), np.asarray(queries["size"])
            comp, asking = np.asarray(members["comp"]), np.asarray(queries["asking"])
            for a in range(0, len(theirs), BLOCK):
                link = _linked(sizes[a : a + BLOCK], size, _matrix(theirs[a : a + BLOCK], ours), num, den)
                q, m = np.nonzero(link)
                pairs.append(np.unique(np.stack([asking[a + q], comp[m]], 1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _links(members: DataFrame, matrix: DataFrame, labels: DataFrame, first: bool, num: int, den: int) -> DataFrame:
    """Links (a, b) between components that asking vertices find in the groups they open.

    ``labels``: vertex, grp, comp and started (its component before this round).
    In the first round one vertex of each component asks, then the others. A
    vertex asks only for members of components that are larger than its own (by
    number of vertices, then by name), so of each pair one side asks.
    """
    weights = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    labels = labels.join(weights, "comp")
    top = labels.groupBy(F.col("grp").alias("opened")).agg(F.max(F.struct("weight", "comp")).alias("top"))
    asks = (F.col("vertex") == F.col("started")) if first else (F.col("vertex") != F.col("started"))
    tokens = members.select("vertex", F.col("n").alias("size"), F.col("tokens").alias("asked"))
    asking = labels.where(asks).select("vertex", "grp", "comp", "weight").join(members.select("vertex", "n", "head", "tokens"), "vertex").withColumn("shared", (F.octet_length("tokens") / 8).cast("long"))
    posts = asking.select("grp", "vertex", "comp", "n", "shared", "weight", "head", "tokens").mapInArrow(_head_posts, "own long, vertex long, comp long, n long, shared long, weight long, place int, token long")
    groups = matrix.select(F.col("grp").alias("opened"), "smallest", "largest", "heads").join(top, "opened").select("opened", "smallest", "largest", F.col("top.weight").alias("top_weight"), F.col("top.comp").alias("top_comp"), "heads")
    groups = groups.mapInArrow(_in_full, "opened long, smallest long, largest long, top_weight long, top_comp long, token long")
    # what a link with the smallest member, or the smallest partner there can be, must share: num / (num + den) of both sizes
    needed = f"{num} * (n + greatest(smallest, cast(ceil(n * {num}L / {den}L) as long)))"
    met = posts.join(groups, "token").where(
        f"own <> opened and (weight < top_weight or (weight = top_weight and comp < top_comp)) and largest * {den} >= n * {num} and smallest * {num} <= n * {den} and (shared - place) * {num + den} >= {needed}"
    )
    met = written(met.select("vertex", "opened").distinct())
    load = met.groupBy("opened").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    queries = met.join(load, "opened").withColumn("chunk", F.pmod(F.xxhash64("vertex"), F.col("chunks"))).join(tokens, "vertex").select("opened", "chunk", "vertex", "size", "asked")
    unions = matrix.withColumnRenamed("grp", "opened").join(load, "opened").select("opened", each, "smallest", "tokens")
    opens = unions.groupBy("opened", "chunk").cogroup(queries.groupBy("opened", "chunk")).applyInArrow(_bound(num, den), "opened long, vertex long")
    opens = written(opens)
    load = opens.groupBy("opened").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
    comps = labels.select("vertex", "comp")
    queries = opens.join(load, "opened").withColumn("chunk", F.pmod(F.xxhash64("vertex"), F.col("chunks"))).join(tokens, "vertex").join(comps.withColumnRenamed("comp", "asking"), "vertex").select("opened", "chunk", "asking", "size", "asked")
    inside = members.withColumnRenamed("grp", "opened").drop("comp").join(load, "opened").join(comps, "vertex").select("opened", each, "comp", "n", "tokens")
    return inside.groupBy("opened", "chunk").cogroup(queries.groupBy("opened", "chunk")).applyInArrow(_compare(num, den), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, slice_bytes: int = R.SLICE_BYTES) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least ``num/den`` of their distinct ``n``-word shingles.

    Takes doc_id and text (other columns are left out); returns doc_id,
    text_hash (xxhash64 of the text), n_shingles, component_id (the smallest
    doc_id reachable by links) and leads (the row is its class's smallest by
    doc_id and text_hash). Words are maximal runs without ASCII white space,
    A-Z lower-cased; a text with fewer than ``n`` words is one shingle. A null
    or empty text, or one of white space, has no shingle and stays alone. A row
    with a null doc_id links with nothing, has a null component_id and leads.
    Different texts of one doc_id are linked by their texts alone, not by the
    id. Rows equal in doc_id and text are one document, each gives a row and all
    of a leading document lead. An empty table gives no rows. The result is
    exact up to 64-bit hashes of shingles and sets.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    slices, _, total = R.sliced(hashed, slice_bytes, ["text_hash"])
    n_key = R.buckets_for(total / 7 / 2)

    def ask(key, table):
        number = key[0].as_py()
        return R.as_table(list(_Slice(R.in_order(table), n).asks(number, n_key)), _ASKED_ARROW)

    def sets(number, table, told):
        return _Slice(table, n).rows(table, told, n_key, num, den)

    told = slices.groupBy("slice").applyInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(_census, _TOLD)
    every = written(R.with_answers(slices, told, sets, _SETS))
    sent = every.where("tokens is not null").select("vertex", F.col("n_shingles").alias("n"), "least", "head", "tokens")
    blocks = sent.groupBy("least").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("tokens")) / (8 * BLOCK_TOKENS))).alias("blocks"))
    sent = sent.join(blocks, "least").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks"))).repartition("least", "block")
    grouped = written(sent.groupBy("least", "block").applyInArrow(_link_block(num, den), _GROUPS))
    members = grouped.where("vertex is not null").select("grp", "vertex", "comp", "n", "head", "tokens")
    matrix = grouped.where("vertex is null").select("grp", "smallest", "largest", "heads", "tokens")
    labels = members.select("vertex", "grp", "comp", F.col("comp").alias("started"))
    for first in (True, False):
        merged = components(_links(members, matrix, labels, first, num, den)).select(F.col("node").alias("comp"), "component")
        labels = written(labels.join(merged, "comp", "left").select("vertex", "grp", F.coalesce("component", "comp").alias("comp"), "started"))
    # one row for each set that has copies or may have links, then one for each class
    row = F.struct("doc_id", "text_hash")
    involved = every.where("copied or tokens is not null").groupBy("vertex").agg(F.min(row).alias("own")).join(labels.select("vertex", "comp"), "vertex", "left")
    involved = involved.withColumn("root", F.coalesce("comp", "vertex"))
    classes = involved.groupBy("root").agg(F.min("own").alias("least_row"))
    classes = involved.join(classes, "root").select("vertex", "least_row")
    out = every.select("doc_id", "text_hash", "n_shingles", F.when(F.expr("copied or tokens is not null"), F.col("vertex")).alias("vertex"))
    alone = out.where("vertex is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("leads"))
    linked = out.where("vertex is not null").join(classes, "vertex").select("doc_id", "text_hash", "n_shingles", F.col("least_row.doc_id").alias("component_id"), (F.col("least_row") == row).alias("leads"))
    return linked.unionByName(alone)
