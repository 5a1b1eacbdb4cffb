"""Merkle manifest of a dataset: leaves, a tree a language, one root, and a proof for each row.

Rows are hashed where they lie; what is moved after that is a digest a row.
Leaves get their place among those of their language from a range-dealt table
(place in the part plus the rows of the language in earlier parts). Aligned
blocks of leaves are then walked in tasks, recursively and in postorder: a walk
returns the digest of its subtree and, while unwinding, appends to each leaf
below what stands beside the subtree. The roots of the blocks are the nodes of
the next distributed traversal, until each language has one node; these, in
order of the languages, go through the same traversal once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

ARITY = 2
#: Levels of the tree that a task walks at once: a block has at most ARITY ** LEVELS leaves.
LEVELS = 12


def field(value: Column) -> Column:
    """A value as it enters a leaf: "-" if null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(x) for x in (doc_id, source, lang, n_chars, text)]), 256)


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def walk(leaves: list[str], levels: int, arity: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """Root of a block after ``levels`` levels, and for each leaf what stands left and right of its path, level by level from below."""
    before, after = [[] for _ in leaves], [[] for _ in leaves]

    def visit(level: int, first: int) -> str:
        if not level:
            return leaves[first]
        step = arity ** (level - 1)
        heads = range(first, min(first + arity * step, len(leaves)), step)
        nodes = [visit(level - 1, k) for k in heads]
        for i, head in enumerate(heads):
            left, right = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for leaf in range(head, min(head + step, len(leaves))):
                before[leaf].append(left)
                after[leaf].append(right)
        return digest("".join(nodes))

    return visit(levels, 0), before, after


def levels_of(count: int, arity: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    levels = 0
    while count > 1:
        count, levels = -(-count // arity), levels + 1
    return levels


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``: the place of each row of a stored table among those of its ``tree``, from 0, by ``order`` (nulls first).

    Rows that are equal in ``order`` are told apart by where they are stored, so
    no key, however often repeated, has to fit one part.
    """
    rows = nodes.withColumn("row", F.monotonically_increasing_id())
    by = ["tree", *order, "row"]
    dealt = written(rows.repartitionByRange(*[F.asc_nulls_first(c) for c in by]).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part at most
    offsets = counts.select(F.col("tree").alias("of_tree"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*[F.asc_nulls_first(c) for c in by[1:]]))
    joined = dealt.withColumn("within", within).join(offsets, (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree")))
    return joined.select(*nodes.columns, (F.col("within") - 1 + F.col("offset")).alias("pos"))


def walked(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One distributed traversal of ``nodes`` (tree, pos, digest): each with root of its block and ``before``, ``after`` up to it.

    A block that holds a whole tree is walked up to the one node that remains,
    others by ``levels``.
    """
    size = arity**levels
    tree = nodes.schema["tree"].dataType.simpleString()

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves = table.column("digest").to_pylist()
        alone = key[1].as_py() == 0 and len(leaves) < size
        root, before, after = walk(leaves, levels_of(len(leaves), arity) if alone else levels, arity)
        lists = pa.list_(pa.string())
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "digest": table.column("digest"), "block_root": pa.array([root] * len(leaves), pa.string()), "before": pa.array(before, lists), "after": pa.array(after, lists)})

    keyed = nodes.select("tree", "pos", "digest", F.expr(f"pos div {size}").alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(block, f"tree {tree}, pos long, digest string, block_root string, before array<string>, after array<string>")


def traversals(nodes: DataFrame, arity: int, levels: int) -> Iterator[DataFrame]:
    """Stored traversals from the leaves to one node a tree; the roots of a traversal's blocks are the nodes of the next."""
    size, more = arity**levels, True
    while more:
        stored = written(walked(nodes, arity, levels))
        yield stored
        nodes = stored.where(F.col("pos") % size == 0).select("tree", F.expr(f"pos div {size}").alias("pos"), F.col("block_root").alias("digest"))
        more = nodes.where("pos > 0").limit(1).count() > 0


def proven(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, pos, digest, root, before, after) for ``nodes`` (tree, pos, digest): root of each one's tree and its path up to it."""
    size = arity**levels
    steps = list(traversals(nodes, arity, levels))
    above = None
    for step in reversed(steps):
        if above is not None:  # at most one block of rows meets a row here
            upper = above.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), F.col("root").alias("up_root"), F.col("before").alias("up_before"), F.col("after").alias("up_after"))
            met = step.join(upper, F.col("tree").eqNullSafe(F.col("up_tree")) & (F.expr(f"pos div {size}") == F.col("up_pos")))
            above = met.select("tree", "pos", "digest", F.col("up_root").alias("root"), F.concat("before", "up_before").alias("before"), F.concat("after", "up_after").alias("after"))
        else:
            above = step.withColumnRenamed("block_root", "root")
    return above


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(before.alias("l"), after.alias("r")), leaf, lambda node, side: F.sha2(F.concat(side["l"], node, side["r"]), 256))


def tampered_count() -> tuple[Column, Column]:
    """Whether a row is one that the trial tampers with, and its n_chars then."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return F.coalesce(chosen, F.lit(False)), F.when(chosen, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, pos, leaf, trial_leaf, subroot, root, before, after): a row for each row of ``docs``.

    ``before`` and ``after`` are the proof: the nodes left and right of the path,
    level by level from the leaf to the root, "" where there are none;
    ``trial_leaf`` is the leaf of the tampered row, or the leaf where none is.

    Null fields enter a leaf as "-"; null languages are a tree of their own, the
    first. Within a language null ids come first; rows of one id are ordered by
    their leaves, repeated rows are a leaf each. A text of any length is hashed
    where it lies. An empty table gives no rows; other columns are ignored.
    """
    c = {k: F.col(k) for k in ("doc_id", "source", "lang", "n_chars", "text")}
    chosen, count = tampered_count()
    leaf = leaf_digest(*c.values())
    trial = F.when(chosen, leaf_digest(**c | {"n_chars": count})).otherwise(leaf)
    leaves = written(docs.select(F.col("lang").cast("string").alias("tree"), "doc_id", leaf.alias("leaf"), trial.alias("trial_leaf")))
    at = written(placed(leaves, ["doc_id", "leaf"]))
    paths = proven(at.select("tree", "pos", F.col("leaf").alias("digest")), arity, levels)
    roots = written(paths.where("pos = 0").select(F.col("tree").alias("lang"), F.col("root").alias("digest")))
    top = placed(roots.select(F.lit(0).alias("tree"), "lang", "digest"), ["lang"])
    top = written(top)
    upper = proven(top.select("tree", "pos", "digest"), arity, levels).join(top.select("pos", "lang"), "pos")
    return _met(at, paths, upper)


#: Languages whose part of the proof is broadcast at most; more are joined by a shuffle.
BROADCAST_TREES = 10_000


def _met(at: DataFrame, paths: DataFrame, upper: DataFrame) -> DataFrame:
    upper = written(upper.select(F.col("lang").alias("up_lang"), F.col("digest").alias("subroot"), F.col("root").alias("whole_root"), F.col("before").alias("up_before"), F.col("after").alias("up_after")))
    few = F.broadcast(upper) if upper.count() <= BROADCAST_TREES else upper
    own = at.select(F.col("tree").alias("lang"), F.col("pos").alias("own_pos"), "doc_id", "leaf", "trial_leaf")
    met = own.join(paths, F.col("lang").eqNullSafe(F.col("tree")) & (F.col("own_pos") == F.col("pos"))).join(few, F.col("lang").eqNullSafe(F.col("up_lang")))
    return met.select("doc_id", "lang", "pos", "leaf", "trial_leaf", "subroot", F.col("whole_root").alias("root"), F.concat("before", "up_before").alias("before"), F.concat("after", "up_after").alias("after"))


def verified(rows: DataFrame) -> DataFrame:
    """Digest of each proof, the root that the trial leaf leads to, and whether it is the root."""
    beside = F.array_join(F.transform(F.arrays_zip(F.col("before").alias("l"), F.col("after").alias("r")), lambda s: F.concat(s["l"], s["r"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded(F.col("trial_leaf"), F.col("before"), F.col("after")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
