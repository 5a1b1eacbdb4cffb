"""Vector code compression: product quantisation in whole numbers.

Vectors are cut into equal parts; each part position has a small codebook, and a
vector is stored as one entry number a part. Tasks hold vectors as columnar
NumPy blocks (a row a dimension), so distances accumulate dimension by dimension
over all vectors of a block; sums and counts are gathered by ``np.add.at`` into
one tensor, and tensors of tasks merge through the reduction tree of
``treeAggregate``. Everything is an integer, so the result doesn't depend on
how rows are dealt out or in which order tensors meet.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block.
BLOCK = 4096
#: A label with a larger share of the rows than one in so many has its sum broadcast; there are fewer such labels than this.
HEAVY = 1000


class Trained(NamedTuple):
    """books: integers by part, entry and position within the part; None without vectors. sha256: of them, comma-joined."""

    books: np.ndarray | None
    sha256: str
    wide: bool


def kept_vectors(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, x, label) of the rows that take part; x in double precision."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id"), x.alias("x"), F.col("label")).where(F.col("x").isNotNull()).where(finite)
    sizes = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where((F.col("n") > 0) & (F.col("n") % parts == 0))
    first = sizes.orderBy(F.col("rows").desc(), "n").first()
    return rows.where(F.size("x") == (first.n if first else -1))


def columnar(column: pa.Array, wide: bool, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch, a row a dimension. ``wide``: as Python's integers, for numbers that int64 can't square."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten())
    scaled = flat.reshape(len(column), -1).T
    if wide:
        return np.array([[(lambda p, q: scale * p // q)(*v.as_integer_ratio()) for v in row] for row in scaled.tolist()], object)
    return np.ascontiguousarray(np.floor(scaled * scale).astype(np.int64))


def nearest_entries(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of least squared distance for each column of ``part`` (ties: the lower one), and that distance."""
    far = np.zeros((len(book), part.shape[1]), part.dtype)
    for of_part, of_book in zip(part, book.T, strict=True):
        away = of_book[:, None] - of_part[None, :]
        far += away * away
    best = far.argmin(axis=0)
    return best, far[best, np.arange(part.shape[1])]


def tally(books: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sums and, last in each entry, counts of a block's parts by the entry they are nearest to."""
    parts, entries, width = books.shape
    out = np.zeros((parts, entries, width + 1), books.dtype)
    for p in range(parts):
        own = block[p * width : (p + 1) * width]
        best, _ = nearest_entries(own, books[p])
        for d in range(width):
            np.add.at(out[p, :, d], best, own[d])
        np.add.at(out[p, :, width], best, 1)
    return out


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its parts' mean; unused ones stay."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Trained:
    """Codebooks of the vectors in ``kept`` (vec_id, x).

    They start from the smallest ``entries`` ids; of rows with one id the
    componentwise smallest vector counts, null ids together as the largest id.
    """
    ends = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most")).first()
    if not ends.n:
        return Trained(None, hashlib.sha256(b"").hexdigest(), False)
    first = kept.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    width, most = len(first[0].x) // parts, ends.most * scale + 1
    wide = not (most < 2**30 and 4 * most * most * width * parts < 2**62 and most * ends.n < 2**62)
    start = columnar(pa.array([r.x for r in first], pa.list_(pa.float64())), wide, scale)
    books = np.stack([start[p * width : (p + 1) * width].T for p in range(parts)])

    def blocks(batches):
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                own = columnar(batch.column(0).slice(k, BLOCK), False, scale)
                yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int32).tobytes()], pa.binary())], ["block"])

    def wide_blocks(batches):
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                own = np.asarray(batch.column(0).slice(k, BLOCK).flatten())
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["block"])

    dims = parts * width
    table = written(kept.select("x").mapInArrow(wide_blocks if wide else blocks, "block binary"))

    def unpacked(row) -> np.ndarray:
        if wide:
            flat = np.frombuffer(row.block, np.float64)
            return columnar(pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dims, dtype=np.int32), pa.array(flat)), True, scale)
        return np.frombuffer(row.block, np.int32).reshape(dims, -1).astype(np.int64)

    stored = table.rdd.map(unpacked)
    nothing = np.zeros((parts, len(first), width + 1), books.dtype)
    for _ in range(rounds):
        sums = stored.treeAggregate(nothing, lambda acc, block, books=books: acc + tally(books, block), lambda a, b: a + b, depth=3)
        books = moved(books, sums)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    return Trained(books, digest, wide)


def encoded(kept: DataFrame, trained: Trained, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): entry numbers as two hex digits a part, and the summed squared distance (null beyond 64 bits)."""
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    books, wide = trained.books, trained.wide
    if books is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    parts, _, width = books.shape

    def codes(batches):
        for batch in batches:
            if not len(batch):
                continue
            block = columnar(batch.column(batch.schema.get_field_index("x")), wide, scale)
            best, far = zip(*(nearest_entries(block[p * width : (p + 1) * width], books[p]) for p in range(parts)), strict=True)
            digits = np.stack(best, axis=1).astype(np.uint8).tobytes().hex()
            error = [v if v < 2**63 else None for v in sum(far).tolist()]
            code = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "x").mapInArrow(codes, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over equal labels, nulls together; null if a sum passes 64 bits or an error is null.

    A label with many rows is summed before the shuffle and its sum broadcast,
    so its rows never meet in one task; the others are joined by label.
    """
    whole = F.count(F.lit(1)) == F.count("error")
    sums = written(coded.groupBy(F.col("label").alias("of_label")).agg(F.when(whole, F.try_sum("error")).alias("label_error"), F.count(F.lit(1)).alias("rows")))
    every = sums.agg(F.sum("rows")).first()[0] or 0
    much = F.col("rows") * HEAVY > every
    heavy, light = F.broadcast(sums.where(much)), sums.where(~much)
    same = F.col("label").eqNullSafe(F.col("of_label"))
    columns = [*coded.columns, "label_error"]
    return coded.join(heavy, same).select(*columns).unionByName(coded.join(heavy, same, "left_anti").join(light, same).select(*columns))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each vector that takes part.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do those of another dimension than the most frequent one that
    ``parts`` divides (ties: the smaller). Fewer ids than ``entries`` make
    smaller codebooks; repeated rows are coded each; null ids and labels are
    kept; an empty table gives no rows. Components of any finite size are coded
    exactly; an error or sum beyond 64 bits is null. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256, as a code has two hex digits a part")
    kept = kept_vectors(vectors, parts)
    trained = train(kept, parts, entries, rounds, scale)
    coded = written(encoded(kept, trained, scale))
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(trained.sha256))


def decoded(codes: DataFrame, trained: Trained, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that codes stand for, each component in the middle of its step of 1 / scale."""
    book = F.lit([[[(int(v) + 0.5) / scale for v in entry] for entry in part] for part in trained.books])
    number = F.transform(F.sequence(F.lit(0), F.lit(len(trained.books) - 1)), lambda p: F.get(F.get(book, p), F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.select("vec_id", F.flatten(number).alias("x"))
