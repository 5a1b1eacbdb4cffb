"""Ancestral-state tables as a data source of their own, tip states from alignments, and the audit of both.

``spark.read.format("ancestral_states")`` reads the tab-separated posteriors of
a phylogenetics program: a header Node, Site, State and a column p_<state> for
each state, comments with #. A file is cut by bytes, each task reads the lines
that begin in its part, and the wanted nodes are an option of the reader, so
lines of others are told by their first field and never parsed. (Filters are not
pushed: Spark 4.1.2 keeps them from one scan to the next, and a union of two
filtered scans then gives the rows of one of them twice.) Paths are opened by
pyarrow's file systems; tables.read_states reads the same files by Spark's own
readers, which know more of them.
"""

from __future__ import annotations

import gzip
import io
import json
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sequence import IUPAC, compatible_codons, genetic_code

#: Bytes of a file that a task reads; rows in a batch.
PART_BYTES, BATCH = 32 << 20, 1024
#: The first columns, and what stands for a state without data.
HEAD, NO_DATA = ["Node", "Site", "State"], {"?", "???"}


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at), system.get_file_info(at).size


def _text(path: str):
    handle, _ = _open(path)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=handle) if path.lower().endswith(".gz") else handle, "utf-8", errors="replace")


def state_columns(path: str) -> list[str]:
    """Names of the states of a table, from its header; fails where that isn't one."""
    with _text(path) as lines:
        for line in lines:
            if line.strip() and not line.startswith("#"):
                names = [c.strip() for c in line.rstrip("\r\n").split("\t")]
                if names[:3] != HEAD or len(names) < 4 or not all(c.startswith("p_") for c in names[3:]):
                    raise ValueError("a state table begins with the columns Node, Site and State, followed by p_ columns")
                return [c[2:] for c in names[3:]]
    raise ValueError(f"no header in {path}")


class Part(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class AncestralStates(DataSource):
    """Options: path (by load), nodes (a JSON list; all without it), partBytes. Rows: node, site (from 0), no_data, p (an array in the order of the header's states)."""

    @classmethod
    def name(cls) -> str:
        return "ancestral_states"

    def schema(self) -> str:
        return "node string, site int, no_data boolean, p array<double>"

    def reader(self, schema) -> StateReader:
        nodes = self.options.get("nodes")
        return StateReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)), None if nodes is None else json.loads(nodes))


class StateReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int, nodes: list[str] | None = None):
        self.path, self.part_bytes, self.states = path, part_bytes, state_columns(path)
        self.nodes = None if nodes is None else {n.encode() for n in nodes}

    def partitions(self) -> list[InputPartition]:
        size = _open(self.path)[1]
        if self.path.lower().endswith(".gz"):
            return [Part(0, -1)]  # can't be cut
        return [Part(k, min(k + self.part_bytes, size)) for k in range(0, size, self.part_bytes)] or [Part(0, 0)]

    def read(self, partition: Part):
        rows: list[tuple] = []
        for line in self._lines(partition):
            node, _, rest = line.partition(b"\t")
            if not line.strip() or line.startswith(b"#") or node == b"Node" or (self.nodes is not None and node not in self.nodes):
                continue
            rows.append((node.decode(errors="replace"), *self._values(rest.rstrip(b"\r\n"))))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _lines(self, part: Part):
        handle, size = _open(self.path)
        with handle:
            if part.last < 0:
                yield from gzip.GzipFile(fileobj=handle)
                return
            # a line belongs to the part in which it begins: the one that holds the byte before ours ends it
            handle.seek(max(part.first - 1, 0))
            lines = io.BufferedReader(handle, 1 << 20)
            at = max(part.first - 1, 0) + (len(lines.readline()) if part.first else 0)
            while at < part.last and (line := lines.readline()):
                at += len(line)
                yield line

    def _values(self, rest: bytes) -> tuple[int, bool, np.ndarray]:
        fields = rest.split(b"\t")
        try:
            site, text, p = int(fields[0]), fields[1].decode(), np.array(fields[2:], float)
        except (ValueError, IndexError):
            raise ValueError(f"malformed line in a state table: {rest[:80]!r}") from None
        if len(p) != len(self.states):
            raise ValueError(f"{len(self.states)} probabilities expected, {len(p)} found at site {site}")
        if text in NO_DATA:
            return site - 1, True, np.zeros(len(p))
        if not np.isfinite(p).all() or (p < 0).any() or abs(p.sum() - 1) > 1e-3:
            raise ValueError(f"probabilities at site {site} must be finite, not negative and sum to 1")
        return site - 1, False, p

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        node, site, no_data, p = zip(*rows, strict=True)
        flat = np.concatenate(p)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(self.states), dtype=np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(site, pa.int32()), pa.array(no_data, pa.bool_()), lists], ["node", "site", "no_data", "p"])


def scan_states(spark: SparkSession, path: str, nodes: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """node, site, no_data, p of a state table; only the given nodes, which the reader is told of."""
    spark.dataSource.register(AncestralStates)
    source = spark.read.format("ancestral_states").option("partBytes", part_bytes)
    return (source if nodes is None else source.option("nodes", json.dumps(nodes))).load(path)


def state_rows(scanned: DataFrame, states: list[str]) -> DataFrame:
    """node, site, state, p above 0, from scan_states and the names of the states in their order."""
    each = scanned.select("node", "site", F.posexplode("p").alias("_i", "p")).where("p > 0")
    return each.select("node", "site", F.element_at(F.array(*[F.lit(s) for s in states]), F.col("_i") + 1).alias("state"), "p")


def state_problems(scanned: DataFrame, sites: int, required: DataFrame | None = None) -> DataFrame:
    """node, problem of what an audit finds: repeated sites, sites other than 0 .. sites - 1, and ``required`` nodes (node) that are missing."""
    g = scanned.groupBy("node", "site").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("low"), F.max("site").alias("high"), F.max("k").alias("k"))
    wrong = F.when(F.col("k") > 1, "a site is repeated").when((F.col("n") != sites) | (F.col("low") != 0) | (F.col("high") != sites - 1), "sites are not 1 to n")
    out = g.select("node", wrong.alias("problem")).where("problem is not null")
    if required is None:
        return out
    return out.unionByName(required.select("node").distinct().join(g, "node", "left_anti").withColumn("problem", F.lit("missing")))


def codon_states(spark: SparkSession, ncbi_id: int = 1) -> DataFrame:
    """codon, state, p: the sense codons that each codon of nucleotides and ambiguity codes can be, in equal shares.

    A table of fixed size, made from the ambiguity codes; NNN is none of them.
    """
    rows = []
    for codon in map("".join, product(IUPAC, repeat=3)):
        of = compatible_codons(codon, ncbi_id)
        rows += [(codon, s, 1 / len(of)) for s in of]
    return spark.createDataFrame(rows, "codon string, state string, p double")


def first_states(spark: SparkSession, ncbi_id: int = 1) -> DataFrame:
    """codon, state: the first sense codon that each codon of nucleotides and ambiguity codes can be."""
    rows = [(c, of[0]) for c in map("".join, product(IUPAC, repeat=3)) if (of := compatible_codons(c, ncbi_id))]
    return spark.createDataFrame(rows, "codon string, state string")


def tip_states(records: DataFrame, ncbi_id: int = 1) -> DataFrame:
    """seq_id, site, state, p of the codons of aligned coding sequences (seq_id, sequence): ambiguous ones are shared out, gaps and unknown codons have no rows.

    Small letters and U are read as T's alphabet. Fails on a length that isn't
    a multiple of three when the rows are used. The table of codons is broadcast.
    """
    text = F.regexp_replace(F.upper("sequence"), "U", "T")
    n = (F.length("sequence") / 3).cast("int")
    whole = F.when(F.length("sequence") % 3 == 0, n).otherwise(F.raise_error(F.lit("a coding alignment's length must be a multiple of three")).cast("int"))
    sites = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.substring(text, i * 3 + 1, 3))).otherwise(F.array().cast("array<string>"))
    each = records.select("seq_id", F.posexplode(sites).alias("site", "codon"))
    return each.join(F.broadcast(codon_states(records.sparkSession, ncbi_id)), "codon").select("seq_id", "site", "state", "p")


def codon_frequencies(records: DataFrame, ncbi_id: int = 1) -> DataFrame:
    """codon, freq of the sense codons of an alignment, each ambiguous codon shared out over those it can be."""
    c = tip_states(records, ncbi_id).groupBy(F.col("state").alias("codon")).agg(F.sum("p").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("codon", (F.col("n") / F.col("t")).alias("freq"))


def all_states(code: int = 1) -> list[str]:
    """Sense codons of a code, in alphabetical order."""
    return sorted(c for c, aa in genetic_code(code).items() if aa != "*")


def observed_states(tips: DataFrame, inner: DataFrame, leaves: DataFrame) -> DataFrame:
    """node, site, state, p of a tree: inner nodes from a state table, leaves (node, seq_id) from the alignment."""
    own = tips.join(leaves, "seq_id").select("node", "site", "state", "p")
    return inner.select("node", "site", "state", "p").unionByName(own)
