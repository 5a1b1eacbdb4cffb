"""Rooted trees: Newick text to node, closure and distance tables.

A tree is a few thousand nodes at most, so its text is parsed on the driver;
the tables are DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_PART = re.compile(r"\s*([(),:;]|'[^']*'|[^(),:;\s]+)")


@dataclass
class Node:
    name: str = ""
    dist: float = 0.0
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    branch_id: int = -1

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if not n.children]


def parse(text: str) -> Node:
    """The root of a Newick tree with exactly two children; node ids rank the clades' leaf sets.

    Leaves are ranked by name; a clade's key is the sum of 2**rank of its
    leaves, as a whole number of any size.
    """
    parts = _PART.findall(text.strip())
    root = node = Node()
    k = 0
    while k < len(parts) and parts[k] != ";":
        p = parts[k]
        if p in "(,":
            up = node if p == "(" else node.parent
            if up is None:
                raise ValueError("unbalanced tree")
            node = Node(parent=up)
            up.children.append(node)
        elif p == ")":
            node = node.parent
            if node is None:
                raise ValueError("unbalanced tree")
        elif p == ":":
            k += 1
            node.dist = float(parts[k])
        else:
            node.name = clean_name(p)
        k += 1
    if node is not root:
        raise ValueError("unbalanced tree")
    if len(root.children) != 2:
        raise ValueError("the root must have two children")
    names = [x.name for x in root.leaves()]
    if len(set(names)) != len(names):
        raise ValueError("leaf names repeat")
    rank = {n: i for i, n in enumerate(sorted(names))}
    key = {id(n): sum(1 << rank[x.name] for x in n.leaves()) for n in root.walk()}
    for i, n in enumerate(sorted(root.walk(), key=lambda n: key[id(n)])):
        n.branch_id = i
    return root


def clean_name(name: str) -> str:
    return re.sub(r"[\[/].*", "", name.strip().strip("'\"")).strip("'\"")


def nodes(spark: SparkSession, root: Node) -> DataFrame:
    rows = [(n.branch_id, n.parent.branch_id if n.parent else None, n.name, n.dist, not n.children, n.parent is None) for n in root.walk()]
    return spark.createDataFrame(rows, "node int, parent int, name string, dist double, is_leaf boolean, is_root boolean")


def closure(spark: SparkSession, root: Node) -> DataFrame:
    """anc, leaf: each node with the leaves below it (itself, if it is one)."""
    return spark.createDataFrame([(n.branch_id, x.branch_id) for n in root.walk() for x in n.leaves()], "anc int, leaf int")


def count_independent(root: Node, largest: int, exclude_sisters: bool = False) -> list[int]:
    """Number of sets of 1 .. ``largest`` branches of which none is an ancestor (or sister) of another.

    Bottom-up product of counting polynomials; whole numbers of any size. The
    root is no branch.
    """

    def times(a, b):
        out = [0] * (largest + 1)
        for i, x in enumerate(a):
            for j, y in enumerate(b[: largest + 1 - i]):
                out[i + j] += x * y
        return out

    poly: dict[int, list[int]] = {}
    for n in reversed(list(root.walk())):
        own = [1] + [0] * largest
        if n.children:
            for c in n.children:
                own = times(own, poly[id(c)])
            if exclude_sisters:
                # sets that hold two or more of the children themselves
                below = [[p - (i == 1) for i, p in enumerate(poly[id(c)])] for c in n.children]
                at_most_one = _at_most_one(below, times, largest)
                own = at_most_one
        if n.parent is not None and largest >= 1:
            own[1] += 1
        poly[id(n)] = own
    return poly[id(root)][1:]


def _at_most_one(below, times, largest):
    """Product over children where at most one child is chosen itself and the others give sets below them."""
    none, one = [1] + [0] * largest, [0] * (largest + 1)
    for p in below:
        shifted = [0, 1] + [0] * (largest - 1) if largest else [0]
        one = [a + b for a, b in zip(times(one, p), times(none, shifted[: largest + 1]), strict=True)]
        none = times(none, p)
    return [a + b for a, b in zip(none, one, strict=True)]
