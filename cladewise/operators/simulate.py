"""Sequences simulated down a tree, and gaps inferred up it.

Sites are independent: Spark spreads them, a task walks the (small) tree for a
batch of sites at once. Random streams are seeded by (seed, site), so results
don't depend on partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources.newick import Node
from .expected import eigen


def _order(root: Node) -> list[tuple[int, int | None, float]]:
    """(branch id, parent's id, length) from the root down."""
    return [(n.branch_id, n.parent.branch_id if n.parent else None, n.dist) for n in root.walk()]


def evolve(spark: SparkSession, root: Node, q: np.ndarray, pi: np.ndarray, sites: int, rates: list[float] | None = None, biased: dict[int, np.ndarray] | None = None, seed: int = 1) -> DataFrame:
    """node, site, state (number): states at all nodes, drawn from the stationary law at the root.

    ``rates`` are dealt to sites in turn; ``biased`` gives branches their own
    (reversible, same ``pi``) rate matrix, as convergent partitions need.
    """
    tree, kinds = _order(root), {None: eigen(q, pi)} | {b: eigen(m, pi) for b, m in (biased or {}).items()}
    rates = rates or [1.0]
    cum_pi = np.cumsum(pi)

    def run(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            draws = np.stack([np.random.default_rng([seed, int(i)]).random(len(tree)) for i in ids]) if len(ids) else np.zeros((0, len(tree)))
            scale = np.array([rates[int(i) % len(rates)] for i in ids])
            states: dict[int, np.ndarray] = {}
            for k, (node, parent, t) in enumerate(tree):
                if parent is None:
                    states[node] = np.minimum(np.searchsorted(cum_pi, draws[:, k] * cum_pi[-1]), len(pi) - 1)
                else:
                    left, values, right = kinds.get(node, kinds[None])
                    p = np.clip((left[states[parent]] * np.exp(values[None, :] * (t * scale)[:, None])) @ right, 0, None)
                    c = np.cumsum(p, axis=1)
                    states[node] = np.minimum((c < draws[:, k : k + 1] * c[:, -1:]).sum(axis=1), len(pi) - 1)
                yield pd.DataFrame({"node": node, "site": ids.astype(np.int32), "state": states[node].astype(np.int32)})

    return spark.range(sites).mapInPandas(run, "node int, site int, state int")


def biased_rates(q: np.ndarray, pi: np.ndarray, targets: list[int], percent: float) -> np.ndarray:
    """A reversible matrix whose changes into ``targets`` hold ``percent`` of all flow, scaled to one change per unit time."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 0 and 100")
    flow = pi[:, None] * q
    np.fill_diagonal(flow, 0)
    hit = np.zeros(len(pi), bool)
    hit[targets] = True
    into = hit[None, :] | hit[:, None]  # both directions, so that it stays reversible
    share = flow[into].sum() / flow.sum()
    flow = np.where(into, flow * (percent / 100) / share, flow * (1 - percent / 100) / (1 - share))
    out = flow / pi[:, None]
    np.fill_diagonal(out, -out.sum(axis=1))
    return out / -(pi @ np.diag(out))


def gap_presence(presence: DataFrame, root: Node) -> DataFrame:
    """node, site, present: whether each node has a residue at a site, by parsimony (0/1 costs).

    presence: tip (branch id), site, present. Costs are summed up the tree and
    states assigned down it; on a tie a node follows its parent, the root the
    majority of tips, and presence if that ties too. Tips without a row have a gap.
    """
    tree = _order(root)
    tips = {n.branch_id for n in root.leaves()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        site, seen = pdf["site"].iloc[0], set(pdf.loc[pdf["present"], "tip"])
        cost = {n: [0.0, 0.0] for n, *_ in tree}
        for node, parent, _ in reversed(tree):
            if node in tips:
                cost[node] = [np.inf, 0.0] if node in seen else [0.0, np.inf]
            if parent is not None:
                for s in (0, 1):
                    cost[parent][s] += min(cost[node][s], cost[node][1 - s] + 1)
        state: dict[int, int] = {}
        for node, parent, _ in tree:
            absent, present = cost[node]
            if parent is None:
                state[node] = int(present < absent or (present == absent and 2 * len(seen) >= len(tips)))
            else:
                up = state[parent]
                state[node] = up if cost[node][up] <= cost[node][1 - up] + 1 else 1 - up
        return pd.DataFrame({"node": list(state), "site": site, "present": [bool(x) for x in state.values()]})

    return presence.groupBy("site").applyInPandas(run, f"node int, site {presence.schema['site'].dataType.simpleString()}, present boolean")
