"""Run parameters, validated, and the scalars that follow from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

GAMMA = 1.5
SCORES = ("anr", "haa", "cms", "nss", "cbs", "cbsq")
DYNAMICS = ("original", "double", "linear", "quadratic", "midlinear", "midquadratic", "midconstant", "edgecut")
ORDERS = ("natural", "degree", "random")
MATCHERS = ("cluster", "paths", "random")
STOP_RULES = ("multibfs", "multiple_k", "strong", "simple", "separator")


@dataclass(frozen=True)
class PartitionConfig:
    """Every option of a run. Percentages are percent; ``batch_size`` 0 means n / k, ``d_max`` -1 means unlimited."""

    k: int = 2
    seed: int = 0
    imbalance: float = 3.0
    passes: int = 1
    batch_size: int = 16384
    buffer_size: int = 0
    bb_ratio: int = 0
    disc_factor: int = 1000
    d_max: int = 10000
    score: str = "haa"
    haa_beta: float = 2.0
    theta: float = 0.75
    cbs_theta: float = 2.0
    ghost_weight: float = 0.2
    ghosts: bool = False
    model_ghosts: bool = False
    include_high_degree: bool = False
    balance_edges: bool = False
    use_queue: bool = True
    sqrt_mode: str = "exact"
    ties: str = "lowest"
    restream_all: bool = False
    dynamics: str = "original"
    label_rounds: int = 5
    refine_rounds: int = 5
    coarse_factor: int = 4
    cluster_factor: int = 18
    stop_rule: str = "multibfs"
    order: str = "natural"
    batch_imbalance: float = 20.0
    ensembles: int = 1
    cycles: int = 1
    matcher: str = "cluster"
    improve_initial: bool = False
    pull_neighbours: bool = False
    place_surrounded: bool = False
    # edge mode
    minimal_mode: bool = True
    past_subset_size: int = -1
    batch_alpha: bool = True
    dynamic_alpha: bool = False
    num_split_edges: int = -1
    reps: int = 1

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be 1 or more")
        if self.score == "gts":
            raise ValueError("score 'gts' has no definition")
        for value, known, what in ((self.score, SCORES, "score"), (self.dynamics, DYNAMICS, "dynamics"), (self.order, ORDERS, "order"), (self.matcher, MATCHERS, "matcher"), (self.stop_rule, STOP_RULES, "stop_rule"), (self.sqrt_mode, ("exact", "fast"), "sqrt_mode"), (self.ties, ("lowest", "coin"), "ties")):
            if value not in known:
                raise ValueError(f"{what} {value!r} is not one of {', '.join(known)}")
        if self.passes < 1 or self.batch_size < 0 or self.buffer_size < 0:
            raise ValueError("passes must be 1 or more, batch and buffer sizes 0 or more")

    @property
    def ghosting(self) -> bool:
        return self.ghosts or self.model_ghosts

    @property
    def degree_limit(self) -> float:
        return math.inf if self.d_max < 0 else self.d_max

    def mode(self) -> str:
        """Which node driver a configuration asks for: buffered, direct or batches."""
        if self.buffer_size > 1:
            return "buffered"
        return "direct" if self.batch_size == 1 else "batches"

    def batch_length(self, n: int) -> int:
        if self.bb_ratio and self.buffer_size:
            return max(1, self.buffer_size // self.bb_ratio)
        return self.batch_size or max(1, math.ceil(n / self.k))

    def with_(self, **changes) -> PartitionConfig:
        return replace(self, **changes)


def alpha_gamma(n: int, m: int, k: int) -> float:
    """The node objective's factor alpha * gamma, alpha = m k^(gamma-1) / n^gamma."""
    return GAMMA * m * k ** (GAMMA - 1) / n**GAMMA if n else 0.0


def edge_alpha_gamma(n: int, m: int, k: int, cfg: PartitionConfig, split_edges: float | None = None, remaining: float | None = None, spent: float = 0) -> float:
    """The edge objective's factor: from the batch's split graph and the remaining edges if ``batch_alpha``, else from 5m or the given number; with ``dynamic_alpha`` from what the split graphs so far (``spent``) leave of 6m, and the remaining edges."""
    if cfg.num_split_edges > 0 and n:
        return GAMMA * cfg.num_split_edges * k ** (GAMMA - 1) / max(m, 1) ** GAMMA
    if cfg.batch_alpha and split_edges is not None and remaining:
        return GAMMA * split_edges * k ** (GAMMA - 1) / remaining**GAMMA
    if cfg.dynamic_alpha and remaining:
        return GAMMA * (6 * m - spent) * k ** (GAMMA - 1) / remaining**GAMMA
    return GAMMA * (6 if cfg.dynamic_alpha else 5) * m * k ** (GAMMA - 1) / m**GAMMA if m else 0.0


def capacity(total_weight: float, k: int, imbalance: float, last_pass: bool) -> int:
    """Largest load of a block; passes before the last have half as much slack again."""
    slack = imbalance if last_pass else 1.5 * imbalance
    exact = (100 + slack) * total_weight / (100 * k)
    return math.ceil(round(exact, 9))


def batch_slack(cfg: PartitionConfig, n: int, assigned: float, in_batch: float, this_pass: int) -> float:
    """Percent of imbalance allowed to one batch's model: early batches get more room."""
    own = cfg.imbalance
    if this_pass > 0 and this_pass >= cfg.passes - 1:
        return own
    eps = 100 * n * (1 + own / 100) / max(assigned + in_batch, 1) - 100
    return min(eps, cfg.batch_imbalance) if cfg.passes > 1 else min(max(own, 0.75 * eps), cfg.batch_imbalance)


def model_bound(weight: float, k: int, eps: float) -> float:
    even = math.ceil(weight / k)
    return (1 + eps / 100) * even if eps else 1.01 * even


def dynamics_weight(kind: str, remaining: float, total: float) -> float:
    """Weight of the penalty as the stream goes on."""
    r = remaining / total if total else 0.0
    t = 2 * r
    return {"original": 1.0, "double": 2.0, "linear": t, "quadratic": 2 * r * r, "midlinear": 2 * t if t <= 1 else 2.0, "midquadratic": 2 * t * t if t <= 1 else 2.0, "midconstant": 0.5 if r <= 1.5 else 2.0, "edgecut": 0.0}[kind]


def refinement_weight(cfg: PartitionConfig, remaining: float, m: int) -> float:
    """Weight of the penalty in a batch's refinement, from the vertices not placed before it and the stream's edges; the initial partition and single vertices always weigh it once."""
    return 0.0 if remaining <= 0 and cfg.dynamics != "original" else dynamics_weight(cfg.dynamics, remaining, m)
