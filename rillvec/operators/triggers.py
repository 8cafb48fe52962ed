"""When to merge and when to rebuild: pure functions of a few numbers."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidArgument

# The predicates that each mode listens to, and what a predicate is called in reports.
STATE = ("imbalance", "delta_main_ratio", "qe_ratio", "drift")
MODES: dict[str, tuple[str, ...]] = {
    "rows": ("rows",),
    "qe_ratio": ("qe_ratio",),
    "drift": ("drift",),
    "imbalance": ("imbalance",),
    "delta_main_ratio": ("delta_main_ratio",),
    "state": STATE,
    "hybrid": ("rows", *STATE),
}
REASONS = {"rows": "delta_full", "imbalance": "structure_imbalance", "delta_main_ratio": "delta_main_ratio", "qe_ratio": "qe_ratio", "drift": "drift"}


@dataclass(frozen=True)
class Decision:
    fires: bool
    reason: str


@dataclass(frozen=True)
class MergeTrigger:
    """A threshold of 0 switches its predicate off; ``rows`` falls back to ``train_rows``."""

    mode: str = "rows"
    rows: int = 0
    train_rows: int = 0
    qe_ratio: float = 0.0
    drift: float = 0.0
    delta_main_ratio: float = 0.0
    imbalance: float = 0.0
    enable: bool = True

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise InvalidArgument(f"unknown merge mode {self.mode}")

    def decide(self, delta_rows: int, main_rows: int, qe_ratio: float = 1.0, drift: float = 0.0, imbalance: float = 0.0) -> Decision:
        """Fires on the mode's predicates; the reason names every predicate that holds, joined by ``+``."""
        if not self.train_rows or not delta_rows:
            return Decision(False, "none")
        if not self.enable:
            return Decision(False, "merge_disabled")
        share = delta_rows / main_rows if main_rows else 0.0
        seen = {"rows": (delta_rows, self.rows or self.train_rows), "imbalance": (imbalance, self.imbalance), "delta_main_ratio": (share, self.delta_main_ratio), "qe_ratio": (qe_ratio, self.qe_ratio), "drift": (drift, self.drift)}
        holds = [p for p, (value, limit) in seen.items() if limit > 0 and value >= limit]
        fires = any(p in MODES[self.mode] for p in holds)
        return Decision(fires, "+".join(REASONS[p] for p in holds) if fires else "none")


@dataclass(frozen=True)
class RebuildTrigger:
    """``max_count`` of 0 allows no rebuild at all."""

    enable: bool = False
    max_count: int = 0
    imbalance: float = 0.0
    force_rows: int = 0
    cooldown_rows: int = 0

    def decide(self, main_rows_since: int, imbalance: float, done: int, seen_rows: int, last_seen: int = 0) -> Decision:
        if not self.enable or not self.max_count:
            return Decision(False, "none")
        if done >= self.max_count:
            return Decision(False, "max_count_reached")
        found = []
        if self.force_rows and main_rows_since >= self.force_rows:
            found.append("main_rows")
        if self.imbalance and imbalance >= self.imbalance:
            found.append("main_structure_imbalance")
        if found and self.cooldown_rows and 0 < seen_rows - last_seen < self.cooldown_rows:
            return Decision(False, "cooldown")
        return Decision(bool(found), "+".join(found) or "none")
