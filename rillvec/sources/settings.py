"""Engine options: typed fields, a strict JSON loader, and the rules a set of options must keep."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from ..errors import InvalidArgument
from ..operators.merge import MergeConfig
from ..operators.mutate import OnlineConfig
from ..operators.triggers import MODES, MergeTrigger, RebuildTrigger


@dataclass(frozen=True)
class Settings:
    # Names and defaults of all options.
    ivf_nlist: int = 1024
    topk: int = 10
    nprobe: int = 8
    nprobe_sweep: tuple[int, ...] = field(default_factory=tuple)
    final_state_cache_mode: str = "off"
    final_state_cache_path: str = ""
    final_state_cache_store_vectors: bool = True
    use_whitening: bool = True
    use_cosine: bool = False
    dim: int = 128
    seed: int = 42
    pq_enable: bool = False
    pq_m: int = 0
    pq_nbits: int = 8
    pq_residual: bool = True
    pq_codebook_dimension_major: bool = True
    pq_codes_subquantizer_major: bool = True
    max_queries: int = 0
    snapshot_interval: int = 0
    enable_dynamic_ground_truth: bool = True
    skip_query_ground_truth: bool = False
    enable_miss_diag: bool = True
    enable_rerank_source_diag: bool = False
    enable_latency_debug: bool = False
    exact_rerank_enable: bool = False
    exact_rerank_candidates_per_route: int = 0
    main_exact_rerank_candidates: int = 0
    active_exact_rerank_candidates: int = 0
    frozen_exact_rerank_candidates: int = 0
    enable_streaming: bool = False
    main_index_rows: int = 0
    delta_train_window: int = 1
    delta_ivf_nlist: int = 0
    merge_score_alpha: float = 1.0
    merge_score_beta: float = 1e-7
    merge_score_threshold: float = 10.0
    merge_trigger_mode: str = "rows"
    merge_trigger_rows: int = 0
    merge_trigger_qe_ratio: float = 0.0
    merge_trigger_drift: float = 0.0
    merge_trigger_delta_main_ratio: float = 0.0
    merge_trigger_imbalance_ratio: float = 0.0
    enable_merge: bool = True
    merge_assignment_mode: str = "balanced_append"
    merge_assignment_top_r: int = 4
    merge_assignment_gamma: float = 1.05
    merge_assignment_hard_cap_ratio: float = 1.5
    merge_assignment_lambda: float = 0.2
    enable_global_rebuild: bool = False
    global_rebuild_max_count: int = 0
    global_rebuild_main_imbalance_ratio: float = 0.0
    global_rebuild_force_main_rows: int = 0
    global_rebuild_cooldown_rows: int = 0
    streaming_mode: str = "streaming"
    stream_batch_size: int = 100
    streaming_use_stream_batch_size: bool = False
    online_pq_enable: bool = True
    online_pq_update_scheme: str = "minibatch"
    online_pq_sliding_window_size: int = 0
    online_pq_sliding_window_use_batches: bool = True
    online_pq_qe_ratio_threshold: float = 1.05
    online_pq_ema_alpha: float = 0.1
    online_pq_eps: float = 1e-6
    online_pq_warmup_enable: bool = False
    online_pq_warmup_batches: int = 0
    online_pq_force_update_interval: int = 0
    online_pq_partial_top_alpha: bool = False
    online_pq_alpha: float = 1.0
    online_pq_partial_top_lambda: bool = False
    online_pq_lambda: float = 1.0
    online_pq_reencode_batch: bool = True
    concurrent_workload_enable: bool = False
    concurrent_query_workers: int = 1
    concurrent_query_threads_per_request: int = 1
    concurrent_insert_threads: int = 1
    concurrent_maintenance_threads: int = 1
    concurrent_target_insert_vecps: float = 0.0
    concurrent_init_mode: str = "off"
    concurrent_init_path: str = ""
    concurrent_gt_mode: str = "off"
    concurrent_gt_path: str = ""

    def validate(self) -> Settings:
        """These settings, with aliases resolved; raises on the first broken rule."""
        s = replace(self, merge_assignment_mode="balanced_append") if self.merge_assignment_mode == "local_constrained" else self
        for f in fields(s):
            value = getattr(s, f.name)
            if isinstance(value, int) and not isinstance(value, bool) and value < 0:
                raise InvalidArgument(f"{f.name} must not be negative")
        for name, allowed in CHOICES.items():
            if getattr(s, name) not in allowed:
                raise InvalidArgument(f"{name} must be one of {', '.join(allowed)}")
        for name, (low, closed, high) in RANGES.items():
            value = getattr(s, name)
            if value < low or (value == low and not closed) or (high is not None and value > high):
                raise InvalidArgument(f"{name} is out of range: {value}")
        for broken, message in RULES:
            if broken(s):
                raise InvalidArgument(message)
        return s

    # --- what operators take ---

    @property
    def merge(self) -> MergeConfig:
        return MergeConfig(self.merge_assignment_mode, self.merge_assignment_top_r, self.merge_assignment_gamma, self.merge_assignment_hard_cap_ratio, self.merge_assignment_lambda, self.merge_score_alpha, self.merge_score_beta, self.merge_score_threshold)

    @property
    def online(self) -> OnlineConfig:
        return OnlineConfig(
            self.online_pq_enable,
            self.online_pq_force_update_interval,
            self.online_pq_ema_alpha,
            self.online_pq_eps,
            self.online_pq_warmup_batches if self.online_pq_warmup_enable else 0,
            self.online_pq_alpha if self.online_pq_partial_top_alpha else None,
            self.online_pq_lambda if self.online_pq_partial_top_lambda else None,
            self.online_pq_reencode_batch,
        )

    def merge_trigger(self, train_rows: int) -> MergeTrigger:
        return MergeTrigger(self.merge_trigger_mode, self.merge_trigger_rows, train_rows, self.merge_trigger_qe_ratio, self.merge_trigger_drift, self.merge_trigger_delta_main_ratio, self.merge_trigger_imbalance_ratio, self.enable_merge)

    @property
    def rebuild_trigger(self) -> RebuildTrigger:
        return RebuildTrigger(self.enable_global_rebuild, self.global_rebuild_max_count, self.global_rebuild_main_imbalance_ratio, self.global_rebuild_force_main_rows, self.global_rebuild_cooldown_rows)

    def main_rows(self, total: int) -> int:
        return min(total, self.main_index_rows or max(1, total // 2))

    def batch_rows(self) -> int:
        return self.stream_batch_size if self.streaming_mode == "batch" or self.streaming_use_stream_batch_size else 1

    def train_rows(self) -> int:
        """Rows that a new recent index is trained on."""
        return self.delta_train_window * self.batch_rows()


#: Options that are read and checked, and then change nothing: executors decide layouts and threads.
NO_EFFECT: tuple[str, ...] = (
    "concurrent_insert_threads", "concurrent_maintenance_threads", "concurrent_query_threads_per_request", "enable_miss_diag", "enable_rerank_source_diag", "enable_latency_debug",
    "online_pq_qe_ratio_threshold", "pq_codebook_dimension_major", "pq_codes_subquantizer_major",
)


def without_effect(s: Settings) -> list[str]:
    """Options that were set away from their defaults and change nothing here."""
    default = Settings()
    return [name for name in NO_EFFECT if getattr(s, name) != getattr(default, name)]


# Allowed words.
CHOICES: dict[str, tuple[str, ...]] = {
    "streaming_mode": ("streaming", "batch"),
    "concurrent_gt_mode": ("off", "prepare", "load"),
    "concurrent_init_mode": ("off", "prepare", "load"),
    "merge_trigger_mode": tuple(MODES),
    "merge_assignment_mode": ("nearest", "balanced_append"),
    "online_pq_update_scheme": ("minibatch", "sliding_window"),
    "final_state_cache_mode": ("off", "save", "load", "prepare"),
}
# Fixed values: (lower limit, is it allowed, upper limit).
RANGES: dict[str, tuple[float, bool, float | None]] = {
    "stream_batch_size": (0, False, None),
    "concurrent_target_insert_vecps": (0, True, None),
    "merge_score_alpha": (0, True, None),
    "merge_score_beta": (0, True, None),
    "merge_score_threshold": (0, True, None),
    "merge_trigger_qe_ratio": (0, True, None),
    "merge_trigger_drift": (0, True, None),
    "merge_trigger_delta_main_ratio": (0, True, None),
    "merge_trigger_imbalance_ratio": (0, True, None),
    "merge_assignment_top_r": (0, False, None),
    "merge_assignment_gamma": (0, False, None),
    "merge_assignment_hard_cap_ratio": (0, False, None),
    "merge_assignment_lambda": (0, True, None),
    "global_rebuild_main_imbalance_ratio": (0, True, None),
    "online_pq_ema_alpha": (0, False, 1),
    "online_pq_eps": (0, False, None),
    "online_pq_alpha": (0, False, 1),
    "online_pq_lambda": (0, False, 1),
}

_STATE = ("merge_trigger_qe_ratio", "merge_trigger_drift", "merge_trigger_delta_main_ratio", "merge_trigger_imbalance_ratio")
_ALONE = {"qe_ratio": _STATE[0], "drift": _STATE[1], "delta_main_ratio": _STATE[2], "imbalance": _STATE[3]}

RULES: tuple[tuple[Callable[[Settings], bool], str], ...] = (
    (lambda s: s.concurrent_init_mode != "off" and not s.concurrent_init_path, "an initial state needs concurrent_init_path"),
    (lambda s: s.concurrent_gt_mode != "off" and not s.concurrent_gt_path, "a saved truth needs concurrent_gt_path"),
    (lambda s: s.concurrent_workload_enable and not all((s.concurrent_query_workers, s.concurrent_query_threads_per_request, s.concurrent_insert_threads, s.concurrent_maintenance_threads)), "a concurrent workload needs at least one thread of each kind"),
    (lambda s: s.exact_rerank_enable and s.exact_rerank_candidates_per_route < max(1, s.topk), "an exact rerank needs topk candidates a route or more"),
    (lambda s: s.enable_rerank_source_diag and not s.exact_rerank_enable, "rerank diagnostics need the exact rerank"),
    (lambda s: s.enable_streaming and not s.delta_train_window, "streaming needs a training window"),
    (lambda s: s.merge_trigger_mode in _ALONE and not getattr(s, _ALONE[s.merge_trigger_mode]), "the merge mode's own threshold must be above 0"),
    (lambda s: s.merge_trigger_mode == "state" and not any(getattr(s, x) for x in _STATE), "merge mode state needs a threshold above 0"),
    (lambda s: s.merge_trigger_mode == "hybrid" and not s.merge_trigger_rows and not any(getattr(s, x) for x in _STATE), "merge mode hybrid needs a threshold above 0"),
    (lambda s: s.enable_global_rebuild and not s.global_rebuild_max_count, "rebuilds need a count above 0"),
    (lambda s: s.enable_global_rebuild and not s.global_rebuild_main_imbalance_ratio and not s.global_rebuild_force_main_rows, "rebuilds need a trigger"),
    (lambda s: s.online_pq_update_scheme == "sliding_window" and not s.online_pq_sliding_window_size, "a sliding window needs a size"),
    (lambda s: s.online_pq_update_scheme == "sliding_window" and not s.online_pq_force_update_interval, "a sliding window needs an update interval"),
    (lambda s: s.online_pq_warmup_enable and not s.online_pq_warmup_batches, "a warm-up needs batches"),
    (lambda s: 0 in s.nprobe_sweep, "nprobe_sweep values must be positive"),
    (lambda s: s.final_state_cache_mode != "off" and not s.final_state_cache_path, "the final-state cache needs a path"),
    (lambda s: s.final_state_cache_mode == "load" and not s.nprobe_sweep, "loading the final state needs nprobe_sweep"),
    (lambda s: s.final_state_cache_mode == "prepare" and bool(s.nprobe_sweep), "preparing the final state excludes nprobe_sweep"),
)


def parse(text: str) -> Settings:
    """Settings of a flat JSON object; unknown names and wrong types are errors."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise InvalidArgument(f"not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise InvalidArgument("settings must be one object")
    defaults = asdict(Settings())
    out = {}
    for name, value in raw.items():
        if name not in defaults:
            raise InvalidArgument(f"unknown setting {name}")
        like = defaults[name]
        if isinstance(like, tuple):
            if not isinstance(value, list) or not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in value):
                raise InvalidArgument(f"{name} must be a list of whole numbers")
            value = tuple(value)
        elif isinstance(like, float):
            if isinstance(value, bool) or not isinstance(value, int | float):
                raise InvalidArgument(f"{name} must be a number")
            value = float(value)
        elif type(value) is not type(like):
            raise InvalidArgument(f"{name} must be {type(like).__name__}")
        out[name] = value
    return Settings(**out).validate()


def load(spark, path: str) -> Settings:
    """Settings from a file in any store that Spark reads."""
    return parse("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
