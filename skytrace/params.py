"""Parameter sets for detection, tracking and statistics, with their documented defaults."""

from __future__ import annotations

import argparse
import json
import shlex
import math
from dataclasses import dataclass, field, replace

DECAY = 0.01


def scale_to_filter_width(t: float, decay: float = DECAY) -> float:
    return math.sqrt(math.ceil(-2.0 * t * math.log(decay))) / 2.0


def filter_width_to_scale(width: float, decay: float = DECAY) -> float:
    return -2.0 * width * width / math.log(decay)


@dataclass(frozen=True)
class Grid:
    """A regular grid, slowest dimension first. Axis units other than km count as metres."""

    dims: tuple[str, ...]
    sizes: tuple[int, ...]
    resolution: tuple[float, ...]
    origin: tuple[float, ...]
    units: tuple[str, ...]

    @property
    def cells(self) -> int:
        return math.prod(self.sizes)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(math.prod(self.sizes[i + 1:]) for i in range(len(self.sizes)))

    @property
    def meters(self) -> tuple[float, ...]:
        return tuple(1000.0 if u == "km" else 1.0 for u in self.units)

    def reach(self, ranges: tuple[float, ...]) -> dict[str, int]:
        """Largest index distance a spatial range can span, per dimension."""
        return {d: int(math.ceil(h / r)) for d, h, r in zip(self.dims, ranges, self.resolution)}


@dataclass(frozen=True)
class DetectionParams:
    variables: tuple[str, ...]
    lower: dict[str, float] = field(default_factory=dict)
    upper: dict[str, float] = field(default_factory=dict)
    replacement: dict[str, float] = field(default_factory=dict)
    kernel: str = "uniform"
    weight: str = "default"
    weight_lower: float = 0.0
    weight_upper: float | None = None
    scale: float | None = None
    ranges: tuple[float, ...] | None = None
    min_cluster_size: int = 1
    time_index: int = -1
    replacement_filters: tuple[tuple[str, str, float], ...] = ()
    convection_variable: str | None = None
    coalesce: bool = False
    postprocess_with_previous: bool = False
    spatial_range_only: bool = False
    symmetric_smoothing: bool = True
    replace_zero_shifts: bool = False
    add_strongest_neighbour: bool = False
    ci_satellite_only: bool = False
    ci_original_limits: bool = False
    ci_compare_previous: bool = False
    ci_protocluster_scale: float = 25.0
    ci_protocluster_min_size: int = 10

    def bandwidth(self, grid: Grid, limits: dict[str, tuple[float, float]]) -> tuple[float, ...]:
        """Explicit ranges (dimensions, then variables), else filter width and valid ranges."""
        if self.ranges:
            return self.ranges
        width = scale_to_filter_width(1.0 if self.scale is None else self.scale)
        return tuple(width for _ in grid.dims) + tuple(limits[v][1] - limits[v][0] for v in self.variables)

    def kernel_size(self, grid: Grid) -> float:
        if self.ranges:
            return sum(self.ranges[: len(grid.dims)]) / len(grid.dims)
        # without ranges or scale the size would be 0 and every kernel value undefined: use 1
        return 1.0 if self.scale is None else scale_to_filter_width(self.scale)


@dataclass(frozen=True)
class TrackingParams:
    range_weight: float = 1.0
    size_weight: float = 1.0
    correlation_weight: float = 0.0
    continue_ids: bool = True
    merge_split_threshold: float = 1.0 / 3.0
    continuation_threshold: float = 0.75
    max_velocity: float = 50.0
    max_delta_t: float = 915.0
    use_overlap_constraint: bool = True
    max_size_deviation: float = 3.0
    tracking_variable: str | None = None
    use_displacement_vectors: bool = False


# Default class limits of the statistics histograms.
LENGTH_CLASSES = tuple(range(5, 111, 5))
SIZE_CLASSES = (100, 200, 300, 400, 500, 1000, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 25000, 50000, 100000)
CLUSTER_CLASSES = (10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 10000000)
SPEED_CLASSES = tuple(range(2, 61, 2))
DIRECTION_CLASSES = (
    15, 30, 45, 60, 75, 90, 105, 120, 135, 150, 175, 200, 215, 230, 245, 260, 275, 300, 315, 330, 345, 360,
)


@dataclass(frozen=True)
class StatsParams:
    exclude_degenerates: bool = True
    length_classes: tuple[float, ...] = LENGTH_CLASSES
    size_classes: tuple[float, ...] = SIZE_CLASSES
    cluster_classes: tuple[float, ...] = CLUSTER_CLASSES
    speed_classes: tuple[float, ...] = SPEED_CLASSES
    direction_classes: tuple[float, ...] = DIRECTION_CLASSES


def parse_assignments(text: str | None) -> dict[str, float]:
    """``a=1,b=2`` as a dict."""
    if not text:
        return {}
    return {k.strip(): float(v) for k, v in (item.split("=") for item in text.split(","))}


def parse_replacement_filters(text: str | None) -> tuple[tuple[str, str, float], ...]:
    """``name-lowest-25,name-median`` as (variable, mode, fraction); a missing percentage means all values."""
    if not text:
        return ()
    out = []
    for item in text.split(","):
        parts = item.split("-")
        if parts[1] not in ("lowest", "highest", "median"):
            raise ValueError(f"unknown replacement mode {parts[1]!r}")
        out.append((parts[0], parts[1], float(parts[2]) / 100.0 if len(parts) > 2 else 1.0))
    return tuple(out)


def path_get(tree: dict, path: str, default=None):
    """Value at a dotted key path; falsy values are kept."""
    node = tree
    for key in path.split("."):
        if not isinstance(node, dict) or key not in node:
            return default
        node = node[key]
    return node


def path_set(tree: dict, path: str, value) -> dict:
    *parents, last = path.split(".")
    node = tree
    for key in parents:
        node = node.setdefault(key, {})
    node[last] = value
    return tree


class _Strict(argparse.ArgumentParser):
    """Option strings of a configuration: a long option may be shortened, an unknown one is an error."""

    def error(self, message: str):
        raise ValueError(f"option string: {message}")


def _flag(p: argparse.ArgumentParser, *names: str, field: str) -> None:
    p.add_argument(*names, dest=field, action="store_true", default=None)


def _detection_options() -> argparse.ArgumentParser:
    p = _Strict(add_help=False)
    p.add_argument("--variables", "-v", dest="variables", type=lambda t: tuple(t.split(",")))
    p.add_argument("--dimensions", "-d", dest="dimensions", type=lambda t: tuple(t.split(",")))
    for name, field in (("lower-thresholds", "lower"), ("upper-thresholds", "upper"), ("replacement-values", "replacement")):
        p.add_argument("--" + name, dest=field, type=parse_assignments)
    p.add_argument("--kernel-name", "-k", dest="kernel", choices=["uniform", "gauss", "epanechnikov", "none"])
    p.add_argument("--weight-function-name", "-w", dest="weight")
    p.add_argument("--wwf-lower-threshold", dest="weight_lower", type=float)
    p.add_argument("--wwf-upper-threshold", dest="weight_upper", type=float)
    p.add_argument("--scale", "-s", dest="scale", type=float)
    p.add_argument("--ranges", "-r", dest="ranges", type=lambda t: tuple(float(v) for v in t.split(",")))
    p.add_argument("--min-cluster-size", "-m", dest="min_cluster_size", type=int)
    p.add_argument("--time-index", "-t", dest="time_index", type=int)
    p.add_argument("--replacement-filter", dest="replacement_filters", type=parse_replacement_filters)
    p.add_argument("--convection-filter-variable", dest="convection_variable")
    p.add_argument("--ci-protocluster-scale", dest="ci_protocluster_scale", type=float)
    p.add_argument("--ci-protocluster-min-size", dest="ci_protocluster_min_size", type=int)
    _flag(p, "--ci-satellite-only", field="ci_satellite_only")
    _flag(p, "--ci-use-walker-mecikalski", field="ci_original_limits")
    _flag(p, "--coalesce-with-strongest-neighbour", field="coalesce")
    _flag(p, "--postprocess-with-previous-output", field="postprocess_with_previous")
    _flag(p, "--spatial-range-only", field="spatial_range_only")
    return p


def _tracking_options() -> argparse.ArgumentParser:
    p = _Strict(add_help=False)
    p.add_argument("--tracking-variable", "-t", dest="tracking_variable")
    for name, field in (("wr", "range_weight"), ("ws", "size_weight"), ("wt", "correlation_weight"), ("merge-split-threshold", "merge_split_threshold"),
                        ("merge-split-continuation-threshold", "continuation_threshold"), ("max-speed", "max_velocity"), ("max-time", "max_delta_t"),
                        ("max-size-deviation", "max_size_deviation")):
        p.add_argument("--" + name, dest=field, type=float)
    _flag(p, "--use-displacement-vectors", field="use_displacement_vectors")
    p.add_argument("--discontinue-id-in-merge-and-split", dest="continue_ids", action="store_false", default=None)
    return p


def _given(parser: argparse.ArgumentParser, text: str | None) -> dict:
    """Fields that an option string sets. Options about messages and pictures are accepted and left out."""
    parser.add_argument("--verbosity", dest="_verbosity")
    parser.add_argument("--vtk-dimensions", dest="_pictures")
    found = vars(parser.parse_args(shlex.split(text or "")))
    return {k: v for k, v in found.items() if v is not None and not k.startswith("_")}


def _option_string(config: dict, part: str, ending: str) -> str | None:
    """The option string of a part of the configuration, or of the whole one: the value of a key with that ending."""
    for tree in (path_get(config, part) or {}, config):
        for key, value in tree.items():
            if key.endswith(ending) and isinstance(value, str):
                return value
    return None


def _limits(config: dict, key: str) -> dict[str, float]:
    variables = path_get(config, "data.variables", [])
    return {v["name"]: float(v[key]) for v in variables if v.get(key) is not None}


def from_config(config: dict | str) -> tuple[tuple[str, ...], DetectionParams, TrackingParams, StatsParams]:
    """Translate a JSON run configuration into (dimensions, detection, tracking, statistics).

    Free option strings (keys that end in ``-detect`` and ``-track``) go before the other keys; an option that is not
    known raises a ValueError.
    """
    if isinstance(config, str):
        with open(config, encoding="utf-8") as fh:
            config = json.load(fh)
    dims = tuple(path_get(config, "data.dimensions", ()))
    detection = DetectionParams(
        variables=tuple(v["name"] for v in path_get(config, "data.variables", [])),
        lower=_limits(config, "lowerThreshold"),
        upper=_limits(config, "upperThreshold"),
        replacement=_limits(config, "replacementValue"),
        min_cluster_size=int(path_get(config, "detection.minClusterSize") or 1),
        postprocess_with_previous=bool(path_get(config, "detection.usePrevious", False)),
        weight="oase-ci" if path_get(config, "detection.useCIScore", False) else "default",
    )
    options = _given(_detection_options(), _option_string(config, "detection", "-detect"))
    dims = options.pop("dimensions", dims)
    detection = replace(detection, **options)
    defaults = TrackingParams()
    number = lambda key, fallback: fallback if path_get(config, key) is None else float(path_get(config, key))
    tracking = replace(
        defaults,
        tracking_variable=path_get(config, "tracking.histogramVariable"),
        correlation_weight=number("tracking.histogramWeight", 0.0),
        range_weight=number("tracking.positionWeight", 0.0),
        size_weight=number("tracking.sizeWeight", 0.0),
        max_velocity=number("tracking.maxSpeed", defaults.max_velocity),
        max_delta_t=number("tracking.maxTime", defaults.max_delta_t),
        max_size_deviation=number("tracking.maxSizeDeviation", defaults.max_size_deviation),
        use_displacement_vectors=bool(path_get(config, "tracking.useDisplacementVectors", False)),
    )
    tracking = replace(tracking, **_given(_tracking_options(), _option_string(config, "tracking", "-track")))
    stats = StatsParams()
    for name in ("length", "size", "speed", "direction"):
        given = path_get(config, f"postprocessing.tracks.statistics.{name}_classes")
        if given:
            stats = replace(stats, **{f"{name}_classes": tuple(given)})
    return dims, detection, tracking, stats
